"""Operators on tracked points: runs, differences, diameters, coverage, gates and carried positions.

Tracks are in long form: episode, kp (keypoint), t (integer frame), x, y, z, visible, cluster. Every
window starts with episode, so the windows of one pipeline share a shuffle. Rows with a null t are
left out where order matters; a null flag counts as not visible; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracespark.functions.geometry import project

TRACK = ["episode", "kp"]


def _seen() -> Column:
    return F.coalesce(F.col("visible"), F.lit(False))


def visible_run_lengths(tracks: DataFrame) -> DataFrame:
    """Adds run_before and run_after: visible steps in a row up to and from each step, the step included; 0 where hidden."""
    w = Window.partitionBy(*TRACK).orderBy("t")
    gone = F.when(~_seen(), F.col("t"))
    first, last = F.min("t").over(Window.partitionBy(*TRACK)), F.max("t").over(Window.partitionBy(*TRACK))
    before = F.coalesce(F.max(gone).over(w.rowsBetween(Window.unboundedPreceding, 0)), first - 1)
    after = F.coalesce(F.min(gone).over(w.rowsBetween(0, Window.unboundedFollowing)), last + 1)
    return tracks.where("t is not null").withColumn("run_before", F.col("t") - before).withColumn("run_after", after - F.col("t"))


def second_difference(tracks: DataFrame, depth_weight: float = 0.1) -> DataFrame:
    """Adds accel: the norm of the second difference of (x, y, weighted z), at its middle step; null at both ends."""
    w = Window.partitionBy(*TRACK).orderBy("t")
    d2 = lambda c: F.lead(c).over(w) - 2 * F.col(c) + F.lag(c).over(w)
    return tracks.withColumn("accel", F.sqrt(d2("x") ** 2 + d2("y") ** 2 + (depth_weight * d2("z")) ** 2))


def through_own_camera(tracks: DataFrame, cameras: DataFrame) -> DataFrame:
    """Tracks with x, y, z as pixels and depth in the camera of each row's own frame; rows without a camera are left out.

    cameras: episode, t, fx, fy, cx, cy, pose (16 doubles, by rows), one row per frame.
    """
    return _seen_by(tracks.join(cameras.select("episode", "t", "fx", "fy", "cx", "cy", "pose"), ["episode", "t"]), tracks.columns)


def through_first_camera(tracks: DataFrame, cameras: DataFrame) -> DataFrame:
    """Tracks with x, y, z as pixels and depth in the camera of the first frame of the track's life."""
    born = F.min("t").over(Window.partitionBy(*TRACK))
    c = cameras.select("episode", F.col("t").alias("_born"), "fx", "fy", "cx", "cy", "pose")
    return _seen_by(tracks.withColumn("_born", born).join(c, ["episode", "_born"]), tracks.columns)


def _seen_by(joined: DataFrame, columns: list[str]) -> DataFrame:
    u, v, z = project(*[F.col(c) for c in ("fx", "fy", "cx", "cy")], [F.col("pose")[k] for k in range(16)], F.col("x"), F.col("y"), F.col("z"))
    return joined.select(*[F.col(c) for c in columns if c not in ("x", "y", "z")], u.alias("x"), v.alias("y"), z.alias("z"))


def track_acceleration(tracks: DataFrame, frames: DataFrame, moving: DataFrame | None = None, margin: int = 5, depth_weight: float = 0.1) -> DataFrame:
    """episode, t, acceleration: mean over the moving points with more than ``margin`` visible steps on both sides; 0 for frames without any.

    moving: episode, kp, is_moving; None takes all points.
    """
    if moving is not None:
        tracks = tracks.join(moving.where("is_moving").select(*TRACK).distinct(), TRACK, "left_semi")
    run = second_difference(visible_run_lengths(tracks), depth_weight)
    kept = run.where((F.col("run_before") > margin) & (F.col("run_after") > margin) & F.col("accel").isNotNull())
    mean = kept.groupBy("episode", "t").agg(F.avg("accel").alias("a"))
    return frames.select("episode", "t").distinct().join(mean, ["episode", "t"], "left").select("episode", "t", F.coalesce("a", F.lit(0.0)).alias("acceleration"))


def track_diameter(tracks: DataFrame, horizon: int = 64, depth_weight: float = 0.1) -> DataFrame:
    """episode, kp, diameter: the largest distance between any two visible points of the first ``horizon`` frames; 0 with fewer than two.

    The points of a track within the horizon are one small array, so the pairs are formed inside a row
    and never shuffled.
    """
    pts = tracks.where(_seen() & (F.col("t") < horizon)).groupBy(*TRACK).agg(F.collect_list(F.struct("x", "y", (F.col("z") * depth_weight).alias("z"))).alias("p"))
    far = F.aggregate("p", F.lit(0.0), lambda m, a: F.greatest(m, F.aggregate("p", F.lit(0.0), lambda n, b: F.greatest(n, F.sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)))))
    return tracks.select(*TRACK).distinct().join(pts.select(*TRACK, far.alias("d")), TRACK, "left").select(*TRACK, F.coalesce("d", F.lit(0.0)).alias("diameter"))


def moving_tracks(diameters: DataFrame, width: float, height: float) -> DataFrame:
    """Adds is_moving: diameter above a twentieth of the frame, measured along its diagonal."""
    return diameters.withColumn("is_moving", F.col("diameter") > ((height / 20) ** 2 + (width / 20) ** 2) ** 0.5)


def movement_counters(diameters: DataFrame, scale: float) -> DataFrame:
    """episode, total_unique_kps, n_above_005, n_above_010."""
    r = F.col("diameter") / scale
    return diameters.groupBy("episode").agg(F.count(F.lit(1)).alias("total_unique_kps"), F.count_if(r > 0.05).alias("n_above_005"), F.count_if(r > 0.10).alias("n_above_010"))


def _cell(c: str, size: float, n: int) -> Column:
    return F.floor(F.col(c) / size * n).cast("int")


def patch_coverage(tracks: DataFrame, frames: DataFrame, width: float, height: float, grid: int = 16) -> DataFrame:
    """episode, t, coverage: share of grid cells with a visible point inside the frame; frames without any count as 0."""
    inside = tracks.where(_seen() & (F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    cells = inside.groupBy("episode", "t").agg(F.count_distinct(F.least(_cell("y", height, grid), F.lit(grid - 1)) * grid + F.least(_cell("x", width, grid), F.lit(grid - 1))).alias("n"))
    return frames.select("episode", "t").distinct().join(cells, ["episode", "t"], "left").select("episode", "t", (F.coalesce("n", F.lit(0)) / F.lit(grid * grid)).alias("coverage"))


def coverage_gate(coverage: DataFrame, least: float) -> DataFrame:
    """episode, mean_coverage, accepted."""
    return coverage.groupBy("episode").agg(F.avg("coverage").alias("mean_coverage")).withColumn("accepted", F.col("mean_coverage") >= least)


def dilated_cover_mask(tracks: DataFrame, width: float, height: float, grid: int = 16, clip_offscreen: bool = True) -> DataFrame:
    """episode, t, py, px: cells that hold a visible point, and their eight neighbours.

    With ``clip_offscreen`` points outside the frame count in the nearest border cell, else they are left out.
    """
    p = tracks.where(_seen() & F.col("x").isNotNull() & F.col("y").isNotNull())
    py, px = _cell("y", height, grid), _cell("x", width, grid)
    if clip_offscreen:
        py, px = F.greatest(F.lit(0), F.least(F.lit(grid - 1), py)), F.greatest(F.lit(0), F.least(F.lit(grid - 1), px))
    cells = p.select("episode", "t", py.alias("py"), px.alias("px")).where(f"py between 0 and {grid - 1} and px between 0 and {grid - 1}").distinct()
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    wide = cells.withColumn("dy", F.explode(step)).withColumn("dx", F.explode(step)).select("episode", "t", (F.col("py") + F.col("dy")).alias("py"), (F.col("px") + F.col("dx")).alias("px"))
    return wide.where(f"py between 0 and {grid - 1} and px between 0 and {grid - 1}").distinct()


def point_budget(mask: DataFrame, frames: DataFrame, budget: int, grid: int = 16) -> DataFrame:
    """episode, t, n_points: the budget scaled by the uncovered share of the frame, at least 1."""
    n = mask.groupBy("episode", "t").agg(F.count(F.lit(1)).alias("n"))
    free = 1 - F.coalesce("n", F.lit(0)) / F.lit(grid * grid)
    return frames.select("episode", "t").distinct().join(n, ["episode", "t"], "left").select("episode", "t", F.greatest(F.lit(1), (free * budget).cast("int")).alias("n_points"))


def keypoints_per_frame(tracks: DataFrame, frames: DataFrame) -> DataFrame:
    n = tracks.where(_seen()).groupBy("episode", "t").agg(F.count(F.lit(1)).alias("n"))
    return frames.select("episode", "t").distinct().join(n, ["episode", "t"], "left").select("episode", "t", F.coalesce("n", F.lit(0)).alias("n_keypoints"))


def interpolate_dense(tracks: DataFrame) -> DataFrame:
    """episode, kp, t, x, y: visible positions carried linearly over hidden steps, constant before the first and after the last; tracks never seen stay out."""
    w = Window.partitionBy(*TRACK).orderBy("t")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    p = F.when(_seen(), F.struct("t", "x", "y"))
    d = tracks.select(*TRACK, "t", F.last(p, True).over(back).alias("a"), F.first(p, True).over(ahead).alias("b")).where("a is not null or b is not null")
    at = lambda c: F.when(F.col("a").isNull(), F.col(f"b.{c}")).when(F.col("b").isNull() | (F.col("a.t") == F.col("b.t")), F.col(f"a.{c}")).otherwise(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t")))
    return d.select(*TRACK, "t", at("x").alias("x"), at("y").alias("y"))


def traversal_length(tracks: DataFrame) -> DataFrame:
    """episode, kp, length: sum of steps between following frames that are both visible."""
    w = Window.partitionBy(*TRACK).orderBy("t")
    both = _seen() & F.coalesce(F.lead("visible").over(w), F.lit(False))
    step = F.when(both, F.sqrt((F.lead("x").over(w) - F.col("x")) ** 2 + (F.lead("y").over(w) - F.col("y")) ** 2)).otherwise(0.0)
    return tracks.withColumn("s", step).groupBy(*TRACK).agg(F.sum("s").alias("length"))


def nth_visible(tracks: DataFrame, n: int) -> DataFrame:
    """episode, kp, t_n: frame of the n-th visible step (from 1), -1 where there is none."""
    w = Window.partitionBy(*TRACK).orderBy("t")
    k = tracks.where(_seen()).select(*TRACK, "t", F.row_number().over(w).alias("k")).where(F.col("k") == n)
    return tracks.select(*TRACK).distinct().join(k, TRACK, "left").select(*TRACK, F.coalesce("t", F.lit(-1)).alias("t_n"))


def carry_over_last_position(tracks: DataFrame, boundary: int) -> DataFrame:
    """episode, kp, x, y, z of each point's last visible step before ``boundary``: the queries of the next window."""
    last = F.max_by(F.struct("x", "y", "z"), "t")
    return tracks.where(_seen() & (F.col("t") < boundary)).groupBy(*TRACK).agg(last.alias("p")).select(*TRACK, "p.x", "p.y", "p.z")


def trail(tracks: DataFrame, steps: int = 8) -> DataFrame:
    """Adds trail_x: the x of up to ``steps`` frames before and the frame itself, oldest first."""
    return tracks.withColumn("trail_x", F.collect_list("x").over(Window.partitionBy(*TRACK).orderBy("t").rowsBetween(-steps, 0)))


def resample_frames(frames: DataFrame, source_fps: float, target_fps: float) -> DataFrame:
    """episode, t, new_t: every max(1, round-half-even(source / target))-th frame, renumbered."""
    step = max(1, round(source_fps / target_fps))
    w = Window.partitionBy("episode").orderBy("t")
    return frames.select("episode", "t").distinct().where(F.col("t") % step == 0).withColumn("new_t", F.row_number().over(w) - 1)


def causal(tracks: DataFrame, queries: DataFrame) -> DataFrame:
    """Track rows from each point's query frame on; queries: episode, kp, query_t."""
    return tracks.join(queries, TRACK).where("t >= query_t")


def bidirectional(forward: DataFrame, backward: DataFrame, queries: DataFrame) -> DataFrame:
    """episode, kp, t, x: the backward pass before a point's query frame where it has one, else the forward pass."""
    f, b = forward.select(*TRACK, "t", F.col("x").alias("fx")), backward.select(*TRACK, "t", F.col("x").alias("bx"))
    j = f.join(b, [*TRACK, "t"], "left").join(queries.select(*TRACK, "query_t"), TRACK)
    return j.select(*TRACK, "t", F.coalesce(F.when(F.col("t") < F.col("query_t"), F.col("bx")), F.col("fx")).alias("x"))


def norm_rank(points: DataFrame, episode: str = "episode") -> DataFrame:
    """Adds rank01: rank by squared norm, from 0 to 1; ties by kp."""
    w = Window.partitionBy(episode).orderBy(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2, "kp")
    n = F.count(F.lit(1)).over(Window.partitionBy(episode))
    return points.withColumn("rank01", (F.row_number().over(w) - 1) / F.greatest(n - 1, F.lit(1)))


def hop_windows(frames: DataFrame, size: int) -> DataFrame:
    """episode, t, window: every window of ``size`` frames, half a window apart, that holds the frame; the first starts at 0."""
    hop = max(1, size // 2)
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("t") - size) / hop) + 1)
    return frames.select("episode", "t").distinct().select("episode", "t", F.explode(F.sequence(first, F.floor(F.col("t") / hop))).alias("window"))


def normalised_depth(tracks: DataFrame, horizon: int = 8) -> DataFrame:
    """Adds z01: depth within the range of the next ``horizon`` frames of its track, 0 where the range is empty."""
    w = Window.partitionBy(*TRACK).orderBy("t").rowsBetween(0, horizon - 1)
    lo, hi = F.min("z").over(w), F.max("z").over(w)
    return tracks.withColumn("z01", F.coalesce(F.try_divide(F.col("z") - lo, hi - lo), F.lit(0.0)))


def motion_mask(points: DataFrame, height: int, width: int, radius: int = 12, dilate: int = 5) -> DataFrame:
    """episode, t, y, x: pixels within ``radius`` of a point, widened by a box of ``dilate`` on each side. points: episode, t, y, x (integers).

    Columns of a disk become runs, so a point gives 2 radius + 1 rows before the box widens them in place.
    """
    runs = points.select("episode", "t", "y", "x").distinct().withColumn("dx", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    half = F.floor(F.sqrt(F.lit(radius * radius) - F.col("dx") * F.col("dx"))).cast("int")
    col = runs.select("episode", "t", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") - half - dilate).alias("a"), (F.col("y") + half + dilate).alias("b"))
    wide = col.withColumn("x", F.explode(F.sequence(F.col("x") - dilate, F.col("x") + dilate))).where(f"x >= 0 and x < {width}").distinct()
    cells = wide.select("episode", "t", F.explode(F.sequence(F.greatest("a", F.lit(0)), F.least("b", F.lit(height - 1)))).alias("y"), "x")
    return cells.distinct()


def cluster_hue(cluster: Column) -> Column:
    """Hue in [0, 1) by steps of the golden ratio, so that neighbours in number differ in colour."""
    return (cluster * F.lit(0.618033988749895)) % 1
