"""Queries over tracked points and cameras."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracespark.functions import geometry as g
from tracespark.operators import tracks as op
from tracespark.operators import retarget as rt
from tracespark.plans.standins import CAM, CAMT, FRM, HEIGHT, ONE, OWN, SEEN, TRK, WIDTH, cameras, frames, pose, tracks, with_camera
from tracespark.runtime import table
from tracespark.sources.trace_episodes import through_trace_episodes

QUERIES: dict = {}
SQL: dict = {}


def _q(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def first_seen(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    return op.through_first_camera(t, cameras(t))


_RUN = """select *, t - coalesce(max(case when not visible then t end) over (partition by episode, kp order by t rows between unbounded preceding and current row), min(t) over (partition by episode, kp) - 1) as run_before,
  coalesce(min(case when not visible then t end) over (partition by episode, kp order by t rows between current row and unbounded following), max(t) over (partition by episode, kp) + 1) - t as run_after from"""
_RUNS = f"{TRK}, runs as ({_RUN} trk)"
_DIAM = f"""{TRK}, {ONE}, near as (select * from one where visible and t < 64),
pairs as (select a.episode, a.kp, max(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(cast(0.1 as double) * a.z - cast(0.1 as double) * b.z, 2))) as dist from near a join near b on a.kp = b.kp and a.t < b.t group by all),
diam as (select k.episode, k.kp, coalesce(dist, 0) as diameter from (select distinct episode, kp from trk) k left join pairs on k.kp = pairs.kp),
mov as (select kp from diam where diameter > {((HEIGHT / 20) ** 2 + (WIDTH / 20) ** 2) ** 0.5!r})"""
_ACC = f"""{_DIAM}, {FRM}, runs as ({_RUN} one where kp in (select kp from mov)), d as (select *, sqrt(power(lead(x) over w - 2 * x + lag(x) over w, 2) + power(lead(y) over w - 2 * y + lag(y) over w, 2) + power(cast(0.1 as double) * (lead(z) over w - 2 * z + lag(z) over w), 2)) as a
  from runs window w as (partition by episode, kp order by t))"""


@_q(f"""with {_ACC} select frm.episode, frm.t, round(coalesce(m.a, 0), 4) as acceleration from frm left join
  (select episode, t, avg(a) as a from d where run_before > 5 and run_after > 5 and a is not null group by all) m on frm.episode = m.episode and frm.t = m.t""")
def track_acceleration(spark: SparkSession, d: str) -> DataFrame:
    s = first_seen(spark, d)
    return op.track_acceleration(s, frames(s), op.moving_tracks(op.track_diameter(s), WIDTH, HEIGHT)).select("episode", "t", F.round("acceleration", 4).alias("acceleration"))


@_q(f"with {_RUNS} select episode, kp, t, run_before, run_after from runs")
def visible_run_lengths(spark: SparkSession, d: str) -> DataFrame:
    return op.visible_run_lengths(tracks(spark, d)).select("episode", "kp", "t", "run_before", "run_after")


@_q(f"with {_DIAM} select episode, kp, round(diameter, 4) as diameter from diam")
def track_diameter(spark: SparkSession, d: str) -> DataFrame:
    return op.track_diameter(first_seen(spark, d)).select("episode", "kp", F.round("diameter", 4).alias("diameter"))


@_q(f"with {_DIAM} select episode, kp, kp in (select kp from mov) as is_moving from diam")
def moving_tracks(spark: SparkSession, d: str) -> DataFrame:
    return op.moving_tracks(op.track_diameter(first_seen(spark, d)), WIDTH, HEIGHT).select("episode", "kp", "is_moving")


@_q(f"with {_DIAM} select episode, count(*) as total_unique_kps, count(*) filter (diameter / {WIDTH} > 0.05) as n_above_005, count(*) filter (diameter / {WIDTH} > 0.10) as n_above_010 from diam group by 1")
def movement_counters(spark: SparkSession, d: str) -> DataFrame:
    return op.movement_counters(op.track_diameter(first_seen(spark, d)), WIDTH)


_COV = f"""{TRK}, {FRM}, {OWN}, cells as (select episode, t, count(distinct least(15, cast(floor(y / {HEIGHT} * 16) as int)) * 16 + least(15, cast(floor(x / {WIDTH} * 16) as int))) as n from own
  where visible and x >= 0 and x < {WIDTH} and y >= 0 and y < {HEIGHT} group by 1, 2),
cov as (select frm.episode, frm.t, coalesce(n, 0) / cast(256 as double) as coverage from frm left join cells on frm.episode = cells.episode and frm.t = cells.t)"""


@_q(f"with {_COV} select episode, t, round(coverage, 6) as coverage from cov")
def patch_coverage(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    return op.patch_coverage(op.through_own_camera(t, cameras(t)), frames(t), WIDTH, HEIGHT).select("episode", "t", r6(F.col("coverage"), "coverage"))


@_q(f"with {_COV} select episode, round(avg(coverage), 6) as mean_coverage, avg(coverage) >= 0.03 as accepted from cov group by 1")
def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    return op.coverage_gate(op.patch_coverage(op.through_own_camera(t, cameras(t)), frames(t), WIDTH, HEIGHT), 0.03).select("episode", r6(F.col("mean_coverage"), "mean_coverage"), "accepted")


_MASK = f"""{TRK}, {FRM}, c as (select distinct episode, t, greatest(0, least(15, cast(floor(y / {HEIGHT} * 16) as int))) as py, greatest(0, least(15, cast(floor(x / {WIDTH} * 16) as int))) as px from trk where visible),
mask as (select distinct episode, t, py + dy as py, px + dx as px from c, (values (-1), (0), (1)) a(dy), (values (-1), (0), (1)) b(dx) where py + dy between 0 and 15 and px + dx between 0 and 15)"""


@_q(f"with {_MASK} select episode, t, cast(py as int) as py, cast(px as int) as px from mask")
def dilated_cover_mask(spark: SparkSession, d: str) -> DataFrame:
    return op.dilated_cover_mask(tracks(spark, d), WIDTH, HEIGHT)


@_q(f"with {_MASK}, n as (select episode, t, count(*) as n from mask group by 1, 2) select frm.episode, frm.t, cast(greatest(1, cast(floor((1 - coalesce(n, 0) / cast(256 as double)) * 150) as int)) as int) as n_points from frm left join n on frm.episode = n.episode and frm.t = n.t")
def point_budget(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    return op.point_budget(op.dilated_cover_mask(t, WIDTH, HEIGHT), frames(t), 150)


@_q(f"""with {TRK}, v as (select *, last_value(case when visible then struct_pack(t := t, x := x, y := y) end ignore nulls) over (partition by episode, kp order by t rows between unbounded preceding and current row) as a,
  first_value(case when visible then struct_pack(t := t, x := x, y := y) end ignore nulls) over (partition by episode, kp order by t rows between current row and unbounded following) as b from trk)
select episode, kp, t, round(case when a is null then b.x when b is null or a.t = b.t then a.x else a.x + (b.x - a.x) * (t - a.t) / (b.t - a.t) end, 6) as x,
  round(case when a is null then b.y when b is null or a.t = b.t then a.y else a.y + (b.y - a.y) * (t - a.t) / (b.t - a.t) end, 6) as y from v where a is not null or b is not null""")
def interpolate_dense_track(spark: SparkSession, d: str) -> DataFrame:
    return op.interpolate_dense(tracks(spark, d)).select("episode", "kp", "t", r6(F.col("x"), "x"), r6(F.col("y"), "y"))


@_q(f"""with {TRK}, s as (select *, case when visible and lead(visible) over w then sqrt(power(lead(x) over w - x, 2) + power(lead(y) over w - y, 2)) else 0 end as s from trk window w as (partition by episode, kp order by t))
select episode, kp, round(sum(s), 6) as length from s group by 1, 2""")
def traversal_length(spark: SparkSession, d: str) -> DataFrame:
    return op.traversal_length(tracks(spark, d)).select("episode", "kp", r6(F.col("length"), "length"))


@_q(f"with {TRK}, k as (select *, row_number() over (partition by episode, kp order by t) as k from trk where visible) select a.episode, a.kp, coalesce(k.t, -1) as t_n from (select distinct episode, kp from trk) a left join (select * from k where k = 50) k on a.kp = k.kp")
def nth_visible_step(spark: SparkSession, d: str) -> DataFrame:
    return op.nth_visible(tracks(spark, d), 50)


@_q(f"with {TRK} select episode, kp, arg_max(x, t) as x, arg_max(y, t) as y, arg_max(z, t) as z from trk where visible and t < 32 group by 1, 2")
def carry_over_last_position(spark: SparkSession, d: str) -> DataFrame:
    return op.carry_over_last_position(tracks(spark, d), 32)


@_q(f"with {TRK} select episode, kp, t, list(x) over (partition by episode, kp order by t rows between 8 preceding and current row) as trail_x from trk")
def point_trails(spark: SparkSession, d: str) -> DataFrame:
    return op.trail(tracks(spark, d)).select("episode", "kp", "t", "trail_x")


@_q(f"with {TRK}, {FRM} select episode, t, cast(row_number() over (partition by episode order by t) - 1 as bigint) as new_t from frm where t % 2 = 0")
def fps_resample(spark: SparkSession, d: str) -> DataFrame:
    return op.resample_frames(frames(tracks(spark, d)), 25.0, 10.0).withColumn("new_t", F.col("new_t").cast("bigint"))


@_q(f"with {TRK}, q as (select episode, kp, min(t) as query_t from trk where visible and cluster = 'purchase' group by 1, 2) select trk.episode, trk.kp, trk.t, x from trk join q on trk.kp = q.kp where t >= query_t")
def causal_tracks(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    q = t.where("visible and cluster = 'purchase'").groupBy("episode", "kp").agg(F.min("t").alias("query_t"))
    return op.causal(t, q).select("episode", "kp", "t", "x")


@_q(f"with {TRK}, q as (select episode, kp, max(t) // 2 as query_t from trk group by 1, 2) select trk.episode, trk.kp, trk.t, case when trk.t < query_t then -x else x end as x from trk join q on trk.kp = q.kp")
def bidirectional_tracks(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    q = t.groupBy("episode", "kp").agg(F.floor(F.max("t") / 2).alias("query_t"))
    return op.bidirectional(t, t.withColumn("x", -F.col("x")), q)


@_q(f"with {TRK}, p as (select episode, kp, x, y, z from trk where t = 0) select episode, kp, round((row_number() over (partition by episode order by x * x + y * y + z * z, kp) - 1) / cast(greatest(count(*) over (partition by episode) - 1, 1) as double), 6) as rank01 from p")
def norm_rank(spark: SparkSession, d: str) -> DataFrame:
    return op.norm_rank(tracks(spark, d).where("t = 0")).select("episode", "kp", r6(F.col("rank01"), "rank01"))


@_q(f"with {TRK}, {FRM}, n as (select episode, t, count(*) as n from trk where visible group by 1, 2) select frm.episode, frm.t, coalesce(n, 0) as n_keypoints from frm left join n on frm.episode = n.episode and frm.t = n.t")
def keypoints_per_frame(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    return op.keypoints_per_frame(t, frames(t))


@_q(f"with {TRK}, {OWN} select episode, kp, t, round(x, 4) as u, round(y, 4) as v, round(z, 6) as depth from own")
def own_camera_join(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    return op.through_own_camera(t, cameras(t)).select("episode", "kp", "t", F.round("x", 4).alias("u"), F.round("y", 4).alias("v"), r6(F.col("z"), "depth"))


@_q(f"with {TRK}, {ONE} select episode, kp, t, round(x, 4) as u, round(y, 4) as v, round(z, 6) as depth from one")
def first_camera_join(spark: SparkSession, d: str) -> DataFrame:
    return first_seen(spark, d).select("episode", "kp", "t", F.round("x", 4).alias("u"), F.round("y", 4).alias("v"), r6(F.col("z"), "depth"))


# Samples ------------------------------------------------------------------------------------------

# Every life through the camera of every anchor frame within it; both ways; read at equal arc length.
_LIFE = f"""life as (select episode, kp, min(t) as born, max(t) as died from trk group by 1, 2),
seen as (select p.episode, kp, born, died, camt.t as anchor, p.t as step, {SEEN} from (select trk.*, born, died from trk join life using (episode, kp)) p join camt on p.episode = camt.episode and camt.t between born and died),
way as (select 'f' as way, *, step - anchor as i from seen where step >= anchor union all select 'h' as way, *, anchor - step as i from seen where step <= anchor),
len as (select *, lead(x) over w as x1, lead(y) over w as y1, lead(z) over w as z1 from way window w as (partition by way, episode, kp, anchor order by i)),
rank as (select *, l, row_number() over (partition by way, episode, born, died, anchor, i order by l desc) as k, greatest(1, ceil(cast(0.02 as double) * count(*) over (partition by way, episode, born, died, anchor, i))) as most
  from (select *, sqrt(power((x1 - x) / {WIDTH}, 2) + power((y1 - y) / {HEIGHT}, 2) + power(z1 - z, 2)) as l from len) where x1 is not null),
pace as (select way, episode, born, died, anchor, i, avg(l) as r from rank where k <= most group by all),
clock as (select *, coalesce(sum(r) over (partition by way, episode, born, died, anchor order by i rows between unbounded preceding and 1 preceding), 0) as s from pace),
total as (select way, episode, born, died, anchor, max(i) as last, sum(r) as l, least(cast(floor(sum(r) / cast(0.05 as double)) as bigint) + 1, case when way = 'f' then 128 else 32 end) as m from pace group by 1, 2, 3, 4, 5),
slot as (select * exclude (m, l), cast(0.05 as double) * j as mark from (select *, unnest(range(m)) as j from total)),
place as (select slot.way, slot.episode, slot.born, slot.died, slot.anchor, j, max(mark) as mark, max(i) as i from slot join clock c on slot.way = c.way and slot.episode = c.episode and slot.born = c.born and slot.died = c.died and slot.anchor = c.anchor and c.s <= mark group by all),
mix as (select q.*, (mark - s) / greatest(r, 1e-12) as a from place q join clock c on q.way = c.way and q.episode = c.episode and q.born = c.born and q.died = c.died and q.anchor = c.anchor and q.i = c.i),
read as (select l.way, l.episode, l.kp, l.anchor, j, l.x + a * (x1 - l.x) as x, l.y + a * (y1 - l.y) as y, l.z + a * (z1 - l.z) as z from mix q join len l on q.way = l.way and q.episode = l.episode and q.born = l.born and q.died = l.died and q.anchor = l.anchor and q.i = l.i and x1 is not null
  union all select way, episode, kp, anchor, 0, x, y, z from len where i = 0 and x1 is null)"""
_SUMS = lambda n, j: f"count(*) as n_{n}, round(sum(x) + sum(y) + sum(z)) as s_{n}, round(sum({j} * (x - y + z)) / 10) as o_{n}"


def _sums(points: str, name: str) -> list:
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("o"), F.lit(0).alias("j"))
    r = F.aggregate(points, zero, lambda a, p: F.struct((a.s + p.x + p.y + p.z).alias("s"), (a.o + a.j * (p.x - p.y + p.z)).alias("o"), (a.j + 1).alias("j")))
    return [F.size(points).cast("bigint").alias(f"n_{name}"), F.round(r.s).alias(f"s_{name}"), F.round(r.o / 10).alias(f"o_{name}")]


@_q(f"""with {TRK}, {CAMT}, {_LIFE}, on_ as (select episode, kp, anchor from way where way = 'f' and i = 0 and x >= 0 and x < {WIDTH} and y >= 0 and y < {HEIGHT} and died > anchor),
f as (select episode, kp, anchor, {_SUMS('future', 'j')} from read where way = 'f' group by all), h as (select episode, kp, anchor, {_SUMS('history', 'j')} from read where way = 'h' group by all)
select on_.episode, on_.anchor as t, on_.kp, f.* exclude (episode, kp, anchor), h.* exclude (episode, kp, anchor) from on_ join f on on_.episode = f.episode and on_.kp = f.kp and on_.anchor = f.anchor join h on on_.episode = h.episode and on_.kp = h.kp and on_.anchor = h.anchor""")
def retargeted_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Every on-screen anchor of every track: number of slots, sums and order-sensitive sums of the retargeted future and history."""
    t = tracks(spark, d)
    s = rt.assembled_samples(t, cameras(t), WIDTH, HEIGHT)
    return s.select("episode", "t", "kp", *_sums("traj", "future"), *_sums("traj_history", "history"))


@_q(f"""with {_DIAM}, {_LIFE}, on_ as (select episode, kp, anchor, x, y from way where way = 'f' and i = 0 and x >= 0 and x < {WIDTH} and y >= 0 and y < {HEIGHT} and died > anchor and kp in (select kp from mov)),
f as (select episode, kp, anchor, {_SUMS('future', 'i')} from way where way = 'f' and i < 128 group by all), h as (select episode, kp, anchor, {_SUMS('history', 'i')} from way where way = 'h' and i < 32 group by all)
select on_.episode, on_.anchor as t, on_.kp, round(x, 4) as x, round(y, 4) as y, f.* exclude (episode, kp, anchor), h.* exclude (episode, kp, anchor), 128 - least(n_future, 128) as n_padding
from on_ join f on on_.episode = f.episode and on_.kp = f.kp and on_.anchor = f.anchor join h on on_.episode = h.episode and on_.kp = h.kp and on_.anchor = h.anchor""")
def sample_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Raw future and history of every moving, on-screen anchor, seen by the anchor's camera, and the padding of its fixed-length array."""
    t = tracks(spark, d)
    s = rt.assembled_samples(t, cameras(t), WIDTH, HEIGHT, op.moving_tracks(op.track_diameter(first_seen(spark, d)), WIDTH, HEIGHT))
    fixed, real = rt.padded("raw_traj", 128)
    return s.withColumn("fixed", fixed).withColumn("real", real).select("episode", "t", "kp", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), *_sums("raw_traj", "future"), *_sums("raw_traj_history", "history"), F.size(F.filter("fixed", lambda p: p.x == float("-inf"))).cast("bigint").alias("n_padding"))


# Cameras ------------------------------------------------------------------------------------------

@_q(f"with {TRK}, {OWN} select episode, kp, t, round(x, 4) as u, round(y, 4) as v, round(z, 6) as depth from own")
def camera_projection_uvz(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    c = t.join(cameras(t), ["episode", "t"])
    u, v, z = g.project(*[F.col(k) for k in ("fx", "fy", "cx", "cy")], [F.col("pose")[k] for k in range(16)], F.col("x"), F.col("y"), F.col("z"))
    return c.select("episode", "kp", "t", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"), r6(z, "depth"))


@_q(f"with {TRK} select episode, kp, t, round(x, 4) as x, round(y, 4) as y, round(z, 4) as z from trk")
def unproject_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Projects every point and takes it back: the result must be the point."""
    k, m = [F.col(c) for c in ("fx", "fy", "cx", "cy")], [F.col("pose")[i] for i in range(16)]
    t = tracks(spark, d)
    c = t.join(cameras(t), ["episode", "t"])
    u, v, z = g.project(*k, m, F.col("x"), F.col("y"), F.col("z"))
    c = c.withColumn("u", u).withColumn("v", v).withColumn("depth", z)
    a, b, e = g.unproject(*k, F.col("u") * (1 + 1e-8 / F.col("depth")), F.col("v") * (1 + 1e-8 / F.col("depth")), F.col("depth"))
    x, y, w = g.rigid(g.inverse_rigid(m), a, b, e)
    return c.select("episode", "kp", "t", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(w, 4).alias("z"))


@_q(f"""with {TRK}, f as (select distinct episode, t, cast(0.1 as double) * t as tx, cast(0.01 as double) * t as yaw from trk),
s as (select *, abs(tx - lag(tx) over w) as step, acos(greatest(-1, least(1, (2 * cos(yaw - lag(yaw) over w) + 1 - 1) / 2))) as rot from f window w as (partition by episode order by t))
select episode, round(sum(step), 5) as trans_total, round(avg(step), 5) as trans_mean, round(max(step), 5) as trans_max, round(sum(rot), 5) as rot_total, round(max(rot), 5) as rot_max from s group by 1""")
def camera_path_stats(spark: SparkSession, d: str) -> DataFrame:
    c = with_camera(tracks(spark, d).select("episode", "t").distinct())
    w = Window.partitionBy("episode").orderBy("t")
    m = pose()
    rel = g.compose(m, g.inverse_rigid([F.lag(x).over(w) for x in m]))
    c = c.withColumn("step", F.abs(F.col("tx") - F.lag("tx").over(w))).withColumn("rot", g.rotation_angle(rel[0] + rel[5] + rel[10]))
    r5 = lambda x, n: F.round(x, 5).alias(n)
    return c.groupBy("episode").agg(r5(F.sum("step"), "trans_total"), r5(F.avg("step"), "trans_mean"), r5(F.max("step"), "trans_max"), r5(F.sum("rot"), "rot_total"), r5(F.max("rot"), "rot_max"))


@_q(f"""with {TRK}, {CAM} select episode, kp, t, round(z / sqrt(power((x - cx) / fx, 2) + power((y - cy) / fy, 2) + 1), 6) as depth, round(sqrt(fx * fy) * ln(greatest(z, 1e-6)), 5) as log_depth,
  round(2 * atan(cast(480 as double) / 2 / fy), 6) as fov_y, round(fx * 639 / 319, 5) as fx_centred, round(fx * 640 / 320, 5) as fx_plain from cam""")
def camera_conversions(spark: SparkSession, d: str) -> DataFrame:
    fx, fy, cx, cy, x, y, z = (F.col(c) for c in ("fx", "fy", "cx", "cy", "x", "y", "z"))
    return with_camera(tracks(spark, d)).select(
        "episode", "kp", "t", r6(g.distance_to_depth(z, fx, fy, cx, cy, x, y), "depth"), F.round(g.log_depth(fx, fy, z), 5).alias("log_depth"), r6(g.fov(fy, F.lit(480.0)), "fov_y"),
        F.round(g.rescale_centred(fx, F.lit(320), F.lit(640)), 5).alias("fx_centred"), F.round(g.rescale_plain(fx, F.lit(320), F.lit(640)), 5).alias("fx_plain"),
    )


@_q(f"with {TRK}, {CAM} select distinct t, round(cos(yaw / 2), 6) as qw, round(sin(yaw / 2), 6) as qy, round(cos(yaw / 4), 6) as half_w, round(sin(yaw / 4), 6) as half_y from cam")
def quaternion_slerp(spark: SparkSession, d: str) -> DataFrame:
    """Rotation to quaternion, and half of it by spherical interpolation from the identity."""
    m = pose()
    q = g.quaternion([m[0], m[1], m[2], m[4], m[5], m[6], m[8], m[9], m[10]])
    turned = with_camera(frames(tracks(spark, d)).select("t").distinct()).select("t", F.array(*q).alias("q"))
    h = g.slerp([F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)], [F.col("q")[k] for k in range(4)], F.lit(0.5))
    return turned.select("t", r6(F.col("q")[0], "qw"), r6(F.col("q")[2], "qy"), F.array(*h).alias("h")).select("t", "qw", "qy", r6(F.col("h")[0], "half_w"), r6(F.col("h")[2], "half_y"))


@_q(f"with {TRK}, {FRM} select episode, t, unnest(generate_series(greatest(0, cast(floor((t - 16) / 8) as bigint) + 1), cast(floor(t / 8) as bigint))) as \"window\" from frm")
def hop_windows(spark: SparkSession, d: str) -> DataFrame:
    return op.hop_windows(frames(tracks(spark, d)), 16)


@_q(f"""with {TRK}, r as (select *, min(z) over w as lo, max(z) over w as hi from trk window w as (partition by episode, kp order by t rows between current row and 7 following))
select episode, kp, t, round(case when hi > lo then (z - lo) / (hi - lo) else 0 end, 6) as z01 from r""")
def normalised_depth(spark: SparkSession, d: str) -> DataFrame:
    return op.normalised_depth(tracks(spark, d)).select("episode", "kp", "t", r6(F.col("z01"), "z01"))


@_q("""with p as (select distinct video_id as episode, frame_index as t, cast(floor(keypoint_y / 10) as int) as y, cast(floor(keypoint_x / 10) as int) as x from samples),
disk as (select distinct episode, t, y + dy as y, x + dx as x from p, (select unnest(generate_series(-3, 3)) as dy) a, (select unnest(generate_series(-3, 3)) as dx) b where dx * dx + dy * dy <= 9)
select distinct episode, t, cast(y + ey as int) as y, cast(x + ex as int) as x from disk, (values (-1), (0), (1)) c(ey), (values (-1), (0), (1)) d(ex) where y + ey between 0 and 71 and x + ex between 0 and 95""")
def motion_mask(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples")
    p = s.select(F.col("video_id").alias("episode"), F.col("frame_index").alias("t"), F.floor(F.col("keypoint_y") / 10).cast("int").alias("y"), F.floor(F.col("keypoint_x") / 10).cast("int").alias("x"))
    return op.motion_mask(p, 72, 96, 3, 1)


@_q("select distinct cluster_id, round((cluster_id * cast(0.618033988749895 as double)) % 1, 6) as hue from samples where cluster_id is not null")
def cluster_hues(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").where("cluster_id is not null").select("cluster_id", r6(op.cluster_hue(F.col("cluster_id")), "hue")).distinct()


@_q("select md5(video_id) as episode, frame_index as t, count(*) as n_rows, count(*) filter (is_moving) as n_moving from samples where is_moving is not null group by 1, 2")
def episode_layout_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Writes the samples in the array layout, one folder per recording, and reads them back; a task drops folders it has read."""
    s = table(spark, d, "samples").where("is_moving is not null")
    rows = s.select(F.md5("video_id").alias("episode"), F.col("frame_index").alias("t"), F.col("sample_id").alias("kp_row"), F.struct(F.col("keypoint_x").alias("x"), F.col("keypoint_y").alias("y")).alias("keypoint"), "cluster_id", "is_moving", "visib", "raw_traj", "raw_valid_steps")
    back = through_trace_episodes(rows, "episode", "t", "is_moving")
    return back.groupBy("episode", "t").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_moving").alias("n_moving"))
