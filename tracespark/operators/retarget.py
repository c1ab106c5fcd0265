"""Training samples: tracks seen through the camera of an anchor frame, read at equal arc length, with raw futures and histories.

Tracks that live over the same frames form a group and share one clock. For an anchor frame the whole life of
its group is projected through that frame's camera; the steps from the anchor on are its future, those back from it
its history. The clock of each is the robust length of its steps (the mean of the longest ones over all tracks of
the group, moving or not); all tracks are read where that clock passes multiples of a fixed spacing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANCHORS = 64  # anchor frames of a group that one task works on
POINTS = "array<struct<x:double,y:double,z:double>>"


def robust_step_length(tracks: DataFrame, width: float, height: float, share: float = 0.02) -> DataFrame:
    """episode, t, r: mean of the longest ``share`` (at least one) of the steps from t to t + 1, over all tracks of the episode.

    x and y count as shares of the frame, z as it is. The ranking needs one sort per (episode, t).
    """
    w = Window.partitionBy("episode", "kp").orderBy("t")
    nx = lambda c, s: (F.lead(c).over(w) - F.col(c)) / s
    length = F.sqrt(nx("x", width) ** 2 + nx("y", height) ** 2 + nx("z", 1.0) ** 2)
    s = tracks.select("episode", "kp", "t", length.alias("len")).where("len is not null")
    p = Window.partitionBy("episode", "t")
    k = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.count(F.lit(1)).over(p)))
    ranked = s.select("episode", "t", "len", F.row_number().over(p.orderBy(F.desc("len"), "kp")).alias("rank"), k.alias("k"))
    return ranked.where("rank <= k").groupBy("episode", "t").agg(F.avg("len").alias("r"))


def equal_arcs(points: np.ndarray, spacing: float, most: int, share: float = 0.02, wanted: np.ndarray | None = None) -> np.ndarray:
    """(tracks, slots, 3): points (tracks, steps, 3), in units of the frame, read at every ``spacing`` of their common clock; slot 0 is the first point.

    One step, or none that moves, leaves slot 0 only. wanted: the tracks to read; all of them set the clock.
    """
    steps = np.sqrt((np.diff(points, axis=1) ** 2).sum(2))
    longest = max(1, int(np.ceil(share * len(points))))
    pace = -np.sort(-steps, axis=0)[:longest].mean(0)
    clock = np.concatenate([[0.0], np.cumsum(pace)])
    at = spacing * np.arange(min(int(clock[-1] / spacing) + 1, most))
    # Between the readings of the clock, positions run on straight lines.
    return np.stack([[np.interp(at, clock, track[:, d]) for d in range(3)] for track in (points if wanted is None else points[wanted])]).transpose(0, 2, 1)


def lifespans(tracks: DataFrame) -> DataFrame:
    """episode, kp, born, died: first and last frame of each track. Tracks of an episode with the same two are a group."""
    return tracks.groupBy("episode", "kp").agg(F.min("t").alias("born"), F.max("t").alias("died"))


def assembled_samples(
    tracks: DataFrame, cameras: DataFrame, width: float, height: float, moving: DataFrame | None = None,
    future: int = 128, history: int = 32, spacing: float = 0.05, at_least: int = 2, anchors: int = ANCHORS,
) -> DataFrame:
    """episode, t, kp, x, y, traj, traj_history, raw_traj, raw_traj_history of every anchor.

    tracks: episode, kp, t, x, y, z, a row for each frame of a track's life. cameras: episode, t, fx, fy, cx, cy,
    pose (16 doubles, world to camera, by rows). moving: episode, kp, is_moving; None takes all tracks. An anchor is a moving
    track at a frame with a camera, if it lies on screen there and some anchor of that frame and group
    has ``at_least`` steps ahead of it, itself included. traj and traj_history are read at
    equal arc length, at most ``future`` and ``history`` slots; the raw ones are the steps themselves.
    x, y, z are pixels of the anchor's camera and depth; slot 0 is the anchor.

    Each group meets its anchors in blocks of ``anchors`` frames, so a task holds one group's life and one
    block, and long lives spread over tasks. Null coordinates are carried as NaN; rows with a null t or kp
    are left out, a frame delivered twice counts once, the largest position. A life with missing frames is read as if its rows followed each other.
    Empty tables give empty results.
    """
    t = tracks.where("t is not null and kp is not null").groupBy("episode", "kp", "t").agg(F.max(F.struct("x", "y", "z")).alias("p"))
    if moving is None:
        life = lifespans(t).withColumn("moves", F.lit(True))
    else:
        flags = moving.groupBy("episode", "kp").agg(F.max("is_moving").alias("moves"))
        life = lifespans(t).join(flags, ["episode", "kp"], "left").withColumn("moves", F.coalesce("moves", F.lit(False)))
    track = t.groupBy("episode", "kp").agg(F.array_sort(F.collect_list(F.struct("t", "p"))).alias("steps"))  # bounded by the life of a track
    track = track.join(life, ["episode", "kp"]).select("episode", "born", "died", "kp", "moves", F.transform("steps", lambda s: s.t).alias("at"), F.transform("steps", lambda s: F.array(s.p.x, s.p.y, s.p.z)).alias("xyz"))
    blocks = track.withColumn("block", F.explode(F.sequence(F.floor(F.col("born") / anchors), F.floor(F.col("died") / anchors))))
    cam = cameras.groupBy("episode", F.floor(F.col("t") / anchors).alias("block")).agg(F.collect_list(F.struct("t", "fx", "fy", "cx", "cy", "pose")).alias("cams"))  # one per frame of the block
    keys = ["episode", "born", "died", "block"]
    cam = blocks.select(keys).distinct().join(cam, ["episode", "block"]).select(*[F.col(k).alias(f"_{k}") for k in keys], "cams")

    arrays = ["traj", "traj_history", "raw_traj", "raw_traj_history"]
    flat = [f"{a}_{c}" for a in arrays for c in "xyz"]  # plain arrays leave Python far faster than arrays of structs

    def run(key: tuple, tracks_: pd.DataFrame, cams_: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(tracks_) and len(cams_):
            by_frame = {c["t"]: c for cs in cams_["cams"] for c in cs}
            out += _group_samples(tracks_.sort_values("kp"), by_frame, width, height, future, history, spacing, at_least)
        return pd.DataFrame([(key[0], *r) for r in out], columns=["episode", "t", "kp", "x", "y", *flat])

    e, k = (tracks.schema[c].dataType.simpleString() for c in ("episode", "kp"))
    schema = f"episode {e}, t bigint, kp {k}, x double, y double, " + ", ".join(f"{c} array<double>" for c in flat)
    points = [F.arrays_zip(*[F.col(f"{a}_{c}").alias(c) for c in "xyz"]).cast(POINTS).alias(a) for a in arrays]
    found = blocks.groupBy(keys).cogroup(cam.groupBy([f"_{k}" for k in keys])).applyInPandas(run, schema)
    return found.select("episode", "t", "kp", "x", "y", *points)


def _group_samples(g: pd.DataFrame, cams: dict, width: float, height: float, future: int, history: int, spacing: float, at_least: int) -> list[tuple]:
    """The samples of one group at the anchors that have a camera."""
    frames = np.asarray(g["at"].iloc[0])
    world = np.array([np.stack(x) for x in g["xyz"]], dtype=np.float64)
    moves, names = g["moves"].to_numpy(bool), g["kp"].tolist()
    scale = np.array([width, height, 1.0])
    out = []
    if not moves.any():
        return out
    for i in [i for i, f in enumerate(frames) if f in cams]:
        c = cams[frames[i]]
        m = np.asarray(c["pose"], np.float64).reshape(4, 4)
        seen = world @ m[:3, :3].T + m[:3, 3]
        depth = seen[..., 2]
        image = np.stack([(c["fx"] * seen[..., 0] + c["cx"] * depth) / (depth + 1e-8), (c["fy"] * seen[..., 1] + c["cy"] * depth) / (depth + 1e-8), depth], -1)
        u, v = image[:, i, 0], image[:, i, 1]
        wanted = np.flatnonzero(moves & (u >= 0) & (u < width) & (v >= 0) & (v < height))
        ahead, back = image[:, i:], image[:, i::-1]
        if not len(wanted) or min(ahead.shape[1], future) < at_least:
            continue
        traj = equal_arcs(ahead / scale, spacing, future, wanted=wanted) * scale
        past = equal_arcs(back / scale, spacing, history, wanted=wanted) * scale
        rows = zip(wanted, traj, past, ahead[wanted, :future], back[wanted, :history])
        out += [(int(frames[i]), names[n], float(u[n]), float(v[n]), *(np.ascontiguousarray(a[:, d]) for a in arrays for d in range(3))) for n, *arrays in rows]
    return out


def padded(points: str, length: int) -> tuple[Column, Column]:
    """A sample's array at fixed length, filled up with negative infinity, and the mask of what is real."""
    none = F.struct(*[F.lit(float("-inf")).alias(c) for c in "xyz"])
    n = F.size(points)
    return F.slice(F.concat(F.col(points), F.array_repeat(none, F.greatest(F.lit(length) - n, F.lit(0)))), 1, length), F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: i < n)
