"""Pieces of oversized chunks, cut at calm frames by content-defined chunking.

A rolling hash over the coarse shape of the acceleration gives each frame a rank. Landmarks are the frames
whose rank is the highest within a distance to both sides; each snaps to the nearest valley of the
acceleration. A landmark depends on the frames around it alone and never on the cut before it, so an
edit moves only the pieces next to it. Where landmarks are further apart than the limit allows, the space
between them is cut at its calmest valley, again and again, which depends on nothing outside that space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespark.operators.deliveries import latest_chunks

WINDOW, SNAP, PEAK = 8, 6, 0.8


def frame_hashes(a: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rolling hash of the ``window`` readings up to each frame; a quarter octave of acceleration is one letter."""
    with np.errstate(divide="ignore", invalid="ignore"):
        letter = np.clip(np.nan_to_num(np.round(4 * np.log2(np.abs(a))), nan=0, posinf=511, neginf=-512), -512, 511).astype(np.int64) + 512
    h = np.zeros(len(a), np.uint64)
    mixed = (letter.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (letter.astype(np.uint64) << np.uint64(29))
    with np.errstate(over="ignore"):
        for k in range(min(window, len(a))):
            h[k:] = h[k:] + mixed[: len(a) - k] * np.uint64(pow(0x100000001B3, k, 1 << 64))
        for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def valleys(a: np.ndarray) -> np.ndarray:
    """Frames no higher than their neighbours, with finite readings; the calm side of the motion."""
    pad = np.r_[np.inf, np.where(np.isfinite(a), a, np.inf), np.inf]
    mid = pad[1:-1]
    return np.isfinite(mid) & (mid <= pad[:-2]) & (mid <= pad[2:])


def cut_frames(a: np.ndarray, limit: int, peak: float | None = None) -> list[tuple[int, str]]:
    """Last frames of all pieces but the last, with how they were found, when no piece may exceed ``limit`` frames.

    a: an acceleration per frame, nan where there is none. peak: acceleration that is never cut at; frames
    of ``PEAK`` times as much and more are no boundary.
    """
    n, least = len(a), max(1, limit // 4)
    if n <= limit:
        return []
    calm = valleys(a)
    if peak is not None and peak == peak:
        calm &= a < PEAK * peak
    cuts: list[tuple[int, str]] = []
    reach = max(1, limit // 3)
    snap = min(SNAP, (reach - 1) // 2)
    place = np.flatnonzero(calm)
    if len(place):
        rank = frame_hashes(a)
        known = np.isfinite(a)
        # Highest rank within ``reach`` on both sides; of equals none. Ranks of frames without a reading are lowest.
        r = np.where(known, rank >> np.uint64(1), np.uint64(0))
        wide = np.lib.stride_tricks.sliding_window_view(np.r_[np.zeros(reach, np.uint64), r, np.zeros(reach, np.uint64)], 2 * reach + 1)
        top = known & (r == wide.max(1)) & ((wide == r[:, None]).sum(1) == 1)
        for m in np.flatnonzero(top):
            k = int(np.searchsorted(place, m))
            near = min((abs(int(place[j]) - int(m)), int(place[j])) for j in (k - 1, k) if 0 <= j < len(place))
            if near[0] <= snap and least - 1 <= near[1] < n - least:
                cuts.append((near[1], "landmark"))
    out: list[tuple[int, str]] = []
    before = -1
    for at, kind in [*cuts, (n - 1, "end")]:
        out += _within(a, calm, before, at, limit, least)
        if kind != "end":
            out.append((at, kind))
        before = at
    return out


def _within(a: np.ndarray, calm: np.ndarray, before: int, at: int, limit: int, least: int) -> list[tuple[int, str]]:
    """Cuts of the frames before + 1 ... at, so that none of the pieces exceeds the limit."""
    todo, out = [(before, at)], []
    while todo:
        p, q = todo.pop()
        if q - p <= limit:
            continue
        lo, hi = p + least, q - least
        v = np.flatnonzero(calm[lo : hi + 1]) + lo
        if len(v):
            c, kind = int(v[np.argmin(a[v])]), "valley"
        else:
            c, kind = min(p + limit, hi), "limit"
        out.append((c, kind))
        todo += [(p, c), (c, q)]
    return sorted(out)


def cut_pieces(start: int, end: int, limit: int, overlap: int, acceleration: np.ndarray | None, first: int, peak: float | None = None) -> list[tuple[int, int, str]]:
    """Inclusive pieces (start, end, boundary) of [start, end]; boundary tells how a piece ends.

    acceleration[i] belongs to frame first + i; frames without a reading are never preferred. peak: the
    chunk's peak acceleration; frames near it in height are no boundary where there is another. Every
    piece has at most ``limit`` frames, following pieces share exactly ``overlap`` frames (at most
    limit - 1), and no piece brings less than a quarter of what a piece may bring at most.
    """
    n = end - start + 1
    if n <= limit:
        return [(start, end, "end")]
    overlap = max(0, min(overlap, limit - 1))
    a = np.full(n, np.nan)
    if acceleration is not None and len(acceleration):
        lo, hi = max(start, first), min(end, first + len(acceleration) - 1)
        if lo <= hi:
            a[lo - start : hi - start + 1] = acceleration[lo - first : hi - first + 1]
    a = np.where(np.isfinite(a), a, np.nan)
    # Every piece is ``overlap`` frames shared with the one before it, and new ones; the first has its own.
    out, at = [], start
    for c, kind in cut_frames(a[overlap:], limit - overlap, peak):
        out.append((at, start + overlap + c, kind))
        at = start + c + 1
    return [*out, (at, end, "end")]


def split_chunks_at_calm(chunks: DataFrame, limits: DataFrame, acceleration: DataFrame) -> DataFrame:
    """``video_id, chunk_id, n_frames, n_pieces, piece_no, start_idx, end_idx, boundary`` of every chunk that holds.

    The latest delivery of a (video_id, chunk_id) counts. Chunks with a null or reversed index are left
    out; chunks of a dataset without a limit, or with a limit below 1, stay whole; a null overlap is 0.
    length is not read. Limits may repeat (the smallest holds). Only oversized chunks meet the
    acceleration and Python; of repeated acceleration rows the longest holds. Null or non-finite
    readings are never a boundary; a null peak_acceleration forbids no frame. An empty table gives an empty result.
    """
    held = latest_chunks(chunks, "segment_id", "start_idx", "end_idx", "dataset", "peak_acceleration").where("start_idx <= end_idx")
    # One row per dataset: checked below before it is broadcast.
    lim = limits.where("max_chunk_len >= 1").groupBy("dataset").agg(F.min(F.struct("max_chunk_len", F.coalesce("overlap", F.lit(0)).alias("overlap"))).alias("m")).select("dataset", "m.max_chunk_len", "m.overlap")
    if lim.limit(10_001).count() <= 10_000:
        lim = F.broadcast(lim)
    sized = held.join(lim, "dataset", "left").withColumn("n_frames", F.col("end_idx").cast("bigint") - F.col("start_idx") + 1)
    large = F.coalesce(F.col("n_frames") > F.col("max_chunk_len"), F.lit(False))
    cols = ["video_id", "chunk_id", "n_frames", "n_pieces", "piece_no", "start_idx", "end_idx", "boundary"]
    whole = sized.where(~large).select("video_id", "chunk_id", "n_frames", F.lit(1).alias("n_pieces"), F.lit(0).alias("piece_no"), "start_idx", "end_idx", F.lit("end").alias("boundary"))

    over = sized.where(large)
    keys = over.select("video_id", "segment_id").distinct()
    signal = acceleration.select("video_id", "segment_id", "first_idx", "acceleration").where("acceleration is not null and first_idx is not null")
    signal = signal.join(keys, ["video_id", "segment_id"], "left_semi").groupBy("video_id", "segment_id").agg(F.max(F.struct(F.size("acceleration").alias("n"), "first_idx", "acceleration")).alias("a"))
    o, g = over.alias("o"), signal.alias("g")
    lo = F.greatest(F.col("o.start_idx") - F.col("g.a.first_idx"), F.lit(0))
    span = F.greatest(F.col("o.end_idx") - F.col("g.a.first_idx") - lo + 1, F.lit(0))
    rows = o.join(g, ["video_id", "segment_id"], "left").select(
        "video_id", "chunk_id", "n_frames", "o.start_idx", "o.end_idx", "max_chunk_len", "overlap",
        (lo + F.col("g.a.first_idx")).alias("first"), F.slice(F.col("g.a.acceleration"), lo + 1, span).alias("a"), F.col("peak_acceleration").cast("double").alias("peak"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for v, c, n, s, e, m, o, f, a, peak in pdf.itertuples(index=False, name=None):
                readings = None if a is None else np.array([np.nan if x is None else x for x in a], dtype=np.float64)
                got = cut_pieces(int(s), int(e), int(m), int(o), readings, 0 if f is None or f != f else int(f), peak)
                out += [(v, c, n, len(got), i, x, y, k) for i, (x, y, k) in enumerate(got)]
            yield pd.DataFrame(out, columns=cols)

    kind = lambda c: chunks.schema[c].dataType.simpleString()
    cut = rows.mapInPandas(run, f"video_id string, chunk_id {kind('chunk_id')}, n_frames bigint, n_pieces int, piece_no int, start_idx {kind('start_idx')}, end_idx {kind('end_idx')}, boundary string")
    return whole.select(cols).unionByName(cut)
