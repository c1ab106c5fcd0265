"""Operators on one-dimensional signals: noisy intervals, smoothing, peaks, boundaries and chunks.

A signal is one array per (episode, segment), as stored, with the frame number of its first value.
Array expressions keep the work inside the row: no shuffle at all. Nulls or empty arrays give no
output rows; readings must be finite (filter or repair them before).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Chunking:
    """How signals are cut. Two profiles exist: the general one, and one for long two-armed robot runs."""

    smooth_window: int = 11
    min_len: int = 25
    max_len: int = 200
    height_ratio: float = 0.40
    prominence_ratio: float = 0.40
    max_peaks: int = 5
    grow_with_length: bool = True  # longer segments may keep n // max_len - 1 peaks
    uniform_without_peaks: bool = True  # else one chunk


GENERAL = Chunking()
ROBOT = Chunking(min_len=25, max_len=300, height_ratio=0.35, prominence_ratio=0.35, max_peaks=2, grow_with_length=False, uniform_without_peaks=False)


# Noisy and clean stretches ------------------------------------------------------------------------


def noisy_intervals(counts: DataFrame, threshold: int, pad: int = 0) -> DataFrame:
    """episode, start_idx, end_idx: runs of frames with at least ``threshold`` points, widened by ``pad``, merged where they touch.

    counts: episode, t, n; t runs from 0 to the last frame. A threshold of 0 or less finds none.
    """
    c = counts.where(F.lit(threshold > 0) & (F.col("n") >= threshold))
    last = counts.groupBy("episode").agg(F.max("t").alias("last"))
    w = Window.partitionBy("episode").orderBy("t")
    runs = c.select("episode", "t", (F.col("t") - F.row_number().over(w)).alias("g")).groupBy("episode", "g").agg(F.min("t").alias("s"), F.max("t").alias("e"))
    wide = runs.join(last, "episode").select("episode", F.greatest(F.col("s") - pad, F.lit(0)).alias("s"), F.least(F.col("e") + pad, F.col("last")).alias("e"))
    return coalesce_intervals(wide)


def coalesce_intervals(iv: DataFrame) -> DataFrame:
    """episode, start_idx, end_idx: intervals (s, e) that overlap or touch, merged."""
    w = Window.partitionBy("episode").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("s") > reach + 1), 1).otherwise(0)
    g = iv.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("episode", "_g").agg(F.min("s").alias("start_idx"), F.max("e").alias("end_idx")).drop("_g")


def clean_segments(noisy: DataFrame, spans: DataFrame, min_len: int) -> DataFrame:
    """episode, start_idx, end_idx: what the noisy intervals leave of 0..n-1, where at least min(min_len, max(2, n)) long. spans: episode, n."""
    w = Window.partitionBy("episode").orderBy("start_idx")
    marks = noisy.select("episode", "start_idx", "end_idx").unionByName(spans.select("episode", F.col("n").alias("start_idx"), F.col("n").alias("end_idx")))
    gap = marks.select("episode", (F.coalesce(F.lag("end_idx").over(w), F.lit(-1)) + 1).alias("s"), (F.col("start_idx") - 1).alias("e"))
    need = F.least(F.lit(min_len), F.greatest(F.lit(2), F.col("n")))
    return gap.join(spans, "episode").where(F.col("e") - F.col("s") + 1 >= need).select("episode", F.col("s").alias("start_idx"), F.col("e").alias("end_idx"))


# Smoothing ----------------------------------------------------------------------------------------


def odd_window(n: Column, window: int) -> Column:
    """The window that fits the signal: at least 3, at most the signal's odd length, odd."""
    fit = F.greatest(F.lit(3), F.least(F.lit(window), F.when(n % 2 == 1, n).otherwise(n - 1)))
    return fit + F.when(fit % 2 == 0, 1).otherwise(0)


def moving_average(a: Column, window: int = 11) -> Column:
    """Mean over the window, the first and last value repeated beyond the ends."""
    n = F.size(a)
    h = ((odd_window(n, window) - 1) / 2).cast("int")
    at = lambda i: F.get(a, F.greatest(F.lit(0), F.least(n - 1, i)))
    return F.transform(a, lambda _, i: F.aggregate(F.sequence(-h, h), F.lit(0.0), lambda s, k: s + at(i + k).cast("double")) / (2 * h + 1))


def savgol_weights(window: int, degree: int = 2) -> list[list[float]]:
    """Row j: weights that give the fitted polynomial at place j of the window."""
    x = np.vander(np.arange(window) - (window - 1) / 2, degree + 1)
    return (x @ np.linalg.pinv(x)).tolist()


def savgol_values(a: np.ndarray, window: int, degree: int = 2) -> np.ndarray:
    """The fitted polynomial of each window of a signal at least as long as the window, at its place."""
    n = len(a)
    base = np.clip(np.arange(n) - window // 2, 0, n - window)
    rows = np.array(savgol_weights(window, degree))[np.arange(n) - base]
    view = np.lib.stride_tricks.sliding_window_view(a, window)[base]
    out = np.zeros(n)
    for k in range(window):  # from left to right, so that results do not depend on the array library's order
        out += rows[:, k] * view[:, k]
    return out


def savgol(a: Column, window: int = 11, degree: int = 2) -> Column:
    """Polynomial smoothing; near an end the last whole window's polynomial is read at the place. Signals shorter than the window are averaged instead."""

    @F.pandas_udf("array<double>")
    def fit(signals: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else savgol_values(np.asarray(x, np.float64), window, degree) if len(x) >= window else np.empty(0) for x in signals])

    return F.when(F.size(a) >= window, fit(a)).otherwise(moving_average(a, window))


# Peaks and boundaries -----------------------------------------------------------------------------


def _falls(s: np.ndarray) -> np.ndarray:
    """The least value between each place and the nearest strictly higher one before it, its own included."""
    out = np.empty(len(s))
    ridge: list[tuple[float, float]] = []  # falling heights, each with the least value since the one before
    for i, x in enumerate(s.tolist()):
        low = x
        while ridge and ridge[-1][0] <= x:
            low = min(low, ridge.pop()[1])
        out[i] = low
        ridge.append((x, low))
    return out


def prominent_maxima(s: np.ndarray, p: Chunking) -> list[tuple[int, float]]:
    """(place, prominence) of the local maxima high and prominent enough, in order of place. The ends are no maxima; a flat signal has none."""
    if len(s) < 3 or np.ptp(s) < 1e-9:
        return []
    prominence = s - np.maximum(_falls(s), _falls(s[::-1])[::-1])
    ok = (prominence >= p.prominence_ratio * np.ptp(s)) & (s - s.min() >= p.height_ratio * np.ptp(s))
    ok[1:-1] &= (np.diff(s)[:-1] >= 0) & (np.diff(s)[1:] <= 0)
    ok[[0, -1]] = False
    return [(int(i), float(prominence[i])) for i in np.flatnonzero(ok)]


def peak_candidates(signals: DataFrame, p: Chunking = GENERAL) -> DataFrame:
    """episode, segment, i, a, prominence: local maxima high and prominent enough; a plateau's places each count.

    A maximum's base on a side is the least value between it and the nearest strictly higher value.
    Signals are independent rows, scanned by an Arrow kernel without a shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for e, g, a in pdf.itertuples(index=False, name=None):
                s = np.asarray(a, dtype=np.float64)
                rows += [(e, g, i, s[i], prom) for i, prom in prominent_maxima(s, p)]
            yield pd.DataFrame(rows, columns=["episode", "segment", "i", "a", "prominence"])

    kind = lambda c: signals.schema[c].dataType.simpleString()
    return signals.select("episode", "segment", "a").where("a is not null").mapInPandas(run, f"episode {kind('episode')}, segment {kind('segment')}, i int, a double, prominence double")


def valley_boundaries(signals: DataFrame, peaks: DataFrame) -> DataFrame:
    """episode, segment, boundary: the first least value between two following peaks, where strictly inside."""
    w = Window.partitionBy("episode", "segment").orderBy("i")
    pair = peaks.select("episode", "segment", "i", F.lead("i").over(w).alias("j")).where("j is not null")
    part = F.slice("a", F.col("i") + 1, F.col("j") - F.col("i") + 1)
    v = pair.join(signals.select("episode", "segment", "a"), ["episode", "segment"]).select("episode", "segment", "i", "j", (F.col("i") + F.array_position(part, F.array_min(part)).cast("int") - 1).alias("boundary"))
    return v.where("boundary > i and boundary < j").select("episode", "segment", "boundary")


def spaced_peaks(s: np.ndarray, p: Chunking) -> list[int]:
    """Peaks in order of prominence; each blocks the places nearer than min_len around it."""
    free = np.ones(len(s), bool)
    kept = []
    for i, _ in sorted(prominent_maxima(s, p), key=lambda m: (-m[1], m[0])):
        if free[i]:
            kept.append(i)
            free[max(0, i - p.min_len + 1) : i + p.min_len] = False
    return kept


def enforce_lengths(boundaries: list[int], n: int, p: Chunking) -> list[tuple[int, int]]:
    """Inclusive pieces of 0..n-1: short ones join their shorter neighbour (the left one on a tie), long ones split into near-equal parts."""
    inner = sorted({b for b in boundaries if 0 < b < n})
    ahead = deque(np.diff([0, *inner, n]).tolist())
    whole: list[int] = []  # long enough, or the only one
    while ahead:
        size = ahead.popleft()
        if size >= p.min_len or not (whole or ahead):
            whole.append(size)
        elif not ahead or (whole and whole[-1] <= ahead[0]):
            whole[-1] += size
        else:
            ahead[0] += size
    parts = [len(x) for size in whole for x in np.array_split(np.empty(size), -(-size // p.max_len))]
    ends = np.cumsum(parts).tolist()
    return [(e - k, e - 1) for e, k in zip(ends, parts)]


def motion_boundaries(s: np.ndarray, p: Chunking) -> list[int]:
    """Where a smoothed signal is cut: at the lowest place between each two of its most prominent peaks, evenly without any."""
    most = max(p.max_peaks, len(s) // p.max_len - 1) if p.grow_with_length else p.max_peaks
    peaks = sorted(spaced_peaks(s, p)[:most])
    if peaks:
        lows = [(a, a + int(s[a : b + 1].argmin()), b) for a, b in pairwise(peaks)]
        return [low for a, low, b in lows if a < low < b]
    return list(range(0, len(s), int(np.clip(len(s) // 3, p.min_len, p.max_len))))[1:] if p.uniform_without_peaks else []


def chunk_signal(a: np.ndarray, p: Chunking = GENERAL) -> list[tuple[int, int, float, float]]:
    """(start, end, peak, mean) of the motion chunks of one signal; chunks tile it. Signals up to min_len are one chunk."""
    if not len(a):
        return []
    short = len(a) <= max(p.min_len, 2)
    pieces = [(0, len(a) - 1)] if short else enforce_lengths(motion_boundaries(smoothed(a, p.smooth_window), p), len(a), p)
    starts = [x for x, _ in pieces]
    sums, tops = np.add.reduceat(a, starts), np.maximum.reduceat(a, starts)
    return [(x, y, float(t), float(m) / (y - x + 1)) for (x, y), t, m in zip(pieces, tops, sums)]


def smoothed(a: np.ndarray, window: int) -> np.ndarray:
    """By local parabolas, or by the mean where only a window of three fits; the window is odd and no longer than the signal."""
    w = max(3, min(window | 1, (len(a) - 1) | 1))
    if w > 3 and len(a) >= w:
        return savgol_values(a, w)
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, w // 2, mode="edge"), w).mean(1)


def chunk_signals(signals: DataFrame, p: Chunking = GENERAL) -> DataFrame:
    """episode, segment, chunk_id, start_idx, end_idx, peak_acceleration, mean_acceleration; chunk_id numbers an episode's chunks in order.

    signals: episode, segment, first_idx, a. The cuts of one signal follow each other, so a signal is
    cut in one place; signals are independent.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (e, s, int(f) + x, int(f) + y, pk, mn)
                for e, s, f, a in pdf[["episode", "segment", "first_idx", "a"]].itertuples(index=False, name=None)
                if a is not None
                for x, y, pk, mn in chunk_signal(np.asarray(a, dtype=np.float64), p)
            ]
            yield pd.DataFrame(rows, columns=["episode", "segment", "start_idx", "end_idx", "peak_acceleration", "mean_acceleration"])

    kind = lambda c: signals.schema[c].dataType.simpleString()
    cut = signals.select("episode", "segment", "first_idx", "a").where("a is not null and first_idx is not null").mapInPandas(run, f"episode {kind('episode')}, segment {kind('segment')}, start_idx bigint, end_idx bigint, peak_acceleration double, mean_acceleration double")
    w = Window.partitionBy("episode").orderBy("segment", "start_idx")
    return cut.select("episode", "segment", (F.row_number().over(w) - 1).cast("bigint").alias("chunk_id"), "start_idx", "end_idx", "peak_acceleration", "mean_acceleration")


def chunk_stats(chunks: DataFrame, signals: DataFrame) -> DataFrame:
    """Adds peak and mean of the readings of each chunk (inclusive frames); 0 where it has none."""
    c, s = chunks.alias("c"), signals.alias("s")
    j = c.join(s, (F.col("c.episode") == F.col("s.episode")) & (F.col("c.segment") == F.col("s.segment")), "left")
    lo = F.greatest(F.col("c.start_idx") - F.col("s.first_idx"), F.lit(0)).cast("int")
    part = F.slice("s.a", lo + 1, F.greatest((F.col("c.end_idx") - F.col("s.first_idx")).cast("int") - lo + 1, F.lit(0)))
    total = F.aggregate(part, F.lit(0.0), lambda x, y: x + y.cast("double"))
    return j.select("c.*", F.coalesce(F.array_max(part), F.lit(0.0)).cast("double").alias("peak"), F.coalesce(F.try_divide(total, F.size(part)), F.lit(0.0)).alias("mean"))


def frame_chunk(chunks: DataFrame, frames: DataFrame) -> DataFrame:
    """episode, t, chunk_id of each frame that lies in a chunk; of several the one with the largest id.

    The interval join is an equi-join: a chunk is spread over blocks of frames, and frames meet the
    chunks of their block only.
    """
    block = 256
    c = chunks.where("start_idx <= end_idx").select("episode", "chunk_id", "start_idx", "end_idx", F.explode(F.sequence(F.floor(F.col("start_idx") / block), F.floor(F.col("end_idx") / block))).alias("b"))
    f = frames.select("episode", "t", F.floor(F.col("t") / block).alias("b"))
    return f.join(c, ["episode", "b"]).where("t between start_idx and end_idx").groupBy("episode", "t").agg(F.max("chunk_id").alias("chunk_id"))


def sparse_anchors(spans: DataFrame, count: int, size: int) -> DataFrame:
    """episode, t, chunk: up to ``count`` evenly spread frames and the fixed-width chunk each falls into; a last chunk of one frame joins the one before.

    spans: episode, n.
    """
    k = F.least(F.col("n"), F.lit(count))
    at = F.when(k <= 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint") - 1), lambda i: F.floor(i * (F.col("n") - 1) / (k - 1)))))
    chunks = F.ceil(F.col("n") / size)
    last = chunks - 1 - F.when((F.col("n") % size == 1) & (chunks > 1), 1).otherwise(0)
    return spans.where("n > 0").select("episode", F.explode(at).alias("t"), last.alias("l")).select("episode", "t", F.least(F.floor(F.col("t") / size), F.col("l")).alias("chunk"))
