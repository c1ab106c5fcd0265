"""Spikes, stuck values and impossible readings, by a hidden Markov model per source.

The states are normal, spike, stuck and out of range; a hard bound is an observation that only the last can
give. A reading's evidence is

* ``u``: how far it stands from both neighbours, or, in a run of readings between two leaps, from the
  readings on both sides of the run, in units of the source's 99th percentile of steps to the nearer
  neighbour (a step over hidden readings is divided by the root of the frames it spans),
* ``same``: whether it repeats the reading before it exactly,
* ``out``: whether it breaks a hard bound.

Each source has its own scales, tail, depth bound and transitions, all from mergeable sums over all its rows
(histograms of logarithms, then the expected transitions of a Baum-Welch round): one small row per task and
source, so neither a hot source nor the number of rows matters. Forward-backward with the fitted model
then gives each reading's probability of being a spike or stuck; a hard bound decides alone.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, LOW, HIGH = 4000, -30.0, 50.0  # natural logarithms; a bin is 2 % wide
NORMAL, SPIKE, STUCK, OUT = 0, 1, 2, 3
NEVER = -60.0  # log chance of an observation that a state cannot give


@dataclass(frozen=True)
class Prior:
    """What is taken to hold before a source's own readings are counted, worth ``weight`` readings of it."""

    spike: float = 1e-5  # chance that a normal reading is followed by a spike
    spike_stay: float = 0.05
    stuck: float = 1e-6
    stuck_stay: float = 0.9
    out: float = 1e-5
    out_stay: float = 0.05
    weight: float = 1e5
    spike_from: float = 2.5  # no spike is nearer, in units of the 99th percentile of steps
    stuck_break: float = 1e-3  # chance that a stuck run is interrupted by a normal reading
    decades: float = 12.0  # spikes are log-uniform over this many natural logarithms
    decide: float = 0.5  # a stuck reading from this probability on
    decide_spike: float = 0.999
    depth_reach: float = 100.0  # a depth is impossible from so many times the source's 99.9th percentile on
    least_depth: float = 10.0  # metres, where a source's depths are all zero or too few

    def transitions(self) -> np.ndarray:
        rows = [(self.spike, self.stuck, self.out), (self.spike_stay, self.stuck, self.out), (self.spike, self.stuck_stay, self.out), (self.spike, self.stuck, self.out_stay)]
        return np.array([(1 - sum(r), *r) for r in rows])


@dataclass
class Source:
    """The fitted parameters of one source."""

    step: float = float("nan")  # 99th percentile of steps in the image
    depth_step: float = float("nan")
    repeat: float = 0.0  # share of readings that repeat the one before
    tail: float = 4.6  # rate of the exponential tail of normal steps, per unit of the 99th percentile
    depth_limit: float = float("inf")
    a: np.ndarray | None = None  # transitions between the four states; the first row is also where chains begin


def log_histogram(x: np.ndarray) -> np.ndarray:
    """Counts per logarithmic bin of the positive values; zeros fall into the first bin."""
    with np.errstate(divide="ignore"):
        k = np.floor((np.log(x) - LOW) / (HIGH - LOW) * BINS)
    return np.bincount(np.clip(np.nan_to_num(k, neginf=0, posinf=BINS - 1), 0, BINS - 1).astype(np.int64), minlength=BINS)


def histogram_quantile(counts: np.ndarray, q: float) -> float:
    """Upper edge of the bin that holds the quantile of the values that are not zero; nan without any."""
    c = np.asarray(counts, dtype=np.float64).copy()
    c[0] = 0
    if c.sum() == 0:
        return float("nan")
    k = int(np.searchsorted(np.cumsum(c), q * c.sum()))
    return float(np.exp(LOW + (min(k, BINS - 1) + 1) * (HIGH - LOW) / BINS))


def forward_backward(e: np.ndarray, valid: np.ndarray, a: np.ndarray, counts: bool = False):
    """Probability of each state at each reading, and on demand the expected number of each transition.

    e: (rows, steps, states) likelihoods. valid: (rows, steps), a prefix of each row. Chains begin as after a
    normal reading. Zeros where not valid.
    """
    n, T, k = e.shape
    f = np.zeros((n, T, k))
    b = np.ones((n, T, k))
    at = a[NORMAL][None, :] * e[:, 0]
    f[:, 0] = at / np.maximum(at.sum(1, keepdims=True), 1e-300)
    for t in range(1, T):
        at = (f[:, t - 1] @ a) * e[:, t]
        f[:, t] = at / np.maximum(at.sum(1, keepdims=True), 1e-300)
    for t in range(T - 2, -1, -1):
        back = (e[:, t + 1] * b[:, t + 1]) @ a.T
        back /= np.maximum(back.sum(1, keepdims=True), 1e-300)
        b[:, t] = np.where(valid[:, t + 1][:, None], back, 1.0)
    g = f * b
    g /= np.maximum(g.sum(-1, keepdims=True), 1e-300)
    g *= valid[..., None]
    if not counts:
        return g
    total = np.zeros((k, k))
    if T > 1:
        xi = f[:, :-1, :, None] * a[None, None] * (e[:, 1:] * b[:, 1:])[:, :, None, :]
        xi /= np.maximum(xi.sum((-1, -2), keepdims=True), 1e-300)
        total += (xi * valid[:, 1:, None, None]).sum((0, 1))
    total[NORMAL] += g[:, 0].sum(0)
    return g, total


def likelihoods(normal: np.ndarray, spike: np.ndarray, same: np.ndarray, out: np.ndarray, repeat: float, m: Prior) -> np.ndarray:
    """Of the four states, from the log densities of a normal reading and of a spike, exact repeats and broken bounds."""
    again = min(max(repeat, 1e-4), 0.5)
    stuck = normal + np.where(same, 0.0, np.log(m.stuck_break))
    normal = normal + np.log(np.where(same, again, 1 - again))
    spike = spike + np.log(np.where(same, 1e-4, 1 - 1e-4))
    e = np.stack([normal, spike, stuck, np.full(normal.shape, NEVER)], -1)
    e[out] = [NEVER, NEVER, NEVER, 0.0]
    return np.exp(np.clip(e, -200, 0))


def step_likelihoods(u: np.ndarray, same: np.ndarray, out: np.ndarray, src: Source, m: Prior) -> np.ndarray:
    """For steps in units of the source's 99th percentile: a flat body, an exponential tail, log-uniform spikes."""
    u = np.where(out, 0, u)
    normal = np.where(u <= 1, np.log(0.99), np.log(0.01 * src.tail) - src.tail * (u - 1))
    spike = np.where(u > m.spike_from, -np.log(np.maximum(u, 1) * m.decades), -40.0)
    return likelihoods(normal, spike, same, out, src.repeat, m)


def telling(u: np.ndarray, same: np.ndarray, out: np.ndarray, m: Prior) -> np.ndarray:
    """Rows with a reading that may be anything but normal; in all others every reading is, whatever the parameters."""
    return ((u > m.spike_from) | same | out).any(1)


# Trajectories -------------------------------------------------------------------------------------


def trajectory_evidence(p: np.ndarray, t: np.ndarray, depth_limit: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Steps in the image and in depth (per reading: the smaller of both neighbours), repeats and hard-bound breaks. depth_limit: one for all, or one a row."""
    valid = t >= 0
    out = valid & (~np.isfinite(p).all(-1) | (p[..., 2] <= 0) | (np.abs(p[..., 2]) >= np.reshape(depth_limit, (-1, 1))))
    usable = valid & ~out
    q = np.where(usable[..., None], p, np.nan)
    with np.errstate(invalid="ignore"):
        gap = np.sqrt(np.maximum(np.diff(t, axis=1), 1).astype(np.float64))
        both = usable[:, 1:] & usable[:, :-1]
        sxy = np.where(both, np.hypot(q[:, 1:, 0] - q[:, :-1, 0], q[:, 1:, 1] - q[:, :-1, 1]) / gap, np.nan)
        sz = np.where(both, np.abs(q[:, 1:, 2] - q[:, :-1, 2]) / gap, np.nan)
    same = np.zeros(t.shape, bool)
    same[:, 1:] = both & (np.diff(t, axis=1) == 1) & (sxy == 0) & (sz == 0)

    def isolated(s: np.ndarray) -> np.ndarray:
        none = np.full((len(s), 1), np.nan)
        return np.nan_to_num(np.fmin(np.hstack([none, s]), np.hstack([s, none])), nan=0.0)

    return isolated(sxy), isolated(sz), same, out


def run_evidence(p: np.ndarray, t: np.ndarray, usable: np.ndarray, qxy: float, qz: float, leap: float) -> np.ndarray:
    """Distance of each reading in a run of two or more bad readings from those on both sides of the run; 0 elsewhere.

    A run lies between two leaps of more than ``leap`` units, of any length up to half of the readings, and
    what stands on both sides is nearer to each other than half the smaller leap, else the track has moved.
    Shorter runs go first; their readings are no sides of longer ones. Only rows with two leaps are looked at.
    """
    order = np.argsort(~usable, axis=1, kind="stable")  # usable readings to the left
    n = usable.sum(1)
    P, T = np.take_along_axis(p, order[..., None], 1).astype(np.float64), np.take_along_axis(t, order, 1)
    per = np.array([1 / qxy if qxy == qxy else 0.0, 1 / qz if qz == qz else 0.0])

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = a - b
        return np.maximum(np.hypot(d[..., 0], d[..., 1]) * per[0], np.abs(d[..., 2]) * per[1])

    with np.errstate(invalid="ignore"):
        step = apart(P[:, 1:], P[:, :-1]) / np.sqrt(np.maximum(np.diff(T, axis=1), 1))
    leaps = (step > leap) & (np.arange(1, P.shape[1])[None] < n[:, None])
    u = np.zeros(t.shape)
    for r in np.flatnonzero(leaps.sum(1) > 1):
        at, x, when = np.flatnonzero(leaps[r]), P[r], T[r]
        bad = np.zeros(len(x), bool)
        for a, b in sorted(((a, b) for i, a in enumerate(at) for b in at[i + 1 :] if 2 * (b - a) <= n[r]), key=lambda ab: (ab[1] - ab[0], ab[0])):
            if bad[a] or bad[b + 1]:
                continue
            run = np.arange(a + 1, b + 1)
            if len(run) == 1:  # its step to both neighbours tells already
                bad[run] = True
            elif apart(x[a], x[b + 1]) <= min(step[r, a], step[r, b]) / 2:
                far = np.minimum(apart(x[run], x[a]) / np.sqrt(when[run] - when[a]), apart(x[run], x[b + 1]) / np.sqrt(when[b + 1] - when[run]))
                u[r, order[r, run]] = np.maximum(u[r, order[r, run]], far)
                bad[run[far > leap]] = True
    return u


def _arrow_points(raw, flags) -> tuple[np.ndarray, np.ndarray]:
    """(rows, steps, 3) points, left-aligned at the steps flagged valid, and their step numbers (-1 beyond).

    Null lists, structs, coordinates and flags are no readings.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    raw, flags = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (raw, flags))
    n = len(raw)
    length = np.minimum(*(np.asarray(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False), np.int64) for c in (raw, flags)))
    T = int(max(1, length.max() if n else 1))
    xyz, ok = np.full((n, T, 3), np.nan), np.zeros((n, T), bool)
    row = np.repeat(np.arange(n), length)
    step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)

    def flat(c):
        start = np.asarray(c.offsets.to_numpy(), np.int64)[:-1]
        take = np.repeat(start, length) + step
        return c.values.take(pa.array(take))

    pts, flag = flat(raw), flat(flags)
    use = np.asarray(pc.fill_null(flag, False).to_numpy(zero_copy_only=False), bool) & np.asarray(pc.is_valid(pts).to_numpy(zero_copy_only=False), bool)
    for k, c in enumerate("xyz"):
        v = pc.struct_field(pts, c)
        use &= np.asarray(pc.is_valid(v).to_numpy(zero_copy_only=False), bool)
        xyz[row, step, k] = np.asarray(pc.fill_null(v, float("nan")).to_numpy(zero_copy_only=False), np.float64)
    ok[row, step] = use
    order = np.argsort(~ok, axis=1, kind="stable")
    kept = np.take_along_axis(ok, order, 1)
    p = np.where(kept[..., None], np.take_along_axis(xyz, order[..., None], 1), np.nan)
    t = np.where(kept, order, -1)
    width = max(1, int(kept.sum(1).max()) if n else 1)
    return p[:, :width], t[:, :width]


def _by_source(b) -> list[tuple]:
    """(source, rows) of an Arrow batch."""
    src = np.array(b.column("s").to_pylist(), dtype=object)
    return [(s, src == s) for s in set(src.tolist())]


def _summed(samples: DataFrame, source: str, partial) -> dict:
    """Per source the sums of the vectors that ``partial(p, t, source)`` gives for parts of its rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict = {}
        for b in batches:
            p, t = _arrow_points(b.column("p"), b.column("v"))
            for s, m in _by_source(b):
                total[s] = total.get(s, 0) + partial(p[m], t[m], s)
        # One row per source and non-empty cell, summed by Spark.
        rows = [(s, int(k), float(h[k])) for s, h in total.items() for k in np.flatnonzero(h)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64())], names=["s", "k", "n"])

    cells = samples.select(F.col(source).cast("string").alias("s"), F.col("raw_traj").alias("p"), F.col("raw_valid_steps").alias("v")).mapInArrow(run, "s string, k int, n double")
    out: dict = {}
    for r in cells.groupBy("s", "k").agg(F.sum("n").alias("n")).orderBy("s", "k").toLocalIterator():  # sources x cells
        out.setdefault(r.s, {})[r.k] = r.n
    return out


def fit_sources(samples: DataFrame, source: str, prior: Prior = Prior()) -> dict[str | None, Source]:
    """The model of each source, from all its readings.

    First the scales: 99th percentiles and tails of steps in the image and in depth, the share of repeats, the
    depth from which on a reading is impossible. Then one round of Baum-Welch: with the prior's transitions,
    forward-backward gives the expected number of each transition between normal, spike, stuck and out of
    range; their sums over the source, with the prior as ``weight`` more readings, are its own transitions.
    Both are sums, so a hot source costs one small row per task.
    """

    def scales(p: np.ndarray, t: np.ndarray, _) -> np.ndarray:
        xy, z, same, out = trajectory_evidence(p, t, np.inf)
        use = (t >= 0) & ~out
        return np.concatenate([log_histogram(xy[use]), log_histogram(z[use]), log_histogram(p[..., 2][use]), [same[use].sum(), use.sum()]])

    fitted: dict[str | None, Source] = {}
    for s, cells in _summed(samples, source, scales).items():
        h = np.zeros(3 * BINS + 2)
        h[list(cells)] = list(cells.values())
        xy, z, depth = h[:BINS], h[BINS : 2 * BINS], h[2 * BINS : 3 * BINS]
        q = histogram_quantile(xy, 0.99)
        beyond = histogram_quantile(xy, 0.999) / q - 1 if q == q else float("nan")
        tail = float(np.clip(np.log(10) / beyond, 1.0, 20.0)) if beyond > 0 else 4.6
        top = histogram_quantile(depth, 0.999)
        fitted[s] = Source(q, histogram_quantile(z, 0.99), float(h[-2] / max(h[-1], 1)), tail, prior.depth_reach * max(top, prior.least_depth / prior.depth_reach) if top == top else prior.least_depth)

    a0 = prior.transitions()

    def counts(p: np.ndarray, t: np.ndarray, s) -> np.ndarray:
        u, same, out = evidence(p, t, fitted.get(s) or Source(), prior)
        tell = telling(u, same, out, prior)
        valid = t >= 0
        total = np.zeros((4, 4))
        total[NORMAL, NORMAL] += valid[~tell].sum()
        if tell.any():
            e = step_likelihoods(u[tell], same[tell], out[tell], fitted.get(s) or Source(), prior)
            total += forward_backward(e, valid[tell], a0, counts=True)[1]
        return total.ravel()

    for s, cells in _summed(samples, source, counts).items():
        n = np.zeros(16)
        n[list(cells)] = list(cells.values())
        n = n.reshape(4, 4)
        # The rare rows of the prior weigh as little as their states are rare.
        weight = prior.weight * np.array([1.0, 1e-3, 1e-3, 1e-3])[:, None]
        fitted.setdefault(s, Source()).a = (n + weight * a0) / (n.sum(1, keepdims=True) + weight)
    for src in fitted.values():
        src.a = a0 if src.a is None else src.a
    return fitted


def evidence(p: np.ndarray, t: np.ndarray, src: Source, prior: Prior) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each reading of one source: the step in units of its 99th percentiles, exact repeats and broken bounds."""
    xy, z, same, out = trajectory_evidence(p, t, src.depth_limit)
    unit = lambda x, q: x / q if q == q else 0 * x
    u = np.fmax(unit(xy, src.step), unit(z, src.depth_step))
    return np.maximum(u, run_evidence(p, t, (t >= 0) & ~out, src.step, src.depth_step, prior.spike_from)), same, out


def flag_trajectories(samples: DataFrame, ident: str = "sample_id", video: str = "video_id", source: str = "dataset", prior: Prior = Prior(), fitted: dict | None = None) -> DataFrame:
    """Flags of each sample: ``video, ident, impossible, spike, stuck`` (counts of readings) and ``p_spike, p_stuck``.

    Only steps flagged valid count. Impossible: not finite, depth not above 0, or over a hundred times the
    source's 99.9th percentile of depths. A spike stands far from both neighbours (from its only neighbour at an end)
    in the image or in depth; a step across hidden readings is judged by the root of the frames it spans.
    A run of readings that leap away and come back is a run of spikes; one that never comes back is a move. Stuck: a run in which
    all three coordinates repeat exactly, longer than the source's own repeats explain. Null lists,
    structs, flags and coordinates are no readings; a sample without readings has zero counts; a null
    source is a source of its own. Repeated rows are each flagged. An empty table gives an empty result.
    fitted: models of fit_sources(), fitted here when not given.
    """
    fitted = fit_sources(samples, source, prior) if fitted is None else fitted

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            n = b.num_rows
            p, t = _arrow_points(b.column("p"), b.column("v"))
            ps, pk, bad = np.zeros(t.shape), np.zeros(t.shape), np.zeros(t.shape, bool)
            for s, m in _by_source(b):
                src = fitted.get(s) or Source(a=prior.transitions())  # a source without readings
                u, same, out = evidence(p[m], t[m], src, prior)
                bad[m] = out
                tell = telling(u, same, out, prior)
                rows = np.flatnonzero(m)[tell]
                if len(rows):
                    g = forward_backward(step_likelihoods(u[tell], same[tell], out[tell], src, prior), t[rows] >= 0, src.a)
                    ps[rows], pk[rows] = g[..., SPIKE], g[..., STUCK]
            counts = [x.sum(1).astype(np.int32) for x in (bad, ps > prior.decide_spike, pk > prior.decide)]
            yield pa.RecordBatch.from_arrays(
                [b.column("video"), b.column("id"), *(pa.array(c) for c in counts), *(pa.array(x.max(1) if n else np.zeros(0)) for x in (ps, pk))],
                names=[video, ident, "impossible", "spike", "stuck", "p_spike", "p_stuck"],
            )

    kind = samples.schema[ident].dataType.simpleString()
    return samples.select(F.col(video).alias("video"), F.col(ident).alias("id"), F.col(source).cast("string").alias("s"), F.col("raw_traj").alias("p"), F.col("raw_valid_steps").alias("v")).mapInArrow(
        score, f"`{video}` string, `{ident}` {kind}, impossible int, spike int, stuck int, p_spike double, p_stuck double"
    )


# Series of scalars in blocks ----------------------------------------------------------------------


@dataclass
class PeakSource:
    """ln(peak) of one source: a normal curve, and spikes above it, log-uniform."""

    middle: float
    spread: float  # as fitted to the tail, never narrower than the middle half says
    spike: float  # share of spikes


def fit_peaks(chunks: DataFrame, source: str, prior: Prior = Prior(), rounds: int = 30) -> dict[str | None, PeakSource]:
    """Per source, from a histogram of ln(peak) over all rows that Spark alone computes.

    Middle and spread come from the quartiles, the spread widened where the 99.9th percentile lies further out than a
    normal curve's; the share of spikes by expectation maximisation over the bins, with the prior as 1,000 more rows.
    """
    x = F.col("peak_acceleration").cast("double")
    usable = x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < 1e30)
    k = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.log(F.when(usable, x)) - LOW) / ((HIGH - LOW) / BINS)).cast("int")))
    rows = chunks.where(usable).groupBy(F.col(source).cast("string").alias("s"), k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out: dict = {}
    for r in rows.toLocalIterator():  # sources x bins
        out.setdefault(r.s, np.zeros(BINS, np.int64))[r.k] += r.n
    width = (HIGH - LOW) / BINS
    at = LOW + (np.arange(BINS) + 0.5) * width
    fitted = {}
    for s, h in out.items():
        c = np.cumsum(h)
        q = lambda f: at[int(np.searchsorted(c, f * c[-1]))]  # noqa: B023, E731
        middle = q(0.5)
        core = max((q(0.75) - q(0.25)) / 1.349, width)
        # Of the upper tail without what cannot be normal.
        normal = np.where(at < middle + 6 * core, h, 0)
        tail = at[int(np.searchsorted(np.cumsum(normal), 0.999 * normal.sum()))] - middle
        spread = max(core, tail / 3.09)
        share = prior.spike
        body = -((at - middle) ** 2) / (2 * spread**2) - np.log(spread * np.sqrt(2 * np.pi))
        apart = np.where(at > middle, -np.log(prior.decades), NEVER)
        for _ in range(rounds):
            odds = np.log(share) + apart - np.log1p(-share) - body
            p = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
            share = float((p @ h + 1000 * prior.spike) / (h.sum() + 1000))
        fitted[s] = PeakSource(float(middle), float(spread), share)
    return fitted


def flag_peaks(chunks: DataFrame, source: str = "dataset", repeat: float = 0.01, block: int = 4096, halo: int = 64, prior: Prior = Prior(stuck_stay=0.95)) -> DataFrame:
    """Flags of each chunk's peak: ``video_id, chunk_id, impossible, spike, stuck``.

    chunks holds one row per (video_id, chunk_id). Impossible: not finite, 1e30 or more, negative, or
    below the chunk's own mean. Spike: the posterior of the spike state passes ``prior.decide_spike``, given the
    source's own curve of ln(peak) and share of spikes. Stuck: one value over chunks in a
    row; chunks that share frames with those counted before repeat their peak by right and do not
    count. ``repeat`` is the chance that two normal neighbours agree; with it, four chunks apart in a
    row pass. Null peaks are skipped: no case, and no end of a run. A null source is a source of its
    own; chunks without an id stand at the start of their recording. An empty table gives an empty
    result.

    The chunks of a recording are cut into blocks of ``block`` ids with a halo of ``halo`` ids on both
    sides, so that a long recording spreads over many tasks. A run longer than the halo is still found,
    as each block sees at least ``halo`` of it.
    """
    fitted = fit_peaks(chunks, source, prior)
    cid = F.coalesce(F.col("chunk_id").cast("bigint"), F.lit(-1))
    blk = F.floor(cid / block)
    lo, hi = F.floor((cid - halo) / block), F.floor((cid + halo) / block)
    p = F.col("peak_acceleration").cast("double")
    rows = (
        chunks.where(p.isNotNull())
        .select(
            "video_id", "chunk_id", cid.alias("c"), F.col("start_idx").cast("double").alias("a"), F.col("end_idx").cast("double").alias("e"),
            p.alias("p"), F.col("mean_acceleration").cast("double").alias("m"), F.col(source).cast("string").alias("s"),
            blk.alias("own"), F.explode(F.array_distinct(F.array(lo, blk, hi))).alias("b"),
        )
        .withColumn("own", F.col("own") == F.col("b"))
        .withColumn("g", F.xxhash64(F.col("video_id").isNull(), "video_id", "b"))
        .repartition("g")
        .sortWithinPartitions("g", "c")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            last = pdf["g"].iloc[-1]
            if sum(map(len, held)) >= 20_000 and held[0]["g"].iloc[0] != last:
                all_ = pd.concat(held, ignore_index=True)
                whole = all_["g"] != last
                yield _score(all_[whole].reset_index(drop=True), fitted, prior, repeat)
                held = [all_[~whole]]
        if held:
            yield _score(pd.concat(held, ignore_index=True), fitted, prior, repeat)

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"video_id string, chunk_id {kind}, impossible boolean, spike boolean, stuck boolean")


def _score(g: pd.DataFrame, fitted: dict, prior: Prior, repeat: float) -> pd.DataFrame:
    """Flags of whole groups (column g), each sorted by chunk; all groups at once."""
    p, m, a, e = (g[c].to_numpy(np.float64) for c in ("p", "m", "a", "e"))
    grp = g["g"].to_numpy()
    with np.errstate(invalid="ignore", divide="ignore"):
        bad = ~np.isfinite(p) | (p >= 1e30) | (p < 0) | (p < m * (1 - 1e-6))
        kinds, which = np.unique(g["s"].fillna("\0").to_numpy(str), return_inverse=True)
        none = PeakSource(np.nan, 1.0, prior.spike)
        of = [fitted.get(None if k == "\0" else k, none) for k in kinds]
        middle, spread = (np.array([getattr(x, c) for x in of])[which] for c in ("middle", "spread"))
        z = np.nan_to_num((np.log(np.where(p > 0, p, np.nan)) - middle) / spread, nan=0.0)
        # In units of the source's spread.
        normal = -(np.minimum(np.abs(z), 1e3) ** 2) / 2 - np.log(np.sqrt(2 * np.pi))
        lifted = np.where(z > 0, np.log(spread / prior.decades), NEVER)
        top = np.maximum(normal, lifted)
        normal, lifted = normal - top, lifted - top
    spike, stuck = np.zeros(len(g), bool), np.zeros(len(g), bool)
    rows = np.flatnonzero(~bad)
    if len(rows):
        q, h = p[rows], grp[rows]
        again = np.r_[False, (q[1:] == q[:-1]) & (h[1:] == h[:-1])]
        counts, run_of = ~_shares_frames(again, a[rows], e[rows]), np.cumsum(~again)
        apart = rows[counts]
        q, h, r = p[apart], grp[apart], run_of[counts]
        eq = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
        same = np.r_[False, eq] | np.r_[eq, False]
        e = likelihoods(normal[apart], lifted[apart], same, np.zeros(len(apart), bool), repeat, prior)
        post = np.zeros(e.shape)
        for i, x in enumerate(of):  # each source has its own share of spikes; a recording's rows of one source are one chain
            mine = which[apart] == i
            post[mine] = _by_length(e[mine], h[mine], replace(prior, spike=x.spike).transitions())
        spike[apart] = post[:, SPIKE] > prior.decide_spike
        stuck[apart] = (post[:, STUCK] > prior.decide) & same
        # Chunks left out of the chain share the fate of the run whose peak they repeat.
        run_stuck, run_spike = (np.bincount(r, x[apart], minlength=run_of.max() + 1) > 0 for x in (stuck, spike))
        left = rows[~counts]
        stuck[left], spike[left] = run_stuck[run_of[~counts]], run_spike[run_of[~counts]]
    out = g[["video_id", "chunk_id"]].assign(impossible=bad, spike=spike, stuck=stuck)
    return out[g["own"].to_numpy()]


def _shares_frames(again: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Of rows that repeat the value before them: whether they share frames with the rows of their run counted so far.

    Reversed bounds are swapped. A row with one bound is taken as that frame alone; a row without bounds counts
    as sharing, and none is held to share with it.
    """
    lo, hi = np.fmin(a, e), np.fmax(a, e)
    known = ~np.isnan(lo + hi)
    out = np.zeros(len(again), bool)
    starts = np.flatnonzero(~again)
    ends = np.r_[starts[1:], len(again)]
    for s, t in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
        seen: list[tuple[float, float]] = [(lo[s], hi[s])] if known[s] else []  # in order; none shares frames with another
        for i in range(s + 1, t):
            k = bisect_left(seen, (lo[i], hi[i])) if known[i] else 0
            if not known[i] or (k and seen[k - 1][1] >= lo[i]) or (k < len(seen) and seen[k][0] <= hi[i]):
                out[i] = True
            else:
                seen.insert(k, (lo[i], hi[i]))
    return out


def _by_length(e: np.ndarray, grp: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Posteriors of many chains of different lengths; chains of similar length are padded together."""
    post = np.zeros(e.shape)
    starts = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])
    length = np.diff(np.r_[starts, len(e)])
    size = np.ceil(np.log2(np.maximum(length, 2))).astype(int)
    for k in np.unique(size):
        pick = np.flatnonzero(size == k)
        at = starts[pick][:, None] + np.arange(1 << k)[None]
        valid = np.arange(1 << k)[None] < length[pick][:, None]
        at = np.where(valid, at, 0)
        got = forward_backward(np.where(valid[..., None], e[at], 1.0), valid, a)
        post[at[valid]] = got[valid]
    return post
