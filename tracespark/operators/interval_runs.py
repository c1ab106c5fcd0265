"""Continuous periods, shared frames and gaps of intervals, by compressed bitmaps per entity and time shard.

An integer time axis is cut into shards of ``shard`` units. The bitmap of an (entity, shard) holds one bit per
unit in words of 64, and only the words that are set; a second plane holds the units set twice or more, and
a shard that one interval fills needs no words at all. Bitmaps are united word by word: what a word sets
that is set already goes to the second plane. Set and clear runs are read off the united words. Runs that
touch a shard's edge are stitched in a second pass that sees at most two runs per shard and kind; a 32-bit
axis has at most 2**32 / shard shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracespark.runtime import stored

SHARD = 1 << 18
WORDS_AT_ONCE = 1 << 20  # words that one step of a task unites
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
PERIOD, OVERLAP, GAP = "period", "overlap", "gap"


def interval_words(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of inclusive intervals [a, b]: for each word the interval's number, the word's and its bits. Reversed intervals have none."""
    first, last = a >> 6, b >> 6
    n = np.where(b >= a, last - first + 1, 0)
    row = np.repeat(np.arange(len(a)), n)
    w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]
    bits = np.full(len(w), ALL)
    low, high = (a[row] & 63).astype(np.uint64), (63 - (b[row] & 63)).astype(np.uint64)
    bits = np.where(w == first[row], bits & (ALL << low), bits)
    bits = np.where(w == last[row], bits & (ALL >> high), bits)
    return row, w, bits


def united(g: np.ndarray, w: np.ndarray, once: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One word per (group, word number), in order: the union of the words, and of what is set in two of them or twice in one."""
    if not len(g):
        return g, w, once, twice
    order = np.lexsort((once, w, g))
    g, w, once, twice = g[order], w[order], once[order], twice[order]
    # Equal words first: a word of 64 bits has at most 2,080 different runs, which bounds the steps below.
    new = np.r_[True, (g[1:] != g[:-1]) | (w[1:] != w[:-1]) | (once[1:] != once[:-1])]
    at = np.flatnonzero(new)
    several = np.diff(np.r_[at, len(g)]) > 1
    twice = np.bitwise_or.reduceat(twice, at) | np.where(several, once[at], np.uint64(0))
    g, w, once = g[at], w[at], once[at]
    new = np.r_[True, (g[1:] != g[:-1]) | (w[1:] != w[:-1])]
    at = np.flatnonzero(new)
    size = np.diff(np.r_[at, len(g)])
    a, b = once[at].copy(), twice[at].copy()
    for k in range(1, int(size.max())):
        has = size > k
        more, two = once[at[has] + k], twice[at[has] + k]
        b[has] |= two | (a[has] & more)
        a[has] |= more
    return g[at], w[at], a, b


def set_runs(g: np.ndarray, w: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs [first, end) of set bits of words in order, with their group; runs go on over words that follow each other."""
    keep = bits != 0
    g, w, bits = g[keep], w[keep], bits[keep]
    x = np.unpackbits(bits.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).astype(bool)
    follows = (g[1:] == g[:-1]) & (w[1:] == w[:-1] + 1)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[:, 1:], after[:, :-1] = x[:, :-1], x[:, 1:]
    before[1:, 0] = x[:-1, 63] & follows
    after[:-1, 63] = x[1:, 0] & follows
    r, c = np.nonzero(x & ~before)
    s, d = np.nonzero(x & ~after)
    return g[r], w[r] * 64 + c, w[s] * 64 + d + 1


def _bitmap_runs(shard: int, keys: list[str]):
    """Arrow kernel: rows (keys, _shard, a, b, many), sorted by keys and shard -> runs of each bitmap. Holds one bitmap between batches."""
    names = [*keys, "_shard"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        held, fills = empty, 0  # words of the group not yet over, and how many intervals fill its shard
        head = None  # that group's key

        def runs(table, first_of: np.ndarray, g, w, once, twice, fill: np.ndarray):
            """Output rows of whole groups; first_of: a row of ``table`` for each group."""
            full = fill > 0
            plain = ~full[g]
            parts = []
            pg, ps, pe = set_runs(g[plain], w[plain], once[plain])
            parts.append((PERIOD, pg, ps, pe))
            inner = (pg[1:] == pg[:-1]) if len(pg) else np.zeros(0, bool)
            parts.append((GAP, pg[1:][inner], pe[:-1][inner], ps[1:][inner]))
            parts.append((OVERLAP, *set_runs(g[plain], w[plain], twice[plain])))
            # In a shard filled once, all that is set otherwise is shared; filled twice, everything is.
            some = (fill == 1)[g]
            parts.append((OVERLAP, *set_runs(g[some], w[some], once[some])))
            for kind, which in ((PERIOD, np.flatnonzero(full)), (OVERLAP, np.flatnonzero(fill > 1))):
                parts.append((kind, which, np.zeros(len(which), np.int64), np.full(len(which), shard)))
            group = np.concatenate([p[1] for p in parts]).astype(np.int64)
            first, end = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (2, 3))
            kind = np.repeat(np.array([p[0] for p in parts]), [len(p[1]) for p in parts])
            rows = table.take(pa.array(first_of[group]))
            base = np.asarray(rows.column("_shard").to_numpy(), np.int64) * shard
            edge = (kind != GAP) & ((first == 0) | (end == shard))
            cols = [rows.column(c).combine_chunks() for c in names] + [pa.array(kind.astype(object), pa.string()), pa.array(base + first), pa.array(base + end), pa.array(edge)]
            return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c for c in cols], names=[*names, "kind", "_first", "_end", "_edge"])

        def pieces(batch):
            """Row ranges of bounded numbers of words."""
            a, b = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("a", "b"))
            n = np.cumsum(np.where((a == 0) & (b == shard - 1), 0, (b >> 6) - (a >> 6) + 1))
            at = 0
            while at < len(a):
                to = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + WORDS_AT_ONCE, side="right")))
                yield batch.slice(at, to - at), a[at:to], b[at:to]
                at = to

        for whole in batches:
            for batch, a, b in pieces(whole):
                many = np.asarray(batch.column("many").to_numpy(zero_copy_only=False), bool)
                table = pa.Table.from_batches([batch.select(names)])
                if head is not None:
                    table = pa.concat_tables([head, table])
                    a, b, many = np.r_[0, a], np.r_[-1, b], np.r_[False, many]
                changed = np.zeros(len(a), bool)
                changed[0] = True
                for c in names:
                    code = pc.dictionary_encode(table.column(c).combine_chunks())
                    code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
                    code = np.asarray(pc.fill_null(code.indices, -1).to_numpy(zero_copy_only=False))
                    changed[1:] |= code[1:] != code[:-1]
                first_of = np.flatnonzero(changed)
                group = np.cumsum(changed) - 1
                filling = (a == 0) & (b == shard - 1)
                fill = np.bincount(group[filling], np.where(many[filling], 2, 1), minlength=len(first_of)).astype(np.int64)
                fill[0] += fills
                row, w, bits = interval_words(np.where(filling, 0, a), np.where(filling, -1, b))
                double = np.where(many[row], bits, np.uint64(0))
                g, w, once, twice = united(np.r_[np.zeros(len(held[0]), np.int64), group[row]], np.r_[held[0], w], np.r_[held[1], bits], np.r_[held[2], double])
                last = len(first_of) - 1
                done = g < last
                if last > 0:
                    yield runs(table, first_of[:last], g[done], w[done], once[done], twice[done], fill[:last])
                held, fills = (w[~done], once[~done], twice[~done]), min(int(fill[last]), 2)
                head = table.slice(int(first_of[last]), 1)
        if head is not None:
            yield runs(head, np.zeros(1, np.int64), np.zeros(len(held[0]), np.int64), *held, np.array([fills]))

    return run


def interval_runs(intervals: DataFrame, entity: list[str], start: str, end: str, shard: int = SHARD) -> DataFrame:
    """Runs of inclusive integer intervals per entity.

    Returns ``entity..., kind, first_idx, last_idx`` with kind

    * ``period``: longest run of units covered at least once,
    * ``overlap``: longest run covered by two or more intervals,
    * ``gap``: longest run of uncovered units between the entity's first and last covered unit.

    Rows with a null or reversed bound are left out; a null entity part is an entity of its own.
    Repeated rows count as often as they occur (deduplicate before if they must not). An empty table
    gives an empty result. Other columns are ignored. shard is a multiple of 64. An interval far longer than the
    others costs one row per shard it covers.
    """
    if shard % 64:
        raise ValueError("shard must be a multiple of 64")
    key = [f"_e{i}" for i in range(len(entity))]
    s, e = F.col("_s"), F.col("_t")
    iv = (
        intervals.select(*[F.col(c).alias(k) for c, k in zip(entity, key)], F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_t"))
        .where(s.isNotNull() & e.isNotNull() & (s <= e))
        .groupBy(*key, "_s", "_t")
        .agg((F.count(F.lit(1)) > 1).alias("many"))
    )
    lo = lambda c: F.floor(c / F.lit(shard)).cast("bigint")
    base = F.col("_shard") * shard
    cut = iv.select(*key, "_s", "_t", "many", F.explode(F.sequence(lo(s), lo(e))).alias("_shard"))
    rows = cut.select(*key, "_shard", (F.greatest(s, base) - base).alias("a"), (F.least(e, base + (shard - 1)) - base).alias("b"), "many").repartition(*[F.col(k) for k in key], "_shard").sortWithinPartitions(*key, "_shard")
    kinds = ", ".join(f"{k} {intervals.schema[c].dataType.simpleString()}" for c, k in zip(entity, key))
    inner = stored(rows.mapInArrow(_bitmap_runs(shard, key), f"{kinds}, _shard bigint, kind string, _first bigint, _end bigint, _edge boolean"), "runs")
    # Second pass: only runs at a shard's edge can continue in the next shard.
    at_edge = inner.where("_edge").select(*key, "kind", F.col("_first").alias("_at"), F.col("_end").alias("_next"))
    whole = _joined(at_edge, [*key, "kind"], Window.partitionBy(*key, "kind").orderBy("_at"))
    # Gaps over a shard's edge lie between what two following shards cover.
    covered = inner.where("kind = 'period'").groupBy(*key, "_shard").agg(F.min("_first").alias("_lo"), F.max("_end").alias("_hi"))
    between = (
        covered.withColumn("_then", F.lead("_lo").over(Window.partitionBy(*key).orderBy("_shard")))
        .where("_then > _hi")
        .select(*key, F.lit(GAP).alias("kind"), F.col("_hi").alias("_first"), F.col("_then").alias("_end"))
    )
    cols = [*key, "kind", "_first", "_end"]
    runs = inner.where("not _edge").select(cols).unionByName(whole.select(cols)).unionByName(between.select(cols))
    kind_of = intervals.schema[start].dataType
    return runs.select(*[F.col(k).alias(c) for k, c in zip(key, entity)], "kind", F.col("_first").cast(kind_of).alias("first_idx"), (F.col("_end") - 1).cast(kind_of).alias("last_idx"))


def _joined(pieces: DataFrame, by: list[str], w) -> DataFrame:
    """Joins pieces [_at, _next) that touch into runs [_first, _end); pieces of a group never overlap."""
    begins = F.when(F.lag("_next").over(w) == F.col("_at"), 0).otherwise(1)
    numbered = pieces.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_run").agg(F.min("_at").alias("_first"), F.max("_next").alias("_end"))
