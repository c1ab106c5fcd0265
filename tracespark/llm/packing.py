"""Containers of fixed capacity with little unused space, by a grouping genetic algorithm on islands.

Items are dealt by hash to blocks of bounded size, so every block sees about the corpus's mix of sizes.
Each block lives on several islands, each a task of its own: a small population whose individuals are
whole packings. Crossover injects well-filled containers of one parent into the other, removes the
containers that hold an injected item, and best-fits the displaced items; between epochs the elite of
an island migrates to the next. The best packing of a block keeps its well-filled containers; what lies
in the others is dealt again to fewer blocks, until one block is left.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespark.runtime import spread, stored

CAPACITY = 2048
BLOCK_ITEMS, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 1024, 4, 3, 12, 60
GOOD_FILL, LEAST_GAIN = 0.995, 0.001


def best_fit(order: list[int], size: list[int], capacity: int, bins: list[list[int]], free: list[int]) -> None:
    """Puts the items into the fullest container that takes them; opens new ones where none does."""
    room = sorted((f, i) for i, f in enumerate(free))
    for it in order:
        k = bisect_left(room, (size[it], -1))
        if k == len(room):
            bins.append([it])
            free.append(capacity - size[it])
            insort(room, (free[-1], len(bins) - 1))
        else:
            _, b = room.pop(k)
            bins[b].append(it)
            free[b] -= size[it]
            insort(room, (free[b], b))


def fitness(free: list[int], capacity: int) -> float:
    """Mean squared fill: fewer containers win, and of as many those with concentrated slack."""
    return float(np.mean([((capacity - f) / capacity) ** 2 for f in free])) if free else 1.0


def crossover(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """A child of a with well-filled containers of b: those that hold an injected item go, and their other items are put back."""
    fill = np.array([sum(size[i] for i in x) for x in b], float)
    n = max(1, int(len(b) * rng.uniform(0.1, 0.5)))
    pick = np.argsort(-(fill + rng.uniform(0, 0.02 * capacity, len(b))), kind="stable")[:n]
    injected = [list(b[i]) for i in pick]
    taken = {i for x in injected for i in x}
    child, loose = injected, []
    for x in a:
        if taken.isdisjoint(x):
            child.append(list(x))
        else:
            loose += [i for i in x if i not in taken]
    return refill(child, loose, size, capacity, rng)


def mutate(a: list[list[int]], size: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Dissolves the emptiest containers and some at random."""
    fill = np.array([sum(size[i] for i in x) for x in a], float)
    worst = set(np.argsort(fill, kind="stable")[:3].tolist()) | set(rng.integers(0, len(a), 4).tolist())
    return refill([list(x) for i, x in enumerate(a) if i not in worst], [it for i in worst for it in a[i]], size, capacity, rng)


def refill(bins: list[list[int]], loose: list[int], size: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Puts displaced items back: first in exchange for one or two smaller ones of a container that they fill better, then by best fit."""
    free = [capacity - sum(size[i] for i in x) for x in bins]
    out = sorted((size[i], i) for i in loose)
    for b in rng.permutation(len(bins)).tolist():
        if not free[b] or not out:
            continue
        x = bins[b]
        best = (0, 0, ())  # gain, place in out, what leaves the container
        for gone in [(i,) for i in x] + [(i, j) for k, i in enumerate(x) for j in x[k + 1 :]]:
            had = sum(size[i] for i in gone)
            k = bisect_left(out, (had + free[b] + 1, -1)) - 1
            if k >= 0 and out[k][0] - had > best[0]:
                best = (out[k][0] - had, k, gone)
        if best[0]:
            n, it = out.pop(best[1])
            bins[b] = [i for i in x if i not in best[2]] + [it]
            free[b] -= best[0]
            for i in best[2]:
                insort(out, (size[i], i))
    best_fit([i for _, i in reversed(out)], size, capacity, bins, free)
    return bins


def evolve(size: list[int], capacity: int, immigrants: list[list[list[int]]], rng: np.random.Generator, population: int = POPULATION, generations: int = GENERATIONS) -> list[list[int]]:
    """One epoch of one island: the best packing it found. Ends as soon as no packing could have fewer containers."""
    if not size:
        return []
    least = max(1, -(-sum(size) // capacity))
    score = lambda p: fitness([capacity - sum(size[i] for i in x) for x in p], capacity)
    pool = [(score(p), p) for p in immigrants]
    s = np.array(size, float)
    while len(pool) < population and not any(len(p) <= least for _, p in pool):
        noise = rng.normal(0, 0.0 if not pool else 0.05 * capacity, len(size))
        bins: list[list[int]] = []
        best_fit(np.argsort(-(s + noise), kind="stable").tolist(), size, capacity, bins, [])
        pool.append((score(bins), bins))
    pool.sort(key=lambda x: -x[0])
    for _ in range(generations):
        if len(pool[0][1]) <= least:
            break
        i, j = sorted(rng.integers(0, len(pool), 2).tolist())
        child = crossover(pool[i][1], pool[j][1], size, capacity, rng) if i != j else [list(x) for x in pool[i][1]]
        if i == j or rng.random() < 0.5:
            child = mutate(child, size, capacity, rng)
        f = score(child)
        if f > pool[-1][0] and all(abs(f - g) > 1e-12 for g, _ in pool):  # no twins
            pool[-1] = (f, child)
            pool.sort(key=lambda x: -x[0])
    return pool[0][1]


def _epoch(capacity: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for block, island, sizes, migrants in pdf[["block", "island", "sizes", "migrants"]].itertuples(index=False, name=None):
                size = [int(x) for x in sizes]
                immigrants = []
                for m in migrants if migrants is not None else []:
                    groups: dict[int, list[int]] = {}
                    for i, b in enumerate(m):
                        groups.setdefault(int(b), []).append(i)
                    immigrants.append(list(groups.values()))
                rng = np.random.default_rng([seed, int(block), int(island)])
                best = evolve(size, capacity, immigrants, rng)
                where = np.zeros(len(size), np.int32)
                for b, x in enumerate(best):
                    where[x] = b
                out.append((block, island, where, fitness([capacity - sum(size[i] for i in x) for x in best], capacity)))
            yield pd.DataFrame(out, columns=["block", "island", "placed", "fit"])

    return run


def pack(items: DataFrame, ident: str, size: str, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, good_fill: float = GOOD_FILL, least_gain: float = LEAST_GAIN) -> DataFrame:
    """``container_id, ident, part_no, first_unit, n_units``: every row of items in a container.

    An item larger than ``capacity`` is cut into full containers and a rest; all others stay whole in
    one container. Null or negative sizes count as 0; an item of size 0 lies in some container. Rows
    repeated under one ident are items of their own; a null ident is kept. An empty table gives an
    empty result. The same stored rows give the same packing. Containers filled less than ``good_fill`` are dealt again, as
    long as that could save a container and the last dealing saved ``least_gain`` of those it took apart.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = items.schema[ident].dataType.simpleString()
    n = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    rows = items.select(F.col(ident).alias("id"), n.alias("n"))
    full = F.floor(F.col("n") / capacity)
    rest = F.col("n") - full * capacity
    parts = F.sequence(F.lit(0), F.greatest(F.when(rest > 0, full).otherwise(full - 1), F.lit(0)).cast("int"))
    cut = rows.select("id", "n", F.explode(parts).alias("part")).select("id", "part", (F.col("part").cast("bigint") * capacity).alias("first"), F.least(F.col("n") - F.col("part").cast("bigint") * capacity, F.lit(capacity)).cast("int").alias("n"))
    # A stored table reads in a fixed order, so the row numbers below survive a lost task.
    all_ = stored(spread(cut), "items").withColumn("uid", F.monotonically_increasing_id())
    done = [all_.where(F.col("n") == capacity).select(F.concat(F.lit("full-"), F.col("uid").cast("string")).alias("container_id"), "id", "part", "first", "n")]
    open_ = all_.where(F.col("n") < capacity)
    left, before, level = open_.count(), None, 0
    while left:
        blocks = max(1, -(-left // block_items))
        packed = stored(_pack_level(open_, blocks, capacity, islands, epochs, level), "packed")
        marked = packed.withColumn("fill", F.sum("n").over(_by_container()))
        bins = marked.groupBy("container_id").agg(F.first("fill").alias("fill"), F.count(F.lit(1)).alias("k"))
        good = F.col("fill") >= good_fill * capacity
        # Containers now; items, fill and number of those that are dealt again.
        now = bins.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~good, F.col("k"))).alias("items"), F.sum(F.when(~good, F.col("fill"))).alias("used"), F.count_if(~good).alias("open")).first()
        spare = now.open - -(-(now.used or 0) // capacity)  # containers that dealing again could save at most
        saved = None if before is None else before - now.n
        if blocks == 1 or spare <= 0 or (saved is not None and saved < least_gain * before):
            done.append(packed.select("container_id", "id", "part", "first", "n"))
            break
        done.append(marked.where(good).select("container_id", "id", "part", "first", "n"))
        open_ = stored(marked.where(~good).select("id", "part", "first", "n", "uid"), "open")
        left, before, level = now.items, now.open, level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("container_id", F.col("id").cast(kind).alias(ident), F.col("part").alias("part_no"), F.col("first").alias("first_unit"), F.col("n").cast("bigint").alias("n_units"))


def _by_container():
    from pyspark.sql import Window

    return Window.partitionBy("container_id")  # a block's container: bounded by the block


def _pack_level(open_: DataFrame, blocks: int, capacity: int, islands: int, epochs: int, level: int) -> DataFrame:
    """One dealing: blocks of items on islands; only the places travel between epochs, and a block that meets the bound on an island is not searched again."""
    seed = 1000 * (level + 1)
    items = F.struct("uid", "n", "id", "part", "first")
    members = open_.select("id", "part", "first", "n", "uid", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)).alias("block"))
    world = stored(members.groupBy("block").agg(F.array_sort(F.collect_list(items)).alias("m")), "blocks")  # bounded by block_items
    sizes = world.select("block", F.col("m.n").alias("sizes"))
    schema = "block bigint, island int, placed array<int>, fit double"
    migrants = None
    for epoch in range(epochs):
        at = sizes.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
        if migrants is None:
            at = at.withColumn("migrants", F.lit(None).cast("array<array<int>>"))
        else:
            at = at.join(migrants, ["block", "island"])
        found = stored(spread(at.select("block", "island", "sizes", "migrants"), "block", "island").mapInPandas(_epoch(capacity, seed + epoch), schema), "epoch")
        best = found.groupBy("block").agg(F.max_by("placed", F.struct("fit", -F.col("island"))).alias("placed"))
        if epoch + 1 == epochs:
            break
        total = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, x: s + x)
        searched = best.join(sizes, "block").where(F.array_max("placed") + 1 > F.greatest(F.lit(1), F.ceil(total / capacity))).select("block")
        if not searched.limit(1).count():
            break
        # The elite stays on its island and migrates to the next; blocks at the bound send their best on unsearched.
        to = F.explode(F.array(F.col("island"), ((F.col("island") + 1) % islands).cast("int")))
        migrants = found.select("block", to.alias("at"), "placed").groupBy("block", F.col("at").alias("island")).agg(F.collect_list("placed").alias("migrants"))
    x = F.explode(F.arrays_zip("m", "placed"))
    name = F.concat_ws("-", F.lit(f"level{level}"), F.col("block").cast("string"), F.col("x.placed").cast("string"))
    return world.join(best, "block").select("block", x.alias("x")).select(name.alias("container_id"), "x.m.id", "x.m.part", "x.m.first", "x.m.n", "x.m.uid")
