"""Which episodes a run takes: allow-lists, ledgers, seeded order, sharding, pairing, names and samplers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracespark.runtime import in_order


def allow_listed(episodes: DataFrame, names: DataFrame, key: str = "episode") -> DataFrame:
    """Episodes on the list (column ``name``; blanks trimmed, empty lines ignored); an empty list admits none."""
    keep = names.select(F.trim("name").alias("_n")).where("_n <> ''").distinct()
    return episodes.join(keep, F.col(key) == F.col("_n"), "left_semi")


def still_to_do(episodes: DataFrame, ledger: DataFrame, threshold: float, key: str = "episode") -> DataFrame:
    """Episodes neither done nor rejected with a coverage below ``threshold``. ledger: episode, status, coverage."""
    settled = ledger.where((F.col("status") == "done") | ((F.col("status") == "low_coverage") & (F.col("coverage") < threshold))).select(F.col("episode").alias("_e")).distinct()
    return episodes.join(settled, F.col(key) == F.col("_e"), "left_anti")


def ledger_upsert(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """episode, status, coverage, at: the latest entry per episode of the old ledger and the new results."""
    both = ledger.select("episode", "status", "coverage", "at").unionByName(results.select("episode", "status", "coverage", "at"))
    return both.groupBy("episode").agg(F.max(F.struct("at", "status", "coverage")).alias("m")).select("episode", "m.status", "m.coverage", "m.at")


def run_summary(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n_episodes"))


def seeded_first(episodes: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """The first n episodes of a shuffle that depends on the seed and the key alone; adds its sort key ``order_key``."""
    k = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")))
    return episodes.select(key, k.alias("order_key")).orderBy("order_key", key).limit(n)


def shard_of(episodes: DataFrame, key: str, shard: int, shards: int) -> DataFrame:
    """The shard-th (from 1) of equal slices of the sorted keys."""
    pos = in_order(episodes.select(key).distinct(), [key])
    return pos.where(F.floor(F.col("_before") * shards / F.col("_all")) == shard - 1).select(key)


def positional_pairs(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """position, a_key, b_key: both sides sorted by key and paired by place, from 1; raises where the sizes differ."""
    x, y = (in_order(d.select(k), [k]).select(k, (F.col("_before") + 1).alias("position")) for d, k in ((a, a_key), (b, b_key)))
    j = x.join(y, "position", "full")
    whole = F.when(F.col(a_key).isNull() | F.col(b_key).isNull(), F.raise_error(F.lit("the two sides differ in size"))).otherwise(F.col("position"))
    return j.select(whole.cast("bigint").alias("position"), a_key, b_key)


def natural_key(name: Column) -> Column:
    """Sort key that orders runs of digits by value: each is padded to twenty places."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def _zeros(digits: Column, places: int) -> Column:
    """At least so many places; longer numbers stay whole."""
    return F.when(F.length(digits) >= places, digits).otherwise(F.lpad(digits, places, "0"))


def episode_name(dataset: Column, path: Column) -> Column:
    """The episode's name in its dataset's convention, from its path."""
    part = F.split(path, "/")
    return (
        F.when(dataset == "agibot", F.element_at(part, -2))
        .when(dataset == "droid", F.concat(F.lit("droid_shard"), _zeros(F.regexp_extract(path, r"shard-0*(\d+)", 1), 5), F.lit("_ep"), _zeros(F.regexp_extract(path, r"ep_?0*(\d+)", 1), 3)))
        .when(dataset == "egodex", F.concat_ws("__", F.element_at(part, -3), F.element_at(part, -2), F.regexp_replace(F.element_at(part, -1), r"\.\w+$", "")))
        .otherwise(F.regexp_replace(F.element_at(part, -1), r"\.\w+$", ""))
    )


def _digest(kind: str, seed: int | str, value: Column, hex_digits: int) -> Column:
    """The SHA-256 of a seeded value, as an array of numbers of ``hex_digits`` each, highest first."""
    h = F.sha2(F.concat(F.lit(f"{kind}_{seed}_"), value.cast("string")), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(64 // hex_digits - 1)), lambda i: F.conv(F.substring(h, i * hex_digits + 1, F.lit(hex_digits)), 16, 10).cast("bigint"))


def stable_unit(value: Column, seed: int | str = 0) -> Column:
    """A number in [0, 1] that depends on seed and value alone: the SHA-256 of ``hash_random_{seed}_{value}`` modulo 2**128 + 1, over 2**128.

    With the hash as h 2**128 + l that is l - h, plus 2**128 + 1 where it is negative, taken limb by limb. Null gives null.
    """
    d = _digest("hash_random", seed, value, 8)
    step = lambda a, k: _limb(a, F.get(a.d, F.lit(7) - k) - F.get(a.d, F.lit(3) - k), k)
    zero = F.struct(d.alias("d"), F.lit(0).cast("bigint").alias("borrow"), F.lit(0.0).alias("x"))
    end = F.aggregate(F.sequence(F.lit(0), F.lit(3)), zero, step)
    # A borrow at the end stands for 2**128: what was borrowed is 2**128, and one more is due.
    return F.when(value.isNotNull(), end.x + F.when(end.borrow > 0, F.lit(2.0**-128)).otherwise(0.0))


def _limb(a: Column, difference: Column, k: Column) -> Column:
    v = difference - a.borrow
    low = F.when(v < 0, v + (1 << 32)).otherwise(v)
    weight = F.pow(F.lit(2.0), (F.lit(32) * k - 128).cast("double"))
    return F.struct(a.d.alias("d"), F.when(v < 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("borrow"), (a.x + low.cast("double") * weight).alias("x"))


def stable_int(value: Column, start: int, end: int, seed: int | str = 0) -> Column:
    """An integer in [start, end) that depends on seed and value alone: the SHA-256 of ``hash_randint_{seed}_{value}`` modulo end - start."""
    if not 0 < end - start < 1 << 47:
        raise ValueError("start must be less than end, by less than 2**47")
    rest = F.aggregate(_digest("hash_randint", seed, value, 4), F.lit(0).cast("bigint"), lambda r, x: (r * 65536 + x) % (end - start))
    return F.when(value.isNotNull(), rest + start)


def weighted_choice(items: DataFrame, draws: DataFrame, item: str, weight: str, cells: int = 1024) -> DataFrame:
    """draw, item: for each draw (columns draw, u in [0, 1]) the first item, by key, whose cumulative weight reaches u times the total.

    Null and negative weights count as 0; an item of weight 0 is chosen only where the sum reaches u exactly
    before it, as at u = 0 for the first item. Rows of one item add up. Draws with a null u, and all
    draws of items without any weight, are left out. Items are spread over ``cells`` parts of [0, 1] that they cover,
    and draws meet the items of their part only.
    """
    w = items.groupBy(item).agg(F.sum(F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))).alias("_w"))
    c = in_order(w, [item], F.col("_w")).where("_all > 0").select(item, (F.col("_before") / F.col("_all") * cells).alias("_a"), ((F.col("_before") + F.col("_w")) / F.col("_all") * cells).alias("_b"), (F.col("_before") + F.col("_w")).alias("_reach"), "_all", "_before")
    cell = lambda x: F.least(F.lit(cells - 1), F.greatest(F.lit(0), F.floor(x)))
    # A margin of a cell on both sides, so that rounding loses no item; the exact test follows.
    c = c.withColumn("_cell", F.explode(F.sequence(cell(F.col("_a") - 0.5), cell(F.col("_b") + 0.5))))
    x = draws.where("u is not null").select("draw", "u", cell(F.col("u") * cells).alias("_cell")).join(c, "_cell").where("_reach >= u * _all")
    return x.groupBy("draw").agg(F.min_by(item, F.struct("_reach", "_before", item)).alias(item))
