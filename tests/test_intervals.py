"""Interval runs against brute force over single units."""

import random

import pytest
from pyspark.sql import functions as F

from tracespark.operators.interval_runs import interval_runs

SCHEMA = "e string, s int, t int"


def brute(rows):
    out = set()
    by = {}
    for e, s, t in rows:
        if s is not None and t is not None and s <= t:
            by.setdefault(e, []).append((s, t))
    for e, iv in by.items():
        lo, hi = min(s for s, _ in iv), max(t for _, t in iv)
        depth = {x: sum(s <= x <= t for s, t in iv) for x in range(lo, hi + 1)}
        for kind, test in (("period", lambda d: d >= 1), ("overlap", lambda d: d >= 2), ("gap", lambda d: d == 0)):
            run = None
            for x in range(lo, hi + 2):
                if x <= hi and test(depth[x]):
                    run = (run[0], x) if run else (x, x)
                elif run:
                    out.add((e, kind, *run))
                    run = None
    return out


def got(df, shard):
    return {tuple(r) for r in interval_runs(df, ["e"], "s", "t", shard).collect()}


@pytest.mark.parametrize("shard", [64, 128, 1 << 18])
def test_random_intervals(spark, shard):
    r = random.Random(shard)
    rows = [(r.choice("ab"), a := r.randint(-300, 600), a + r.randint(-2, r.choice([14, 200]))) for _ in range(80)]
    assert got(spark.createDataFrame(rows, SCHEMA), shard) == brute(rows)


def test_gaps_over_empty_shards_and_runs_over_edges(spark):
    rows = [("a", 0, 63), ("a", 64, 129), ("a", 640, 641), ("a", 32, 150), ("b", 0, 400), ("b", 70, 90), ("c", 0, 400), ("c", 60, 330), ("c", 64, 191)]
    assert got(spark.createDataFrame(rows, SCHEMA), 64) == brute(rows)


def test_words_of_a_batch_of_any_size(spark, monkeypatch):
    r = random.Random(2)
    monkeypatch.setattr("tracespark.operators.interval_runs.WORDS_AT_ONCE", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    rows = [(r.choice("abc"), a := r.randint(0, 900), a + r.randint(0, 300)) for _ in range(50)] + [("a", 10, 20)] * 4
    try:
        assert got(spark.createDataFrame(rows, SCHEMA), 256) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_an_interval_over_the_whole_axis(spark):
    rows = [("a", 5, 2**31 - 2), ("a", 7, 9), ("a", 2**30, 2**30 + 70), ("b", 1, 2)]
    assert got(spark.createDataFrame(rows, SCHEMA), 1 << 18) == {("a", "period", 5, 2**31 - 2), ("a", "overlap", 7, 9), ("a", "overlap", 2**30, 2**30 + 70), ("b", "period", 1, 2)}


def test_nulls_reversed_repeats_and_clashing_columns(spark):
    rows = [(None, 1, 3), (None, 3, 5), ("a", None, 3), ("a", 3, None), ("a", 9, 2), ("b", 1, 1), ("b", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kind", F.lit("x")).withColumn("_s", F.lit(1)).withColumn("_at", F.lit(2)).withColumn("_shard", F.lit(3))
    assert got(df, 64) == {(None, "period", 1, 5), (None, "overlap", 3, 3), ("b", "period", 1, 1), ("b", "overlap", 1, 1)}


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA), 64) == set()
