"""Compaction: every block once, the journal consistent, reruns without effect."""

import pytest
from pyspark.sql import functions as F

from tracespark.operators.compaction import MADE, Compaction, compact, merge_plan

SCHEMA = "file_id bigint, video_id string, frame_indices array<int>, offsets array<bigint>, keypoints array<struct<x:float,y:float>>, n_bytes bigint"
P = [(1.0, 2.0), (3.0, 4.0), (-0.0, 5.0)]

ROWS = [
    (1, "v", [1, 2], [10, 12, 13], [P[0], P[1], P[2]], 400),
    (2, "v", [1], [0, 2], [P[1], P[0]], 300),  # frame 1 again, other order
    (3, "v", [1], [0, 2], [P[1], P[2]], 300),  # other points
    (4, "w", [1], [0, 2], [P[0], P[1]], 300),  # other video
    (5, "v", [2, 2], [0, 1, 2], [(0.0, 5.0), (0.0, 5.0)], 300),  # again, twice, zero without sign
    (6, "v", None, None, None, None),
    (7, "v", [3], [0, 0], [], -5),
    (8, "v", [3], [4, 4], [], 1),
    (9, None, [1], [0, 1], [(None, 1.0)], 10),
    (10, None, [1], [0, 1], [(1.0, None)], 10),
]


def test_blocks_survive_once(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("kept", F.lit(1)).withColumn("lane", F.lit(2)).withColumn("h1", F.lit(3)).withColumn("name", F.lit(4)).withColumn("attempt", F.lit(5))
    c = compact(df.unionAll(df.limit(1)))
    blocks = {(r.file_id, r.frame_index, len(r.keypoints)) for r in c.blocks.collect()}
    assert blocks == {(1, 1, 2), (1, 2, 1), (3, 1, 2), (4, 1, 2), (7, 3, 0), (9, 1, 1), (10, 1, 1)}
    assert c.blocks.count() == 7
    assert {(r.file_id, r.frame_index, r.first_file_id) for r in c.dropped.collect()} == {(2, 1, 1), (5, 2, 1), (8, 3, 7)}


def test_a_null_file_loses_no_blocks(spark):
    big = 2**53 + 1
    rows = [*ROWS, (None, "n", [1], [0, 1], [P[0]], 7), (None, "v", [1], [0, 2], [P[0], P[1]], 7), (big, "b", [1], [0, 1], [P[0]], 7)]
    c = compact(spark.createDataFrame(rows, SCHEMA))
    blocks = {(r.file_id, r.video_id, r.frame_index) for r in c.blocks.collect()}
    assert blocks == {(1, "v", 1), (1, "v", 2), (3, "v", 1), (4, "w", 1), (7, "v", 3), (9, None, 1), (10, None, 1), (None, "n", 1), (big, "b", 1)}
    assert {i for r in c.journal.collect() for i in r.inputs if not i.startswith(MADE)} == {*(str(r[0]) for r in ROWS), "null", str(big)}
    assert compact(spark.createDataFrame(rows, SCHEMA), c.root).blocks.count() == 9 and len(c._runs()) == 1


def test_journal_covers_every_file_and_is_idempotent(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    a, b = compact(df), compact(df)
    rows = a.journal.collect()
    assert {r.txn for r in rows} == {r.txn for r in b.journal.collect()}
    made = {r.output for r in rows}
    assert {i for r in rows for i in r.inputs} - made == {str(r[0]) for r in ROWS}
    again = compact(df, a.root)
    assert len(again._runs()) == 1 and again.blocks.count() == 7
    more = compact(df.unionAll(spark.createDataFrame([(11, "z", [1], [0, 1], [P[0]], 5)], SCHEMA)), a.root)
    assert more.blocks.count() == 8 and more.blocks.where("file_id = 11").count() == 1


def test_a_run_that_dies_loses_nothing(spark, monkeypatch, tmp_path):
    df, root = spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "table")
    monkeypatch.setattr(Compaction, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        compact(df.where("file_id < 4"), root)
    with pytest.raises(OSError):
        compact(df, root)
    monkeypatch.undo()
    c = compact(df, root)
    blocks = [(r.file_id, r.frame_index) for r in c.blocks.collect()]
    assert sorted(blocks) == [(1, 1), (1, 2), (3, 1), (4, 1), (7, 3), (9, 1), (10, 1)]
    assert c.dropped.count() == 3


def test_a_block_delivered_again_in_a_later_run(spark):
    c = compact(spark.createDataFrame(ROWS[1:2], SCHEMA))
    c = compact(spark.createDataFrame([ROWS[0], *ROWS[1:3], (20, "v", [1, 9], [0, 2, 3], [P[0], P[1], P[2]], 5)], SCHEMA), c.root)
    assert sorted((r.file_id, r.frame_index) for r in c.blocks.collect()) == [(1, 2), (2, 1), (3, 1), (20, 9)]
    assert [(r.file_id, r.frame_index, r.first_file_id) for r in c.dropped.collect()] == [(20, 1, 2)]


def test_small_outputs_of_earlier_runs_merge(spark):
    root = None
    for i in range(5):
        c = compact(spark.createDataFrame([(i, "v", [i], [0, 1], [P[0]], 100)], SCHEMA), root, target_bytes=1 << 20, fanout=2)
        root = c.root
    blocks = c.blocks.collect()
    assert sorted(r.file_id for r in blocks) == list(range(5))
    assert len({r.output for r in blocks}) == c.outputs.count() <= 3
    assert c.journal.where("exists(inputs, i -> i like 'txn-%')").count() >= 2
    for r in c.outputs.collect():  # one file per output
        fs = spark.read.parquet(f"{root}/frames/attempt={r.attempt}/output={r.output}")
        assert len(fs.inputFiles()) == 1


def test_plan_reaches_the_target_with_few_files():
    sizes = [(str(i), 100 + i % 7) for i in range(1000)]
    rows = merge_plan(sizes, 0, 4096, 8)
    used = [i for r in rows for i in r[3]]
    assert len(used) == len(set(used))
    final = [r for r in rows if r[6]]
    assert sum(r[5] for r in final) == sum(s for _, s in sizes)
    assert len(final) < 40 and sum(r[5] >= 4096 for r in final) >= len(final) - 1


def test_empty_table(spark):
    c = compact(spark.createDataFrame([], SCHEMA))
    assert c.blocks.count() == c.dropped.count() == c.journal.count() == 0
