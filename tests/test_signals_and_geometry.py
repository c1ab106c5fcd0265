"""Cards of the signal, caption, cluster, retargeting and pose operators on hand-made cases and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracespark.functions import geometry as g
from tracespark.operators import alignment as al
from tracespark.operators import captions as cp
from tracespark.operators import clusters as cl
from tracespark.operators import retarget as rt
from tracespark.operators import signals as sg


@given(st.lists(st.integers(0, 600), max_size=8), st.integers(1, 600))
@settings(max_examples=200, deadline=None)
def test_pieces_tile_and_respect_the_longest(cuts, n):
    p = sg.enforce_lengths(cuts, n, sg.GENERAL)
    assert p[0][0] == 0 and p[-1][1] == n - 1
    assert all(b + 1 == c for (_, b), (c, _) in zip(p, p[1:]))
    assert all(e - s + 1 <= sg.GENERAL.max_len for s, e in p)


def test_short_pieces_join_the_shorter_neighbour():
    p = sg.Chunking(min_len=10, max_len=100)
    assert sg.enforce_lengths([30, 35], 55, p) == [(0, 29), (30, 54)]
    assert sg.enforce_lengths([20, 25], 45, p) == [(0, 24), (25, 44)]  # a tie goes left
    assert sg.enforce_lengths([], 250, p) == [(0, 83), (84, 166), (167, 249)]


def test_chunks_split_at_the_valley():
    x = np.arange(120.0)
    a = np.exp(-((x - 30) ** 2) / 60) + np.exp(-((x - 90) ** 2) / 60)
    c = sg.chunk_signal(a)
    assert len(c) == 2 and 50 <= c[0][1] <= 70
    assert sg.chunk_signal(np.ones(10)) == [(0, 9, 1.0, 1.0)] and sg.chunk_signal(np.array([])) == []
    assert len(sg.chunk_signal(np.ones(90))) == 3 and len(sg.chunk_signal(np.ones(90), sg.ROBOT)) == 1


def test_savgol_keeps_parabolas(spark):
    assert np.allclose(np.array(sg.savgol_weights(11))[5] * 429, [-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36])
    a = [(0.1 * i - 1) ** 2 for i in range(20)]
    got = spark.createDataFrame([(a,)], "a array<double>").select(sg.savgol(F.col("a"))).first()[0]
    assert np.allclose(got, a)


def test_windows_of_small_segments(spark):
    rows = [("e", s, c, 10 * c, 10 * c + 9) for s, n in ((0, 1), (1, 2), (2, 3), (3, 5)) for c in range(n)]
    df = spark.createDataFrame(rows, "episode string, segment int, chunk_id int, start_idx int, end_idx int")
    n = {(r.segment, r.merge_type): r.n for r in cp.merge_windows(df).groupBy("segment", "merge_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {(0, "full"): 1, (1, "pair"): 1, (2, "pair"): 2, (2, "triple"): 1, (3, "pair"): 4, (3, "triple"): 3, (3, "full"): 1}


def test_json_repair(spark):
    rows = ['{"a": 1}', '```json\n{"a": 1}\n```', 'Here: {"a": {"b": 2}} done', "no json", "{broken", None, "`{\"a\": 1}`"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(cp.repaired_json(F.col("x"))).collect()]
    assert got == ['{"a": 1}', '{"a": 1}', '{"a": {"b": 2}}', None, None, None, '{"a": 1}']


def test_token_counts_of_merging():
    x = np.random.default_rng(0).normal(size=(256, 8))
    n = [256]
    for _ in range(11):
        x = cl.merge_tokens(x)
        n.append(len(x))
    assert n == [256, 192, 144, 108, 81, 61, 46, 35, 27, 21, 16, 12]
    assert len(cl.merge_tokens(np.eye(1))) == 1


def test_equal_arcs_start_at_the_point_and_keep_the_path():
    p = np.cumsum(np.random.default_rng(1).normal(0, 0.03, (5, 30, 3)), axis=1)
    out = rt.equal_arcs(p, 0.05, 128)
    assert np.allclose(out[:, 0], p[:, 0]) and out.shape[1] <= 128
    line = np.stack([np.linspace(0, 0.5, 11), np.zeros(11), np.ones(11)], -1)[None]
    assert np.allclose(np.diff(rt.equal_arcs(line, 0.05, 128)[0, :, 0]), 0.05)
    assert rt.equal_arcs(line[:, :1], 0.05, 128).shape == (1, 1, 3) and rt.equal_arcs(line, 0.05, 4).shape == (1, 4, 3)
    still = np.zeros((2, 4, 3))
    assert rt.equal_arcs(still, 0.05, 128).shape == (2, 1, 3)


def test_samples_of_groups_by_life(spark):
    rows = [("e", k, t, 10.0 * t + k, 5.0, 2.0) for k, span in ((1, range(0, 5)), (2, range(0, 5)), (3, range(2, 4))) for t in span]
    rows += [("e", 9, 0, 1.0, 1.0, 1.0), ("e", 4, None, 1.0, 1.0, 1.0), ("e", 1, 2, 21.0, 5.0, 2.0), ("f", 1, 0, 1.0, 1.0, 1.0)]
    t = spark.createDataFrame(rows, "episode string, kp int, t int, x double, y double, z double").withColumn("block", F.lit(1))
    eye = [float(x) for x in np.eye(4).ravel()]
    cams = spark.createDataFrame([("e", i, 1.0, 1.0, 0.0, 0.0, eye) for i in range(5)], "episode string, t int, fx double, fy double, cx double, cy double, pose array<double>")
    moving = spark.createDataFrame([("e", 1, True), ("e", 3, True), ("e", 2, False), ("e", 9, True)], "episode string, kp int, is_moving boolean")
    got = {(r.kp, r.t): r for r in rt.assembled_samples(t, cams, 100, 100, moving, anchors=2).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 3), (3, 2)}  # the last frame of a life has no step ahead
    r = got[1, 1]
    assert [p.x for p in r.raw_traj] == pytest.approx([(10 * s + 1) / 2 for s in range(1, 5)]) and [p.x for p in r.raw_traj_history] == pytest.approx([11 / 2, 1 / 2])
    assert np.allclose(np.diff([p.x for p in r.traj]), 5) and len(r.traj_history) == 1  # its clock falls just short of the next slot
    fixed = rt.assembled_samples(t, cams, 100, 100, moving).select(*[c.alias(n) for c, n in zip(rt.padded("raw_traj", 6), ("p", "ok"))]).collect()
    assert all(len(x.p) == len(x.ok) == 6 and [p.x > float("-inf") for p in x.p] == x.ok for x in fixed)
    assert rt.assembled_samples(t.limit(0), cams, 100, 100, moving).count() == 0


def pose(yaw, t):
    m = np.eye(4)
    m[:3, :3] = [[np.cos(yaw), 0, np.sin(yaw)], [0, 1, 0], [-np.sin(yaw), 0, np.cos(yaw)]]
    m[:3, 3] = t
    return m


def test_alignment_recovers_the_move_and_rejects_one_outlier(spark):
    src = np.array([pose(0.1 * i, [i, 0, 0.5 * i]) for i in range(9)])
    move = pose(0.4, [1, 2, 3])
    tgt = move @ src
    bad = tgt.copy()
    bad[4, :3, 3] += 50
    rows = [("all", s, t) for s, t in zip(src, tgt)] + [("bad", s, t) for s, t in zip(src, bad)] + [("one", src[3], tgt[3]), (None, src[1], tgt[1]), (None, src[2], tgt[2])]
    rows = [(c, s.ravel().tolist(), t.ravel().tolist()) for c, s, t in rows] + [("none", None, tgt[0].ravel().tolist())]
    df = spark.createDataFrame(rows, "chunk string, source array<double>, target array<double>").withColumn("n", F.lit(1))
    got = {r.chunk: r for r in al.align_chunks(df).collect()}
    assert set(got) == {"all", "bad", "one", None} and {k: r.n_anchors for k, r in got.items()} == {"all": 9, "bad": 9, "one": 1, None: 2}
    assert all(np.allclose(np.array(r.transform).reshape(4, 4), move) for r in got.values())
    assert al.align_chunks(df.limit(0)).count() == 0


def test_rigid_columns(spark):
    m = pose(0.7, [1.0, -2.0, 3.0]).ravel().tolist()
    cols = [F.lit(float(v)) for v in m]
    inv = np.array([spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(g.inverse_rigid(cols))]).first()]).reshape(4, 4)
    assert np.allclose(inv, np.linalg.inv(np.array(m).reshape(4, 4)))
    r = [cols[0], cols[1], cols[2], cols[4], cols[5], cols[6], cols[8], cols[9], cols[10]]
    q = spark.range(1).select(*[c.alias(f"q{i}") for i, c in enumerate(g.quaternion(r))]).first()
    back = spark.range(1).select(*[c.alias(f"r{i}") for i, c in enumerate(g.rotation([F.lit(v) for v in q]))]).first()
    assert np.allclose(back, [m[i] for i in (0, 1, 2, 4, 5, 6, 8, 9, 10)])


def test_noisy_and_clean_partition_the_time_line(spark):
    n = [5, 5, 50, 5, 5, 60, 60, 5, 5, 5]
    c = spark.createDataFrame([("e", i, v) for i, v in enumerate(n)], "episode string, t int, n int")
    noisy = sg.noisy_intervals(c, 40, 1)
    assert [(r.start_idx, r.end_idx) for r in noisy.collect()] == [(1, 7)]
    spans = c.groupBy("episode").agg((F.max("t") + 1).alias("n"))
    assert [(r.start_idx, r.end_idx) for r in sg.clean_segments(noisy, spans, 2).collect()] == [(8, 9)]
    assert sg.noisy_intervals(c, 0).count() == 0


def test_positional_pairs_raise_on_different_sizes(spark):
    from tracespark.operators.admission import positional_pairs

    a, b = spark.createDataFrame([(2,), (1,)], "a int"), spark.createDataFrame([(5,)], "b int")
    with pytest.raises(Exception, match="differ in size"):
        positional_pairs(a, b, "a", "b").collect()


def test_stable_numbers_have_their_fixed_values(spark):
    import hashlib

    from tracespark.operators.admission import stable_int, stable_unit

    rows = [(str(i),) for i in range(60)] + [(None,)]
    got = spark.createDataFrame(rows, "k string").select("k", stable_unit(F.col("k"), "s").alias("u"), stable_int(F.col("k"), 10, 17, "s").alias("n"), stable_unit(F.col("k"), 1).alias("v")).collect()
    h = lambda kind, k: int(hashlib.sha256(f"{kind}_s_{k}".encode()).hexdigest(), 16)
    for r in got:
        if r.k is None:
            assert r.u is None and r.n is None
        else:
            assert r.u == pytest.approx((h("hash_random", r.k) % (2**128 + 1)) / 2**128, abs=1e-15) and r.n == 10 + h("hash_randint", r.k) % 7 and r.v != r.u


def test_weighted_choice_on_ties_and_zeros(spark):
    from tracespark.operators.admission import weighted_choice

    items = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 0.0), ("d", 2.0), ("e", None)], "item string, w double")
    draws = spark.createDataFrame([(0, 0.0), (1, 0.25), (2, 0.2501), (3, 0.5), (4, 0.6), (5, 1.0), (6, None)], "draw int, u double")
    got = {r.draw: r.item for r in weighted_choice(items, draws, "item", "w").collect()}
    assert got == {0: "a", 1: "a", 2: "b", 3: "b", 4: "d", 5: "d"}
    zero = spark.createDataFrame([("a", 0.0), ("b", 3.0)], "item string, w double")
    assert {r.draw: r.item for r in weighted_choice(zero, draws, "item", "w").collect()}[0] == "a"
    assert weighted_choice(items.limit(0), draws, "item", "w").count() == 0


def test_places_in_order(spark):
    from tracespark.runtime import in_order

    r = np.random.default_rng(3).permutation(500).tolist()
    got = in_order(spark.createDataFrame([(x,) for x in r], "k int"), ["k"]).collect()
    assert all(x._before == x.k and x._all == 500 for x in got) and len(got) == 500
