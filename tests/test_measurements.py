"""The measurement model on planted spikes, stuck values and impossible readings."""

import numpy as np
from pyspark.sql import functions as F

from tracespark.operators.measurement_hmm import NORMAL, SPIKE, Prior, Source, _shares_frames, fit_sources, flag_peaks, flag_trajectories, forward_backward, step_likelihoods

S = "sample_id bigint, video_id string, dataset string, raw_traj array<struct<x:float,y:float,z:float>>, raw_valid_steps array<boolean>"


def walk(rng, n=40):
    p = np.cumsum(rng.normal(0, 1, (n, 2)), axis=0) + 200
    return [[float(a), float(b), 2 + float(c)] for (a, b), c in zip(p, rng.normal(0, 0.01, n))]


def sample(i, pts, ok=None):
    return (i, "v", "d", [tuple(p) for p in pts], ok if ok is not None else [True] * len(pts))


def test_planted_trajectories(spark):
    rng = np.random.default_rng(1)
    rows = [sample(i, walk(rng)) for i in range(200)]
    spike, stuck, out, hidden, end = (walk(rng) for _ in range(5))
    spike[20][0] += 90
    for k in range(10, 25):
        stuck[k] = list(stuck[10])
    out[5][2] = -1.0
    hidden[7] = [float("-inf")] * 3
    end[-1][1] += 80
    ok = [True] * 40
    ok[7] = False
    rows += [sample(1000, spike), sample(1001, stuck), sample(1002, out), sample(1003, hidden, ok), sample(1004, end), sample(1005, [[float("nan"), 1.0, 1.0]] + walk(rng)[1:])]
    rows += [(1006, None, None, None, [True]), (1007, "v", "d", [(1.0, 1.0, None)], [True]), (1008, "v", "d", [], []), (1009, "v", "d", [(1.0, 1.0, 1.0), None], [True, None])]
    df = spark.createDataFrame(rows, S).withColumn("p", F.lit(1)).withColumn("impossible", F.lit(9))
    f = {r.sample_id: (r.impossible, r.spike, r.stuck) for r in flag_trajectories(df).collect()}
    assert len(f) == len(rows)
    assert [i for i in f if sum(f[i])] == [1000, 1001, 1002, 1004, 1005]
    assert f[1000][1] == 1 and f[1001][2] >= 10 and f[1002][0] == 1 and f[1004][1] == 1 and f[1005][0] == 1


def test_runs_of_spikes(spark):
    rng = np.random.default_rng(4)
    rows = [sample(i, walk(rng)) for i in range(200)]
    two, three, apart, hidden, moved, twice = (walk(rng) for _ in range(6))
    for pts, bad in ((two, [20, 21]), (three, [20, 21, 22]), (apart, [10, 11, 30, 31]), (hidden, [20, 22]), (moved, range(20, 40)), (twice, [10, 25, 26])):
        for k in bad:
            pts[k][0] += 90
    hidden[21] = [0.0, 0.0, -1.0]  # impossible, between two spikes
    rows += [sample(1000 + i, x) for i, x in enumerate((two, three, apart, hidden, moved, twice))]
    f = {r.sample_id: r.spike for r in flag_trajectories(spark.createDataFrame(rows, S)).collect()}
    assert {i: n for i, n in f.items() if n} == {1000: 2, 1001: 3, 1002: 4, 1003: 2, 1005: 3}


C = "video_id string, chunk_id int, dataset string, start_idx int, end_idx int, peak_acceleration float, mean_acceleration float"


def test_planted_peaks(spark):
    rng = np.random.default_rng(2)
    rows = [("v", i, "d", 100 * i, 100 * i + 99, float(np.exp(rng.normal(0, 0.25))), 0.2) for i in range(300)]
    put = lambda i, p, **k: rows.__setitem__(i, (k.get("v", "v"), i, "d", k.get("s", 100 * i), k.get("e", 100 * i + 99), p, 0.2))
    for i, p in ((10, 50.0), (20, float("nan")), (30, float("inf")), (40, -1.0), (50, 0.1), (60, None), (70, 3e38)):
        put(i, p)
    for i in range(80, 86):
        put(i, 1.25)
    for i in range(100, 106):  # the same peak by right: all share frames
        put(i, 1.5, s=10_000 + i, e=10_300 + i)
    for i in range(120, 126):
        put(i, 1.75 if i != 123 else None)
    put(130, 1.1), put(131, 1.1)
    df = spark.createDataFrame(rows + [(None, None, None, None, None, 1.0, None)], C).withColumn("own", F.lit(True)).withColumn("g", F.lit(1))
    got = {(r.chunk_id, r.impossible, r.spike, r.stuck) for r in flag_peaks(df).collect() if r.impossible or r.spike or r.stuck}
    want = {(10, False, True, False)} | {(i, True, False, False) for i in (20, 30, 40, 50, 70)} | {(i, False, False, True) for i in [*range(80, 86), 120, 121, 122, 124, 125]}
    assert got == want
    small = {(r.chunk_id, r.impossible, r.spike, r.stuck) for r in flag_peaks(df, block=16, halo=8).collect() if r.impossible or r.spike or r.stuck}
    assert small == want


def test_empty_tables(spark):
    assert flag_trajectories(spark.createDataFrame([], S)).count() == 0
    assert flag_peaks(spark.createDataFrame([], C)).count() == 0


def test_posteriors_are_probabilities_and_counts_add_up():
    u = np.abs(np.random.default_rng(0).normal(0, 1, (5, 30)))
    v = np.ones(u.shape, bool)
    v[2, 10:] = False
    out = np.zeros(u.shape, bool)
    out[3, 7], u[1, 4] = True, 60.0
    e = step_likelihoods(u, np.zeros(u.shape, bool), out, Source(), Prior())
    g, n = forward_backward(e, v, Prior().transitions(), counts=True)
    assert np.allclose(g.sum(-1)[v], 1) and np.all(g[~v] == 0)
    assert np.isclose(n.sum(), v.sum()) and g[3, 7].argmax() == 3 and g[1, 4].argmax() == SPIKE and g[0].argmax(1).max() == NORMAL


def test_sources_have_their_own_parameters(spark):
    rng = np.random.default_rng(7)

    def scaled(i, source, k, depth, bad):
        p = [[k * x, k * y, depth * z] for x, y, z in walk(rng)]
        if bad:
            p[20][0] += 60 * k
        return (i, "v", source, [tuple(x) for x in p], [True] * len(p))

    rows = [scaled(i, "calm", 1.0, 1.0, i % 20 == 0) for i in range(200)] + [scaled(1000 + i, "fast", 50.0, 30.0, False) for i in range(200)]
    rows.append((5000, "v", "calm", [(200.0, 200.0, 400.0)] * 3, [True] * 3))  # impossible here, not in a source 30 times as deep
    rows.append((5001, "v", "fast", [(200.0, 200.0, 400.0)], [True]))
    df = spark.createDataFrame(rows, S)
    m = fit_sources(df, "dataset")
    assert 40 < m["fast"].step / m["calm"].step < 60 and m["calm"].depth_limit < 400 < m["fast"].depth_limit
    assert m["calm"].a[NORMAL, SPIKE] > 10 * m["fast"].a[NORMAL, SPIKE] and np.allclose(m["calm"].a.sum(1), 1)
    f = {r.sample_id: r for r in flag_trajectories(df, fitted=m).collect()}
    assert {i for i in f if f[i].spike} == set(range(0, 200, 20)) and f[5000].impossible == 3 and not f[5001].impossible


def test_frames_shared_with_any_chunk_of_a_run():
    a = np.array([100.0 * i for i in range(20)] + [5.0, 1900.0, 5000.0, np.nan])
    again = np.r_[False, np.ones(23, bool)]
    assert _shares_frames(again, a, a + 50).tolist() == [False] * 20 + [True, True, False, True]
