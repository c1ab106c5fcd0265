"""Splits by recording, and pieces of oversized chunks."""

import random

import numpy as np
from pyspark.sql import functions as F

from tracespark.llm.motion_pieces import cut_pieces, split_chunks_at_calm
from tracespark.llm.related_splits import assign_splits, components, recording_key, recordings, same_recording, split_chunks

C = "video_id string, chunk_id int, dataset string, start_idx int, end_idx int, mean_acceleration float, segment_id int, ingested_at timestamp_ntz, peak_acceleration float"


def test_keys_of_spellings():
    same = [("droid", ["shard-000002::ep3", "Shard 000002 ep 3", "shard-2__ep3", "droid/shard-00002/ep_003", "shard-000002::episode3", " shard-000002::ep3.mp4"]), ("egodex", ["part3/set_tray/12", "egodex/part3/SetTray/12", "PART3\\SET_TRAY\\12", "part3/set_tray/12 (1)"]), ("egoverse", ["EgoVerse/episode_10002", "ep10002", "episode_１０００２", "episode-0010002"]), ("webvideo", ["clip_loading_bay_000004", "loading_bay/clip_000004", "Clip-Loading-Bay-4_copy"])]
    for dataset, names in same:
        assert len({recording_key(n, dataset) for n in names}) == 1, names
    assert recording_key("shard-000001::ep11", "droid") != recording_key("shard-000011::ep1", "droid")
    assert recording_key("???", "droid") != recording_key("!!!", "droid")


def test_components_follow_chains(spark):
    rows = [("d", f"r{i}", f"e{j}") for i in range(9) for j in (i, i + 1) if i != 4] + [("x", "r0", "e0"), (None, "r1", "e1"), ("d", None, "e1"), ("d", "r1", None)]
    got = {(r.s, r.r): r.label for r in components(spark.createDataFrame(rows, "s string, r string, e string"), "s", "r", "e").collect()}
    assert {got["d", f"r{i}"] for i in range(4)} == {"r0"} and {got["d", f"r{i}"] for i in range(5, 9)} == {"r5"}
    assert got["x", "r0"] == "r0" and got[None, "r1"] == "r1" and len(got) == 10


def test_splits_keep_recordings_together(spark):
    r = random.Random(4)
    rows = [(f"clip_{w}_{i:06d}" + r.choice(["", "", ".mp4", " (1)"]), c, "webvideo", 10 * c, 10 * c + 9, r.random(), 0, None, 1.0) for w in ("a", "b") for i in range(120) for c in range(r.randint(1, 9))]
    rows += [("clip_big_000001", c, "webvideo", c, c, 0.5, 0, None, 1.0) for c in range(300)] + [(None, 1, "webvideo", 1, 2, None, None, None, None), ("x1", 1, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, C).withColumn("recording", F.lit("q")).withColumn("n", F.lit(1)).withColumn("motion", F.lit(1))
    out = split_chunks(df, bucket_groups=40).collect()
    assert len(out) == len({(x[0], x[1]) for x in rows})
    by = {}
    for x in out:
        by.setdefault((x.dataset, recording_key(x.video_id, x.dataset) if x.video_id else None), set()).add(x.split)
    assert all(len(s) == 1 for s in by.values())
    share = sum(x.split == "train" for x in out) / len(out)
    assert 0.75 < share < 0.85


def test_empty_splits(spark):
    df = spark.createDataFrame([], C)
    assert split_chunks(df).count() == 0 and same_recording(df).count() == 0
    assert assign_splits(spark.createDataFrame([], "s string, g string, l string, n bigint"), "s", "g", "l", "n").count() == 0


def test_long_chains_have_one_label(spark):
    n = 200
    order = list(range(n))
    random.Random(8).shuffle(order)
    for names in (order, range(n)):
        rows = [("d", f"r{x:04d}", f"e{i + k}") for i, x in enumerate(names) for k in (0, 1)]
        got = components(spark.createDataFrame(rows, "s string, r string, e string"), "s", "r", "e").collect()
        assert len(got) == n and {r.label for r in got} == {"r0000"}


def test_copies_share_content_not_names(spark):
    r = random.Random(6)
    made = {n: [(c, 10 * c, 10 * c + 7, r.random()) for c in range(k)] for n, k in (("one", 1), ("two", 2), ("five", 5), ("other", 5))}
    rows = [(f"{n} x", *row, 0) for n, chunks in made.items() for row in chunks]
    rows += [("alpha", *made["one"][0], 0), *(("beta", *x, 0) for x in made["two"]), *(("gamma", *x, 0) for i, x in enumerate(made["five"]) if i != 2)]
    rows += [("delta", *made["other"][3], 0), ("delta", 4, 1, 2, 0.77, 0)]  # one chunk in common proves nothing
    df = spark.createDataFrame([(v, c, "d", a, b, m, s, None, 1.0) for v, c, a, b, m, s in rows], C)
    assert {tuple(x) for x in same_recording(df).collect()} == {("alpha", "one x"), ("beta", "two x"), ("five x", "gamma")}
    assert {x.recording for x in recordings(df).collect()} == {"alpha", "beta", "delta", "five x", "other x"}


def test_splits_agree_in_their_labels(spark):
    r = random.Random(9)
    rows = [(s, f"g{i}", r.choice("abc"), r.randint(1, 9)) for s in ("x", None) for i in range(900) for _ in range(2)] + [("x", "huge", "a", 900), ("y", "only", None, 5)]
    df = spark.createDataFrame(rows, "s string, g string, l string, n bigint")
    out = {(x.s, x.g): x.split for x in assign_splits(df, "s", "g", "l", "n", bucket_groups=200).collect()}
    assert len(out) == 1802
    for s in ("x", None):
        for l in "abc":
            whole = sum(n for a, _, b, n in rows if (a, b) == (s, l))
            for split, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
                assert abs(sum(n for a, g, b, n in rows if (a, b) == (s, l) and out[a, g] == split) / whole - share) < 0.01
    many = spark.createDataFrame([(f"s{i}", "g", "l", 3) for i in range(300)], "s string, g string, l string, n bigint")
    assert assign_splits(many, "s", "g", "l", "n").count() == 300


def test_pairs_of_spellings(spark):
    rows = [(n, c, d, c, c + 3, {"episode_11": 0.2}.get(n, 0.1), 0, None, 1.0) for n, d in (("ep10", "egoverse"), ("episode_10", "egoverse"), ("Episode 10", "egoverse"), ("episode_11", "egoverse"), ("ep10", "droid")) for c in range(2)]
    got = {tuple(r) for r in same_recording(spark.createDataFrame(rows, C)).collect()}
    assert got == {("Episode 10", "ep10"), ("Episode 10", "episode_10"), ("ep10", "episode_10")}


def test_pieces_obey_limit_and_overlap():
    rng = np.random.default_rng(0)
    for n, limit, overlap in [(101, 100, 0), (559, 200, 20), (1625, 300, 24), (97, 30, 29), (10, 1, 0), (61, 60, 6)]:
        a = np.abs(np.convolve(rng.normal(0, 1, n + 8), np.ones(9) / 9, "valid")) + 0.01
        for acc in (a, None, np.full(n, np.nan)):
            p = cut_pieces(5, n + 4, limit, overlap, acc, 5)
            assert p[0][0] == 5 and p[-1][1] == n + 4
            assert all(e - s + 1 <= limit for s, e, _ in p)
            assert all(x[1] - y[0] + 1 == overlap for x, y in zip(p, p[1:]))


def test_cuts_are_calm_and_local():
    kept, calm = [], []
    for seed in range(40):
        rng = np.random.default_rng(seed)
        a = 1 + np.abs(np.convolve(rng.normal(0, 1, 6008), np.ones(9) / 9, "valid"))
        at, more = int(rng.integers(500, 5500)), 37
        b = np.insert(a, at, 1 + np.abs(rng.normal(0, 1, more)))
        before = [e for _, e, k in cut_pieces(0, len(a) - 1, 200, 10, a, 0) if k != "end"]
        after = {e for _, e, k in cut_pieces(0, len(b) - 1, 200, 10, b, 0) if k != "end"}
        kept.append(np.mean([(e if e < at else e + more) in after for e in before]))
        calm.append(np.mean(a[before]) < np.median(a))
    assert np.mean(kept) >= 0.95 and min(kept) > 0.9 and all(calm)


def test_no_cut_at_the_peak():
    a = np.full(400, 5.0)
    a[100:110], a[250:260] = 0.9, 0.95  # everything but two calm places is as high as the peak
    p = cut_pieces(0, 399, 200, 0, a, 0, 5.0)
    assert {e for _, e, _ in p[:-1]} <= {*range(100, 110), *range(250, 260)}


def test_pieces_of_awkward_chunks(spark):
    rows = [("v", 1, "d", 0, 49, None, 0, None, 2.0), ("v", 2, "d", None, 9, None, 0, None, None), ("v", 3, "d", 9, 0, None, 0, None, None), ("v", 4, "none", 0, 900, None, 0, None, None), (None, 5, "d", 0, 30, None, None, None, None), ("v", 6, "d", 0, 9, None, 0, None, None)]
    chunks = spark.createDataFrame(rows * 2, C).withColumn("boundary", F.lit("x")).withColumn("a", F.lit(1))
    limits = spark.createDataFrame([("d", 20, None), ("d", 25, 4), (None, 5, 1), ("z", None, 2)], "dataset string, max_chunk_len int, overlap int")
    acc = spark.createDataFrame([("v", 0, 10, [1.0, None, 0.5, float("inf")] * 5), ("v", 0, None, [1.0]), ("v", None, 3, None)], "video_id string, segment_id int, first_idx int, acceleration array<float>")
    out = split_chunks_at_calm(chunks, limits, acc).collect()
    n = {r.chunk_id: r.n_pieces for r in out}
    assert set(n) == {1, 4, 5, 6} and n[4] == 1 and n[6] == 1 and n[5] >= 2 and n[1] >= 3
    assert split_chunks_at_calm(chunks.limit(0), limits, acc).count() == 0
