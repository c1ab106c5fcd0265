"""Sources on files written here, byte by byte."""

import json
import struct
import threading
import time

import numpy as np
import psutil
from pyspark.sql import functions as F

from tracespark.sources import registry as rg
from tracespark.sources.trace_episodes import through_trace_episodes, write_trace_episodes


def vint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(num, body):
    return vint(num << 3 | 2) + vint(len(body)) + body


def example(features):
    return field(1, b"".join(field(1, field(1, k.encode()) + field(2, field(1, b"".join(field(1, v) for v in vs)))) for k, vs in features.items()))


def test_tfrecord(spark, tmp_path):
    rg.register_sources(spark)
    recs = [example({"steps/a": [b"x", b""], "lang": [b" ", b"pick up"], "other": [b"z" * 300]}), example({"lang": [b"pick up"]})]
    data = b"".join(struct.pack("<QI", len(r), 0) + r + b"\0" * 4 for r in recs)
    (tmp_path / "d.tfrecord-00000-of-00001").write_bytes(data)
    df = spark.read.format("tfrecord").option("path", str(tmp_path)).option("keys", "lang,steps/a").load()
    rows = df.orderBy("record").collect()
    assert [bytes(x) for x in rows[0]["steps/a"]] == [b"x", b""] and rows[1]["steps/a"] is None and [r.record for r in rows] == [0, 1]
    assert [r[0] for r in df.orderBy("record").select(rg.instruction_text([F.col("lang"), F.col("lang")])).collect()] == ["pick up", "pick up"]


def test_zarr_frames(spark, tmp_path):
    import zstandard

    rg.register_sources(spark)
    at = tmp_path / "episode_1" / "images.front_1"
    (at / "c").mkdir(parents=True)
    (tmp_path / "episode_1" / "zarr.json").write_text("{}")
    (at / "zarr.json").write_text(json.dumps({"shape": [7], "chunk_grid": {"configuration": {"chunk_shape": [4]}}, "codecs": [{"name": "sharding_indexed", "configuration": {"chunk_shape": [2]}}]}))
    z = zstandard.ZstdCompressor()
    pack = lambda items: z.compress(struct.pack("<I", len(items)) + b"".join(struct.pack("<I", len(i)) + i for i in items))
    a, b = pack([b"f0", b"f1"]), pack([b"f2", b"f3"])
    (at / "c" / "0").write_bytes(a + b + struct.pack("<QQQQ", 0, len(a), len(a), len(b)) + b"crc!")
    c = pack([b"f4", b"f5"])
    (at / "c" / "1").write_bytes(c + struct.pack("<QQQQ", 0, len(c), (1 << 64) - 1, (1 << 64) - 1) + b"crc!")
    read = lambda **o: {r.t: bytes(r.image) for r in spark.read.format("zarr_frames").option("path", str(tmp_path)).options(**o).load().collect()}
    assert read() == {i: f"f{i}".encode() for i in range(6)}
    assert read(step="2", start="1") == {1: b"f1", 3: b"f3", 5: b"f5"}
    assert [r.path.rsplit("/", 1)[1] for r in rg.dataset("egoverse").find(spark, str(tmp_path)).collect()] == ["episode_1"]


def test_episode_round_trip(spark, tmp_path):
    rg.register_sources(spark)
    pts = [(1.0, 2.0, 0.5), (1.5, 2.5, 0.5)]
    rows = [("e1", 3, 0, (1.0, 2.0), 4, True, 1.0, pts, [True, False]), ("e1", 5, 1, (9.0, 2.0), 4, False, 0.5, pts[:1], [True]), ("e2", 0, 0, (0.0, 0.0), None, None, None, None, None)]
    df = spark.createDataFrame(rows, "episode string, t int, kp_row bigint, keypoint struct<x:float,y:float>, cluster_id int, is_moving boolean, visib float, raw_traj array<struct<x:float,y:float,z:float>>, raw_valid_steps array<boolean>")
    assert {(r.episode, r.n_frames, r.n_rows) for r in write_trace_episodes(df, str(tmp_path)).collect()} == {("e1", 2, 2), ("e2", 1, 1)}
    back = {(r.episode, r.t): r for r in spark.read.format("trace_episodes").option("path", str(tmp_path)).load().collect()}
    assert set(back) == {("e1", 3), ("e1", 5), ("e2", 0)}
    r = back["e1", 3]
    assert len(r.raw_traj) == 128 and tuple(r.raw_traj[1]) == pts[1] and r.raw_traj[2].x == float("-inf") and r.raw_valid_steps[:3] == [True, False, False]
    assert spark.read.format("trace_episodes").option("path", str(tmp_path)).option("first", "4").load().count() == 1
    assert np.load(tmp_path / "e1" / "samples" / "offsets.npy").tolist() == [0, 1, 2]


def largest_worker(run) -> tuple:
    """What a call returns, and the MB of the largest Python worker meanwhile."""
    most, over = 0, threading.Event()

    def watch():
        nonlocal most
        while not over.is_set():
            for p in psutil.Process().children(recursive=True):
                try:
                    if "pyspark" in " ".join(p.cmdline()) and "java" not in p.name():
                        most = max(most, p.memory_info().rss - p.memory_info().shared)
                except psutil.Error:
                    pass
            time.sleep(0.1)

    t = threading.Thread(target=watch)
    t.start()
    try:
        return run(), most / 1e6
    finally:
        over.set()
        t.join()


def long_episode(spark, n):
    """Row i: frame i // 7, x = i % 1000; the first i % 129 steps are there, of which every other counts."""
    return spark.range(n).selectExpr(
        "'long' as episode", "cast(id div 7 as int) as t", "id as kp_row", "struct(cast(id % 1000 as float) as x, cast(1 as float) as y) as keypoint", "cast(id % 5 as int) as cluster_id", "id % 3 = 0 as is_moving", "cast(0.5 as float) as visib",
        "transform(slice(sequence(0, 127), 1, cast(id % 129 as int)), k -> struct(cast(k as float) as x, cast(id % 1000 as float) as y, cast(0.5 as float) as z)) as raw_traj", "transform(sequence(0, 127), k -> k % 2 = 0) as raw_valid_steps",
    )


def test_long_episode_is_never_held(spark, tmp_path):
    rg.register_sources(spark)
    n = 20_000
    done, mb = largest_worker(lambda: write_trace_episodes(long_episode(spark, n), str(tmp_path)).collect())
    assert [tuple(r) for r in done] == [("long", (n + 6) // 7, n)] and mb < 400
    a = {c: np.load(tmp_path / "long" / "samples" / f"{c}.npy") for c in ("frame_indices", "offsets", "keypoints", "raw_traj", "raw_valid_steps")}
    assert a["frame_indices"].tolist() == list(range((n + 6) // 7)) and a["offsets"].tolist() == [*range(0, n, 7), n]
    i = np.arange(n)
    assert (a["keypoints"][:, 0] == i % 1000).all() and ((a["raw_traj"][:, :, 0] != -np.inf).sum(1) == i % 129).all() and (a["raw_valid_steps"].sum(1) == (i % 129 + 1) // 2).all()
    back = spark.read.format("trace_episodes").option("path", str(tmp_path)).load()
    (r,), mb = largest_worker(lambda: back.selectExpr("count(*)", "sum(kp_row)", "sum(t)", "count_if(is_moving)", "sum(size(filter(raw_traj, s -> s.x >= 0)))", "sum(size(filter(raw_valid_steps, b -> b)))").collect())
    assert tuple(r) == (n, sum(range(n)), int((i // 7).sum()), int((i % 3 == 0).sum()), int((i % 129).sum()), int(((i % 129 + 1) // 2).sum())) and mb < 400


def test_through_the_layout_equals_write_and_read(spark, tmp_path):
    rg.register_sources(spark)
    df = long_episode(spark, 9_000).withColumn("episode", F.expr("if(kp_row < 5000, 'long', concat('e', kp_row % 700))"))
    write_trace_episodes(df, str(tmp_path)).collect()
    back, through = spark.read.format("trace_episodes").option("path", str(tmp_path)).load(), through_trace_episodes(df, *df.columns)
    assert through.schema.simpleString() == back.schema.simpleString() and back.count() == 9_000
    assert through.exceptAll(back).count() == 0 and back.exceptAll(through).count() == 0


def test_layouts_and_lists(spark, tmp_path):
    for p in ("17/3/obs.mp4", "17/3/task.txt", "part1/cut/5.mp4", "part1/cut/5.hdf5", "part1/cut/6.mp4", "v/a/img10.jpg", "v/a/img9.jpg", "v/b.png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(" stack cups \n")
    root = str(tmp_path)
    ag, ex = rg.dataset("agibot"), rg.dataset("egodex")
    assert [r[0] for r in ag.find(spark, root).select(ag.name(F.col("path"))).collect()] == ["3"]
    assert [r.task for r in ag.meta(spark, root).collect()] == ["stack cups"]
    assert [r[0] for r in ex.find(spark, root).select(ex.name(F.col("path"))).collect()] == ["part1__cut__5"]
    assert [r.path for r in rg.frame_folders(spark, root, 2).collect()] == [root + "/v/a"]
    assert [r.path.rsplit("/", 1)[1] for r in rg.frame_files(spark, root + "/v/a").orderBy("t").collect()] == ["img9.jpg", "img10.jpg"]
    (tmp_path / "allow.txt").write_text(" e1 \n\ne2\n")
    assert sorted(r.name for r in rg.name_list(spark, str(tmp_path / "allow.txt")).collect()) == ["e1", "e2"]
    (tmp_path / "cams.txt").write_text("# c\n1 PINHOLE 640 480 500 501 320 240\n")
    (tmp_path / "imgs.txt").write_text("# i\n7 1 0 0 0 0.1 0.2 0.3 1 a.png\n1.0 2.0 -1 3.0 4.0 5\n")
    c, i = rg.colmap_cameras(spark, str(tmp_path / "cams.txt")), rg.colmap_images(spark, str(tmp_path / "imgs.txt"))
    assert [(r.name, r.width, r.params[0], r.q[0]) for r in i.join(c, "camera_id").collect()] == [("a.png", 640, 500.0, 1.0)]
    (tmp_path / "j.json").write_text(json.dumps({"episode": "e", "chunk_texts": [{"chunk_id": 1}, {"chunk_id": 2}]}))
    assert rg.caption_files(spark, str(tmp_path / "j.json")).count() == 2
    info = spark.createDataFrame([([([3, 0, 2],)],)], "splits array<struct<shardLengths:array<int>>>")
    assert rg.shard_episodes(info).count() == 5
