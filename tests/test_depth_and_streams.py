"""Dense depth operators and streams on hand-made cases."""

import numpy as np
from pyspark.sql import functions as F

from tracespark.operators import depth as dp
from tracespark.plans.standins import tracks
from tracespark.streaming import live

from conftest import SMALL


def grid(spark, a):
    return spark.createDataFrame([("e", 0, y, x, float(v)) for y, r in enumerate(a) for x, v in enumerate(r)], "episode string, t int, y int, x int, z double")


def test_edges_and_pooling(spark):
    a = np.full((6, 7), 2.0)
    a[:, 4:] = 3.0
    a[0, 0] = 0.0
    e = {(r.y, r.x) for r in dp.depth_edges(grid(spark, a), 0.1).where("edge").collect()}
    assert e == {(y, x) for y in range(6) for x in (3, 4)}
    b = np.arange(42.0).reshape(6, 7)
    got = {(r.y, r.x): r.z for r in dp.max_pool(grid(spark, b), 2, 2).collect()}
    assert got == {(y, x): b[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].max() for y in range(2) for x in range(3)}
    assert dp.pixel_grid(spark, 3, 4).count() == 12


def test_maps():
    y, x = np.mgrid[0:5, 0:6].astype(float)
    n = dp.normals(np.stack([x, y, 2 + 0 * x], -1))
    assert np.allclose(np.abs(n[..., 2]), 1)
    assert np.allclose(dp.bilinear(x, 10, 12)[:, 1:-1].mean(0), np.linspace(0.25, 4.75, 10))
    z = np.ones((3, 3))
    z[1, 1] = 9
    assert dp.fill_nearest(z, z > 5)[1, 1] == 1


def test_filtered_maps_and_sizes(spark):
    z = np.ones((4, 5))
    z[2, 2] = 5
    df = spark.createDataFrame([("e", 0, 4, 5, z.ravel().tolist())], "episode string, t int, h int, w int, z array<double>")
    assert set(dp.filtered_maps(df).first().z) == {1.0}
    w, h, top = dp.model_size(F.lit(360), F.lit(640))
    assert tuple(spark.range(1).select(w, h, top).first()) == (518, 294, 0)
    q = spark.createDataFrame([("e", 1, 0, 1.6, -3.0)], "episode string, query_id int, t int, x double, y double")
    cam = spark.createDataFrame([("e", 0, 2.0, 2.0, 1.0, 1.0, 4, 5)], "episode string, t int, fx double, fy double, cx double, cy double, height int, width int")
    r = dp.query_world(q, grid(spark, np.arange(20.0).reshape(4, 5)), cam).first()
    assert (r.zc, round(r.xc, 6)) == (2.0, 0.6)


def test_carried_positions(spark, tmp_path):
    t = tracks(spark, SMALL)
    for i in range(3):
        t.where(F.col("t") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.last_positions(s).writeStream.format("memory").queryName("carried").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.kp, r.t) for r in spark.table("carried").groupBy("kp").agg(F.max("t").alias("t")).collect()}
    assert got == {(r.kp, r.t) for r in t.where("visible").groupBy("kp").agg(F.max("t").alias("t")).collect()}
