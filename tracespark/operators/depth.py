"""Operators on dense depth: pixel grids, edges, normals, pooling, scaling and view geometry.

Exploded pixels (episode, t, y, x, z) go through windows; whole maps (a row of doubles) through Arrow
kernels, one map per row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pixel_grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """y, x of every pixel."""
    return spark.range(height).select(F.col("id").cast("int").alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))


def depth_edges(pixels: DataFrame, rtol: float = 0.04) -> DataFrame:
    """Adds edge: the range of valid depths in the 3x3 neighbourhood exceeds ``rtol`` of the depth. Two separable window passes; depths that are null or not above 0 do not count and are no edge."""
    z = F.when(F.col("z") > 0, F.col("z"))
    row = Window.partitionBy("episode", "t", "y").orderBy("x").rangeBetween(-1, 1)
    col = Window.partitionBy("episode", "t", "x").orderBy("y").rangeBetween(-1, 1)
    p = pixels.withColumn("_lo", F.min(z).over(row)).withColumn("_hi", F.max(z).over(row))
    p = p.withColumn("_l", F.min("_lo").over(col)).withColumn("_h", F.max("_hi").over(col))
    return p.withColumn("edge", F.coalesce((F.col("_h") - F.col("_l")) / z > rtol, F.lit(False))).drop("_lo", "_hi", "_l", "_h")


def max_pool(pixels: DataFrame, size: int, stride: int) -> DataFrame:
    """episode, t, y, x, z: the greatest of each size x size window that starts at a multiple of the stride; (n - size + 1) // stride windows per axis."""
    row = Window.partitionBy("episode", "t", "y").orderBy("x").rangeBetween(0, size - 1)
    col = Window.partitionBy("episode", "t", "x").orderBy("y").rangeBetween(0, size - 1)
    edge = Window.partitionBy("episode", "t")
    p = pixels.withColumn("_r", F.max("z").over(row)).withColumn("_m", F.max("_r").over(col)).withColumn("_h", F.max("y").over(edge) + 1).withColumn("_w", F.max("x").over(edge) + 1)
    keep = (F.col("y") % stride == 0) & (F.col("x") % stride == 0) & (F.col("y") / stride < F.floor((F.col("_h") - size + 1) / stride)) & (F.col("x") / stride < F.floor((F.col("_w") - size + 1) / stride))
    return p.where(keep).select("episode", "t", (F.col("y") / stride).cast("int").alias("y"), (F.col("x") / stride).cast("int").alias("x"), F.col("_m").alias("z"))


def normals(points: np.ndarray) -> np.ndarray:
    """Unit normals of an (h, w, 3) point map: the sum of the four corner cross products whose neighbours are finite; zero where none is."""
    h, w, _ = points.shape
    pad = np.full((h + 2, w + 2, 3), np.nan)
    pad[1:-1, 1:-1] = points
    c = pad[1:-1, 1:-1]
    up, left, down, right = (pad[a : a + h, b : b + w] - c for a, b in ((0, 1), (1, 0), (2, 1), (1, 2)))
    out = np.zeros_like(points)
    for a, b in ((up, left), (left, down), (down, right), (right, up)):
        n = np.cross(a, b)
        size = np.linalg.norm(n, axis=-1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            out += np.nan_to_num(n / size)
    size = np.linalg.norm(out, axis=-1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def fill_nearest(depth: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Depths at ``bad`` places taken from the nearest good place (by rings of the square, then reading order); unchanged where none is good."""
    out = depth.copy()
    good = ~bad
    if not good.any():
        return out
    todo = list(zip(*np.nonzero(bad)))
    gy, gx = np.nonzero(good)
    for y, x in todo:
        k = np.argmin((gy - y) ** 2 + (gx - x) ** 2)
        out[y, x] = depth[gy[k], gx[k]]
    return out


def bilinear(depth: np.ndarray, height: int, width: int) -> np.ndarray:
    """A map resized with pixel centres at half places; edges repeat."""
    h, w = depth.shape
    y, x = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
    y0, x0 = np.clip(np.floor(y), 0, h - 1).astype(int), np.clip(np.floor(x), 0, w - 1).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None]
    return (depth[y0][:, x0] * (1 - fx) + depth[y0][:, x1] * fx) * (1 - fy) + (depth[y1][:, x0] * (1 - fx) + depth[y1][:, x1] * fx) * fy


def filtered_maps(maps: DataFrame, rtol: float = 0.08) -> DataFrame:
    """episode, t, h, w, z: edges of each map replaced by the nearest depth that is no edge. maps: episode, t, h, w, z (row-major doubles)."""

    def run(batches):
        for pdf in batches:
            out = []
            for h, w, z in pdf[["h", "w", "z"]].itertuples(index=False, name=None):
                d = np.asarray(z, np.float64).reshape(h, w)
                p = np.pad(np.where(d > 0, d, np.nan), 1, constant_values=np.nan)
                win = np.lib.stride_tricks.sliding_window_view(p, (3, 3)).reshape(h, w, 9)
                with np.errstate(all="ignore"):
                    lo, hi = np.where(np.isnan(win), np.inf, win).min(-1), np.where(np.isnan(win), -np.inf, win).max(-1)
                    bad = (d <= 0) | ((hi - lo) / d > rtol)
                out.append(fill_nearest(d, bad).ravel())
            yield pdf.assign(z=pd.Series(out, index=pdf.index, dtype=object))

    return maps.select("episode", "t", "h", "w", "z").mapInPandas(run, maps.select("episode", "t", "h", "w", "z").schema)


def model_size(height: Column, width: Column, target: int = 518, patch: int = 14) -> tuple[Column, Column, Column]:
    """(width, height, top) of a frame scaled to the target width: the height is the nearest multiple of the patch, cropped in the middle above the target."""
    h = (F.bround(height * target / width / patch) * patch).cast("int")
    return F.lit(target), F.least(h, F.lit(target)), F.when(h > target, F.floor((h - target) / 2)).otherwise(0).cast("int")


def query_world(queries: DataFrame, depth: DataFrame, cameras: DataFrame) -> DataFrame:
    """episode, query_id, t, xc, yc, zc: a 2-D query lifted by the depth at its rounded, clipped pixel of its own frame, in that frame's camera.

    queries: episode, query_id, t, x, y; depth: episode, t, y, x, z; cameras: episode, t, fx, fy, cx, cy, height, width.
    Equi-joins on frame and pixel; a query whose frame or pixel has no depth is left out.
    """
    q = queries.join(cameras, ["episode", "t"]).withColumn("px", F.greatest(F.lit(0), F.least(F.col("width") - 1, F.bround("x").cast("int")))).withColumn("py", F.greatest(F.lit(0), F.least(F.col("height") - 1, F.bround("y").cast("int"))))
    d = depth.select("episode", "t", F.col("x").alias("px"), F.col("y").alias("py"), "z")
    j = q.join(d, ["episode", "t", "px", "py"])
    return j.select("episode", "query_id", "t", ((F.col("x") - F.col("cx")) / F.col("fx") * F.col("z")).alias("xc"), ((F.col("y") - F.col("cy")) / F.col("fy") * F.col("z")).alias("yc"), F.col("z").alias("zc"))
