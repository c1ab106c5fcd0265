"""Alignment of poses and scales: rigid means with rejection, depth scales, weighted fits, order statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tracespark.functions import geometry as g


@F.pandas_udf(ArrayType(DoubleType()))
def _principal(sums: pd.Series) -> pd.Series:
    """Quaternion (w, x, y, z; w not negative) nearest to those whose ten products were summed; their signs do not matter."""
    m = np.zeros((len(sums), 4, 4))
    m[(slice(None), *np.triu_indices(4))] = np.stack(sums.to_numpy()) if len(sums) else 0
    q = np.linalg.eigh(m + np.triu(m, 1).transpose(0, 2, 1))[1][:, :, -1]
    return pd.Series(list(q * np.where(q[:, :1] < 0, -1.0, 1.0)))


def _cells(c: str) -> list[Column]:
    return [F.col(c)[k] for k in range(16)]


def mean_poses(poses: DataFrame, group: str, pose: str) -> DataFrame:
    """group, mean (16 doubles), n: the mean of rigid transforms, from sums that combine map-side: of translations, and of the products of quaternions."""
    m = _cells(pose)
    q = poses.select(group, F.array(*[m[i] for i in (3, 7, 11)]).alias("t"), F.array(*g.quaternion([m[i] for i in (0, 1, 2, 4, 5, 6, 8, 9, 10)])).alias("q"))
    products = [F.sum(F.col("q")[i] * F.col("q")[j]) for i in range(4) for j in range(i, 4)]
    s = q.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.array(*products).alias("p"), *[F.avg(F.col("t")[k]).alias(f"t{k}") for k in range(3)])
    s = s.withColumn("q", _principal("p"))
    r = g.rotation([F.col("q")[k] for k in range(4)])
    rows = [x for k in range(3) for x in (*r[3 * k : 3 * k + 3], F.col(f"t{k}"))]
    return s.select(group, F.array(*rows, *[F.lit(float(x)) for x in (0, 0, 0, 1)]).alias("mean"), "n")


def align_chunks(anchors: DataFrame) -> DataFrame:
    """chunk, transform (16 doubles), n_anchors: the rigid transform that takes a chunk's source poses to the target ones.

    anchors: chunk, source, target (16 doubles each, by rows). The transform is the mean over the anchors. From four anchors on, those
    whose translation is off by the mean plus two population deviations or more are left out once, where
    residuals differ at all and some remain. Rows with a null pose are left out; a null chunk is a chunk; a chunk
    without anchors has no row. All steps are aggregations, so a chunk may have any number of anchors.
    """
    a = anchors.where("source is not null and target is not null").select(F.col("chunk").alias("c"), "source", "target")
    a = a.withColumn("each", F.array(*g.compose(_cells("target"), g.inverse_rigid(_cells("source")))))
    first = mean_poses(a, "c", "each")
    x, y = a.alias("x"), first.select(F.col("c").alias("d"), "mean", "n").where("n >= 4").alias("y")
    left = g.compose(_cells("target"), g.inverse_rigid(g.compose(_cells("mean"), _cells("source"))))
    off = x.join(y, F.col("x.c").eqNullSafe(F.col("y.d"))).select("c", "each", F.sqrt(left[3] ** 2 + left[7] ** 2 + left[11] ** 2).alias("off"))
    bound = off.groupBy(F.col("c").alias("d")).agg((F.avg("off") + 2 * F.stddev_pop("off")).alias("bound"), F.stddev_pop("off").alias("spread")).where("spread > 1e-10")
    x, y = off.alias("x"), bound.alias("y")
    kept = mean_poses(x.join(y, F.col("x.c").eqNullSafe(F.col("y.d")) & (F.col("off") < F.col("bound"))).select("c", "each"), "c", "each").select(F.col("c").alias("d"), F.col("mean").alias("again"))
    x, y = first.alias("x"), kept.alias("y")
    out = x.join(y, F.col("x.c").eqNullSafe(F.col("y.d")), "left")
    return out.select(F.col("c").alias("chunk"), F.coalesce("again", "mean").alias("transform"), F.col("n").alias("n_anchors"))


def depth_scale(pixels: DataFrame) -> DataFrame:
    """episode, scale: mean over frames of the ratio of median known to median predicted depth, where both are above 0; frames without such pixels do not count."""
    ok = pixels.where("known > 0 and pred > 0")
    per = ok.groupBy("episode", "t").agg((F.median("known") / F.median("pred")).alias("s"))
    return per.groupBy("episode").agg(F.avg("s").alias("scale"))


def order_statistic(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """The floor(share * n)-th smallest value (from 1, no interpolation) per group; null where that is 0.

    Values are counted first, so ties shrink before they are ranked.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(group).orderBy("v")
    upto = c.select(group, "v", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("hi"), F.sum("c").over(Window.partitionBy(group)).alias("n"))
    pick = [F.min(F.when((F.floor(F.col("n") * s) >= 1) & (F.col("hi") >= F.floor(F.col("n") * s)), F.col("v"))).alias(name) for name, s in shares.items()]
    return upto.groupBy(group).agg(*pick)


def weighted_median_scale(df: DataFrame, group: str, x: str, y: str, weight: str) -> DataFrame:
    """group, scale: the factor a that minimises the weighted absolute error of a x against y; rows with x = 0 have no say."""
    r = df.where(F.col(x) != 0).select(group, (F.col(y) / F.col(x)).alias("r"), (F.col(weight) * F.abs(x)).alias("w")).groupBy(group, "r").agg(F.sum("w").alias("w"))
    cum = F.sum("w").over(Window.partitionBy(group).orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    c = r.select(group, "r", cum.alias("c"), F.sum("w").over(Window.partitionBy(group)).alias("t"))
    return c.where("2 * c - t >= 0").groupBy(group).agg(F.min("r").alias("scale"))


def affine_fit(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """group, slope, intercept of the least squares line; null where x does not vary. Sums only, so it combines map-side."""
    x_, y_ = F.col(x).cast("double"), F.col(y).cast("double")
    s = df.where(x_.isNotNull() & y_.isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(x_).alias("sx"), F.sum(y_).alias("sy"), F.sum(x_ * x_).alias("sxx"), F.sum(x_ * y_).alias("sxy"))
    a = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return s.select(group, a.alias("slope"), ((F.col("sy") - a * F.col("sx")) / F.col("n")).alias("intercept"))


def weighted_means(value: Column, weight: Column, eps: float = 1e-12) -> dict[str, Column]:
    """Weighted arithmetic, harmonic and geometric mean, as aggregates."""
    w = F.greatest(F.sum(weight), F.lit(eps))
    return {"mean": F.sum(value * weight) / w, "harmonic": w / F.sum(weight / F.greatest(value, F.lit(eps))), "geometric": F.exp(F.sum(weight * F.ln(F.greatest(value, F.lit(eps)))) / w)}
