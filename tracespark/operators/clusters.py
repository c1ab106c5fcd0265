"""Operators on feature vectors: token merging, centroid assignment, temporal merging, allocation, k-means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracespark.runtime import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays; 0 where one is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), n), F.lit(0.0))


def merge_tokens(x: np.ndarray, ratio: float = 25.0) -> np.ndarray:
    """One merging round of a frame's tokens (rows): the best-matched even tokens join their odd partners' mean.

    Remaining even tokens come first, in descending order of their best similarity, then the odd ones.
    Ties go to the lower index; no more tokens merge than there are even ones.
    """
    a, b = x[0::2], x[1::2]
    r = min(int(len(x) * ratio / 100), len(a))
    if not len(b) or r <= 0:
        return x
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    sim = unit(a) @ unit(b).T
    best, to = sim.max(1), sim.argmax(1)
    order = np.argsort(-best, kind="stable")
    out, count = b.copy(), np.ones(len(b))
    np.add.at(out, to[order[:r]], a[order[:r]])
    np.add.at(count, to[order[:r]], 1)
    return np.vstack([a[order[r:]], out / count[:, None]])


def merged_tokens(tokens: DataFrame, rounds: int = 11, ratio: float = 25.0) -> DataFrame:
    """frame, token, vec after ``rounds`` merging rounds. tokens: frame, token, vec; a frame's tokens are bounded by the patch grid."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = np.array(g.sort_values("token")["vec"].tolist(), dtype=np.float64)
        for _ in range(rounds):
            x = merge_tokens(x, ratio)
        return pd.DataFrame({"frame": [key[0]] * len(x), "token": np.arange(len(x)), "vec": list(x)})

    return tokens.select("frame", "token", "vec").where("vec is not null").groupBy("frame").applyInPandas(run, f"frame {tokens.schema['frame'].dataType.simpleString()}, token bigint, vec array<double>")


def token_partners(tokens: DataFrame) -> DataFrame:
    """frame, token, partner, similarity: each even token's most similar odd token of its frame; ties to the lower one."""
    a = tokens.where("token % 2 = 0").alias("a")
    b = tokens.where("token % 2 = 1").alias("b")
    j = a.join(b, F.col("a.frame") == F.col("b.frame")).select("a.frame", "a.token", F.col("b.token").alias("partner"), cosine(F.col("a.vec"), F.col("b.vec")).alias("s"))
    best = F.max_by(F.struct("partner", "s"), F.struct("s", -F.col("partner")))
    return j.groupBy("frame", "token").agg(best.alias("m")).select("frame", "token", "m.partner", F.col("m.s").alias("similarity"))


def assign_centroids(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """vec_id, centroid, similarity: the most similar centroid; ties to the smallest id.

    Centroids are few by construction; their number is checked before they are broadcast as one array
    per row set, larger sets go through a join.
    """
    if centroids.limit(4097).count() <= 4096:
        packed = centroids.agg(F.array_sort(F.collect_list(F.struct("centroid", F.col("vec").alias("c")))).alias("cs"))
        x = vectors.crossJoin(F.broadcast(packed))  # one row, at most 4096 centroids
        best = F.array_max(F.transform("cs", lambda k: F.struct(cosine(F.col("vec"), k.c).alias("s"), (-k.centroid).alias("neg"))))
        return x.select("vec_id", best.alias("b")).select("vec_id", (-F.col("b.neg")).alias("centroid"), F.col("b.s").alias("similarity"))
    blocks = 64
    c = centroids.withColumn("blk", F.pmod(F.xxhash64("centroid"), F.lit(blocks)))
    v = vectors.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).alias("v")
    j = v.join(c.alias("c"), "blk").select("vec_id", "centroid", cosine(F.col("v.vec"), F.col("c.vec")).alias("s"))
    return j.groupBy("vec_id").agg(F.max_by(F.struct("centroid", "s"), F.struct("s", -F.col("centroid"))).alias("m")).select("vec_id", "m.centroid", F.col("m.s").alias("similarity"))


def temporal_centroids(tokens: DataFrame, threshold: float = 0.2) -> DataFrame:
    """episode, centroid, vec: vectors kept in order of frame and token when no kept one is as similar as ``threshold``.

    The scan depends on its own result, so an episode is scanned in one place; episodes are independent.
    """

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        kept: list[np.ndarray] = []
        for v in g.sort_values(["frame", "token"])["vec"]:
            v = np.asarray(v, dtype=np.float64)
            n = np.linalg.norm(v)
            if n > 0 and (not kept or max(float(v @ k) / n for k in kept) < threshold):
                kept.append(v / n)
        return pd.DataFrame({"episode": [key[0]] * len(kept), "centroid": np.arange(len(kept)), "vec": kept})

    t = tokens.select("episode", "frame", "token", "vec").where("vec is not null")
    return t.groupBy("episode").applyInPandas(run, f"episode {tokens.schema['episode'].dataType.simpleString()}, centroid bigint, vec array<double>")


def proportional_allocation(presence: DataFrame, points: int) -> DataFrame:
    """cluster, t, n: each cluster's points dealt to its frames by their share of its patches, rounded half to even; frames below one get none."""
    c = presence.groupBy("cluster", "t").agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(Window.partitionBy("cluster"))
    return c.select("cluster", "t", F.bround(F.col("c") * points / total).cast("bigint").alias("n")).where("n >= 1")


def peak_frames(presence: DataFrame) -> DataFrame:
    """cluster, t: the frame in which a cluster has the most patches, the first of several."""
    c = presence.groupBy("cluster", "t").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("cluster").agg(F.max_by("t", F.struct("c", -F.col("t"))).alias("t"))


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def kmeans(vectors: DataFrame, init: DataFrame, rounds: int, tolerance: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """(centroid, vec) after Lloyd's rounds from given starts, and (vec_id, centroid) of the last assignment.

    vectors: vec_id, vec; init: centroid, vec (few by construction). A round is one aggregation with
    map-side sums. An empty cluster becomes the zero vector. Ends early when no coordinate moves by more
    than ``tolerance``. Ties to the smallest centroid.
    """
    dim = F.size("vec")
    current = init.select("centroid", "vec")
    where = None
    for _ in range(rounds):
        packed = current.agg(F.array_sort(F.collect_list(F.struct("centroid", F.col("vec").alias("c")))).alias("cs"))
        near = F.array_min(F.transform("cs", lambda k: F.struct(_distance(F.col("vec"), k.c).alias("d"), k.centroid.alias("centroid"))))
        where = vectors.crossJoin(F.broadcast(packed)).select("vec_id", "vec", near["centroid"].alias("centroid"))
        flat = where.select("centroid", F.posexplode("vec").alias("i", "x")).groupBy("centroid", "i").agg(F.avg("x").alias("m"))
        means = flat.groupBy("centroid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("m"))
        new = current.alias("o").join(means.alias("n"), "centroid", "left").select("centroid", F.coalesce("n.m", F.transform("o.vec", lambda _: F.lit(0.0))).alias("vec"), F.array_max(F.zip_with("o.vec", F.coalesce("n.m", F.transform("o.vec", lambda _: F.lit(0.0))), lambda a, b: F.abs(a - b))).alias("moved"))
        new = cut(new)
        moved = new.agg(F.max("moved").alias("m")).first().m
        current = new.select("centroid", "vec")
        if moved is None or moved <= tolerance:
            break
    return current, where.select("vec_id", "centroid") if where is not None else vectors.select("vec_id", F.lit(None).cast("bigint").alias("centroid"))


def nearest_members(vectors: DataFrame, assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """centroid, vec_id: the member nearest to each centroid, the smallest of several."""
    j = vectors.join(assigned, "vec_id").alias("v").join(centroids.alias("c"), "centroid")
    return j.groupBy("centroid").agg(F.min_by("vec_id", F.struct(_distance(F.col("v.vec"), F.col("c.vec")), F.col("vec_id"))).alias("vec_id"))
