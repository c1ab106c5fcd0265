"""Operators on captions of chunks: dominant cluster, windows, merge inputs, exports, repair and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dominant_cluster(points: DataFrame, least: int = 4) -> DataFrame:
    """group, cluster, score: per group the cluster with the greatest mean displacement times the root of its size.

    points: group, cluster, x0, y0, x1, y1 (start and end; points with a null or non-finite value are
    left out). Clusters with fewer than ``least`` points do not compete; a group without any has no
    row. Ties go to the smallest cluster.
    """
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x0", "y0", "x1", "y1")]
    dist = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    s = points.where(ok[0] & ok[1] & ok[2] & ok[3]).groupBy("group", "cluster").agg(F.avg(dist).alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    s = s.withColumn("score", F.col("m") * F.sqrt("n"))
    return s.groupBy("group").agg(F.min_by(F.struct("cluster", "score"), F.struct(-F.col("score"), F.col("cluster"))).alias("b")).select("group", "b.cluster", "b.score")


def complexity_tier(frames: Column, displacement: Column, min_frames: int = 30, min_displacement: float = 5.0) -> Column:
    """``complex`` for chunks long and lively enough to show a middle frame, else ``simple``."""
    return F.when((frames >= min_frames) & (displacement >= min_displacement), "complex").otherwise("simple")


def merge_windows(chunks: DataFrame) -> DataFrame:
    """episode, segment, merge_type, source_chunk_ids, start_idx, end_idx: neighbouring pairs, triples and the full segment, each set of chunks once.

    A segment of one chunk gives one ``full``; of two, one ``pair``; of three, two pairs and a triple.
    Pairs and triples look at most two chunks ahead; only the full window of a segment gathers its ids.
    """
    w = Window.partitionBy("episode", "segment").orderBy("chunk_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("episode", "segment"))
    row = chunks.select(
        "episode", "segment", "chunk_id", "start_idx", n.alias("n"), F.row_number().over(w).alias("k"),
        F.lead("chunk_id", 1).over(w).alias("c1"), F.lead("chunk_id", 2).over(w).alias("c2"), F.col("end_idx").alias("e0"), F.lead("end_idx", 1).over(w).alias("e1"), F.lead("end_idx", 2).over(w).alias("e2"),
    )
    cols = ["episode", "segment", "merge_type", "source_chunk_ids", "start_idx", "end_idx"]
    pair = row.where("c1 is not null").select("episode", "segment", F.lit("pair").alias("merge_type"), F.array("chunk_id", "c1").alias("source_chunk_ids"), "start_idx", F.col("e1").alias("end_idx"))
    triple = row.where("c2 is not null").select("episode", "segment", F.lit("triple").alias("merge_type"), F.array("chunk_id", "c1", "c2").alias("source_chunk_ids"), "start_idx", F.col("e2").alias("end_idx"))
    full = row.where("n = 1 or n >= 4").groupBy("episode", "segment").agg(F.array_sort(F.collect_list("chunk_id")).alias("source_chunk_ids"), F.min_by("start_idx", "k").alias("start_idx"), F.max_by("e0", "k").alias("end_idx")).withColumn("merge_type", F.lit("full"))
    return pair.select(cols).unionByName(triple.select(cols)).unionByName(full.select(cols))


def window_key(merge_type: Column, ids: Column) -> Column:
    """Cache key of a window: its type and its chunks."""
    return F.concat(merge_type, F.lit(":"), F.array_join(F.transform(ids, lambda x: x.cast("string")), "-"))


def normalised(text: Column) -> Column:
    """Lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def adjacent_duplicates(texts: DataFrame) -> DataFrame:
    """episode, chunk_id, text of chunks that say the same as the chunk before; blank texts never do."""
    w = Window.partitionBy("episode").orderBy("chunk_id")
    t = texts.select("episode", "chunk_id", "text", normalised(F.col("text")).alias("k"))
    return t.withColumn("p", F.lag("k").over(w)).where("k <> '' and k = p").select("episode", "chunk_id", "text")


def repaired_json(text: Column) -> Column:
    """The object inside a model's reply: fences and back-ticks off, else the widest braces; null where that is no JSON."""
    t = F.trim(text)
    fenced = F.regexp_extract(t, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    bare = F.trim(F.when(fenced != "", fenced).otherwise(t), F.lit("`"))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.expr("true") & F.try_parse_json(c).isNotNull()
    return F.when(ok(bare) & bare.startswith("{"), bare).when((inner != "") & ok(inner), inner)


def first_text(*cols: Column) -> Column:
    """The first that is neither null nor blank; the empty string without any."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols], F.lit(""))


def merge_input(captions: DataFrame) -> DataFrame:
    """episode, chunk_id, start_idx, end_idx, event, labels: what a merge is told about a chunk; failed captions tell nothing."""
    return captions.select(
        "episode", "chunk_id", "start_idx", "end_idx",
        F.when(F.col("error").isNull(), first_text(F.col("instruction_1"), F.col("instruction_2"), F.col("instruction_3"))).otherwise("").alias("event"),
        F.coalesce("skill_labels", F.array().cast("array<string>")).alias("labels"),
    )


def single_chunk_windows(inputs: DataFrame) -> DataFrame:
    """Windows of one chunk need no merge: the chunk's own text is the window's, with a timeline of one event."""
    return inputs.select("episode", F.array("chunk_id").alias("source_chunk_ids"), "start_idx", "end_idx", F.col("event").alias("instruction"), F.col("labels").alias("skill_labels"), F.array(F.struct("chunk_id", "start_idx", "end_idx", "event")).alias("timeline"))


def training_export(captions: DataFrame) -> DataFrame:
    """episode, n_chunks, n_errors, chunks: an episode's caption records in order, with defaults for what is missing.

    Rows repeated under one (episode, chunk_id) collapse to the greatest record. The records of one
    episode form one row, as in the exported file.
    """
    rec = F.struct(
        "chunk_id", "start_idx", "end_idx",
        F.array(*[F.coalesce(f"instruction_{i}", F.lit("")) for i in (1, 2, 3)]).alias("instructions"),
        F.coalesce("embodiment_type", F.lit("unknown")).alias("embodiment_type"), F.coalesce("task_type", F.lit("unknown")).alias("task_type"),
        F.coalesce("skill_labels", F.array().cast("array<string>")).alias("skill_labels"), F.coalesce("complexity_tier", F.lit("simple")).alias("complexity_tier"), "error",
    )
    one = captions.groupBy("episode", "chunk_id").agg(F.max(rec).alias("r"))
    return one.groupBy("episode").agg(F.count(F.lit(1)).alias("n_chunks"), F.count("r.error").alias("n_errors"), F.array_sort(F.collect_list("r")).alias("chunks"))


def data_url(image: Column, kind: str = "png") -> Column:
    return F.concat(F.lit(f"data:image/{kind};base64,"), F.regexp_replace(F.base64(image), r"\s", ""))
