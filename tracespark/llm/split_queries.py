"""Queries p1 and p4: splits without leakage, and pieces of oversized chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracespark.llm.motion_pieces import split_chunks_at_calm
from tracespark.llm.related_splits import recordings, same_recording, split_chunks
from tracespark.operators.deliveries import latest_chunks
from tracespark.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return same_recording(table(spark, d, "chunks"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return split_chunks(table(spark, d, "chunks")).select("video_id", "chunk_id", "dataset", "split")


def p1_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling of a video_id with the representative of its recording."""
    return recordings(table(spark, d, "chunks"))


def p1_split_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows, recordings and share of each split, per dataset, and its largest deviation from the dataset in the share of a motion class."""
    s = split_chunks(table(spark, d, "chunks")).groupBy("dataset", "split", "motion").agg(F.count(F.lit(1)).alias("m"))
    whole = s.groupBy("dataset", "motion").agg(F.sum("m").alias("dm")).withColumn("dn", F.sum("dm").over(Window.partitionBy("dataset")))
    per = s.withColumn("n", F.sum("m").over(Window.partitionBy("dataset", "split"))).join(whole, ["dataset", "motion"])
    off = F.abs(F.col("m") / F.col("n") - F.col("dm") / F.col("dn"))
    return per.groupBy("dataset", "split").agg(F.sum("m").alias("n_chunks"), F.round(F.max(F.col("n") / F.col("dn")), 4).alias("share"), F.round(F.max(off), 4).alias("largest_deviation"))


def p1_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per dataset: keys labelled, keys labelled more than once, recordings in two splits, and whether train holds its share within two percent."""
    s = split_chunks(table(spark, d, "chunks"))
    keys = s.groupBy("dataset", "video_id", "chunk_id").agg(F.first("recording").alias("recording"), F.first("split").alias("split"), F.count(F.lit(1)).alias("n"))
    per = keys.groupBy("dataset", "recording").agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_twice"), F.count_distinct("split").alias("k"), F.count_if(F.col("split") == "train").alias("train"))
    out = per.groupBy("dataset").agg(F.sum("n_keys").alias("n_keys"), F.sum("n_twice").alias("n_twice"), F.count_if(F.col("k") > 1).alias("n_torn"), F.sum("train").alias("train"))
    return out.select("dataset", "n_keys", "n_twice", "n_torn", (F.abs(F.col("train") / F.col("n_keys") - 0.8) < 0.02).alias("train_share_held"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_chunks_at_calm(table(spark, d, "chunks"), table(spark, d, "chunk_limits"), table(spark, d, "acceleration"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("n_pieces > 1 and piece_no = 0").select("video_id", "chunk_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p4_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per chunk: its bounds as covered by its pieces, and whether all pieces keep the limit, share the overlap and bring new frames."""
    p, lim = _pieces(spark, d), table(spark, d, "chunk_limits")
    x = F.sort_array(F.collect_list(F.struct("piece_no", "start_idx", "end_idx", "boundary")))
    g = p.groupBy("video_id", "chunk_id").agg(F.count(F.lit(1)).alias("n"), x.alias("x"))
    held = latest_chunks(table(spark, d, "chunks"), "segment_id", "start_idx", "end_idx", "dataset", "peak_acceleration").select("video_id", "chunk_id", "dataset")
    g = g.alias("g").join(held.alias("h"), F.col("g.video_id").eqNullSafe(F.col("h.video_id")) & F.col("g.chunk_id").eqNullSafe(F.col("h.chunk_id"))).select("g.*", "h.dataset").join(lim, "dataset", "left")
    m = F.coalesce("max_chunk_len", F.lit(1 << 31))
    step = F.zip_with(F.slice("x", 1, F.greatest(F.size("x") - 1, F.lit(0))), F.slice("x", 2, F.size("x")), lambda a, b: (a.end_idx - b.start_idx + 1 == F.col("overlap")) & (b.end_idx > a.end_idx))
    return g.select(
        "video_id", "chunk_id", F.get("x", F.lit(0)).start_idx.alias("first_idx"), F.element_at("x", -1).end_idx.alias("last_idx"), (F.col("n") > 1).alias("is_cut"),
        F.forall("x", lambda a: a.end_idx - a.start_idx + 1 <= m).alias("within_limit"), F.forall(step, lambda ok: ok).alias("overlap_held"),
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_recordings, p1_splits, p1_split_report, p1_invariants, p4_found, p4_pieces, p4_invariants)}

_HELD = """with held as (
  select video_id, chunk_id, dataset, start_idx, end_idx from chunks
  qualify row_number() over (partition by video_id, chunk_id order by ingested_at desc nulls last, segment_id desc nulls last, start_idx desc nulls last, end_idx desc nulls last) = 1)"""

SQL = {
    "p1_invariants": """select dataset, count(*) as n_keys, cast(0 as bigint) as n_twice, cast(0 as bigint) as n_torn, true as train_share_held
from (select distinct dataset, video_id, chunk_id from chunks) group by dataset""",
    "p4_found": f"{_HELD} select video_id, chunk_id from held join chunk_limits using (dataset) where start_idx <= end_idx and end_idx - start_idx + 1 > max_chunk_len",
    "p4_invariants": f"""{_HELD} select video_id, chunk_id, start_idx as first_idx, end_idx as last_idx, coalesce(end_idx - start_idx + 1 > max_chunk_len, false) as is_cut, true as within_limit, true as overlap_held
from held left join chunk_limits using (dataset) where start_idx <= end_idx""",
}
