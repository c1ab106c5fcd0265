"""Queries that run the streaming operators to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracespark.runtime import table, work_dir
from tracespark.streaming.live import drain, noisy_windows, sessions


def _source(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    at = work_dir(spark, name)
    drain(stream, f"{at}/checkpoint", f"{at}/out")
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def stream_noisy_windows(spark: SparkSession, d: str) -> DataFrame:
    w = _drained(spark, noisy_windows(_source(spark, d), 15), "noisy")
    return w.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _drained(spark, sessions(_source(spark, d), "user_id"), "sessions")


QUERIES = {f.__name__: f for f in (stream_noisy_windows, stream_sessions)}
# Windows that the watermark has not passed are not emitted; the SQL leaves the same open tail out.
SQL = {
    "stream_noisy_windows": """with w as (select time_bucket(interval '1 hour', ts) as b, count(*) as n from events group by 1), m as (select max(ts) - interval '1 hour' as mark from events)
select b as window_start, b + interval '1 hour' as window_end, n, n >= 15 as noisy from w, m where b + interval '1 hour' <= mark""",
}
