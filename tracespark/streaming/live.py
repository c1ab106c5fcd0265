"""Streaming counterparts: noisy windows, session windows, and carried track positions with explicit state.

Event time without a zone is cast to a timestamp first, which watermarks require.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema=None, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet event files as a stream; ``ts`` becomes a timestamp."""
    schema = schema or spark.read.parquet(folder).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def noisy_windows(events: DataFrame, threshold: int, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """window_start, window_end, n, noisy of each closed window; rows later than ``lateness`` are dropped by the watermark."""
    w = events.withWatermark("ts", lateness).groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", (F.col("n") >= threshold).alias("noisy"))


def sessions(events: DataFrame, key: str, gap: str = "2 hours", lateness: str = "1 hour") -> DataFrame:
    """key, session_start, session_end, n of each closed session."""
    s = events.withWatermark("ts", lateness).groupBy(key, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def last_positions(tracks: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """episode, kp, t, x, y, z: after each micro-batch the last visible position of every point it touched.

    Late rows never replace newer ones. State is one position per point and never retires, as in the
    batch rule; ``ttl_ms`` opts into dropping points that stay silent, which changes results.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        for g in batches:
            for t, x, y, z in g.loc[g["visible"].fillna(False).astype(bool), ["t", "x", "y", "z"]].itertuples(index=False, name=None):
                if best is None or t > best[0]:
                    best = (int(t), float(x), float(y), float(z))
        if best is not None:
            state.update(best)
            if ttl_ms:
                state.setTimeoutDuration(ttl_ms)
            yield pd.DataFrame([(key[0], key[1], *best)], columns=["episode", "kp", "t", "x", "y", "z"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return tracks.groupBy("episode", "kp").applyInPandasWithState(step, "episode bigint, kp bigint, t bigint, x double, y double, z double", "t bigint, x double, y double, z double", "update", timeout)


def drain(stream: DataFrame, checkpoint: str, out: str) -> None:
    """Runs a stream over all that is there, exactly once per checkpoint, into Parquet files."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
