"""The delivery of a keyed row that holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_deliveries(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row per key: the delivery with the greatest ``order``.

    A single map-side combined aggregation, so a key that holds a third of all rows costs one
    buffer per task. Exact duplicates collapse; a null ``order`` loses to any other; equal orders
    with different values resolve to the greatest value tuple, compared column by column as listed
    (null smallest, NaN greatest). A null key part is a key value of its own. Columns not listed are
    left out. An empty table gives an empty result.
    """
    best = F.max(F.struct(F.col(order), *[F.col(v) for v in values if v != order]))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, *[F.col("_best")[v].alias(v) for v in values])


def latest_chunks(chunks: DataFrame, *values: str) -> DataFrame:
    """chunks, keyed by (video_id, chunk_id), reduced to the delivery that holds."""
    return latest_deliveries(chunks, ["video_id", "chunk_id"], "ingested_at", list(values))
