"""Session helpers shared by every operator: table loading, shared work folders and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` when the session has one.

    Only a session without the setting (tests, a laptop) gets a folder of its own below the
    temporary directory.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    at = spark.sparkContext.getCheckpointDir()
    if at is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trace-checkpoint-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, at: str) -> tuple:
    """The Hadoop file system of a path, and the path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: a lineage cut that keeps column pruning."""
    at = work_dir(df.sparkSession, purpose)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def parallelism(spark: SparkSession) -> int:
    """Partitions for CPU-bound stages: the shuffle setting, at least one task per core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Repartitions for a CPU-bound stage. AQE may not merge the tasks again."""
    n = parallelism(df.sparkSession)
    return df.repartition(n, *cols) if cols else df.repartition(n)


def in_order(df: DataFrame, by: list[str], amount: F.Column | None = None, purpose: str = "ordered") -> DataFrame:
    """Adds ``_before`` and ``_all``: the sum of ``amount`` (1) over the rows ahead in the order of ``by``, and over all rows.

    Rows are stored in ranges of the order, one a task, so no task sorts or holds them all; only the sums of the
    ranges meet in one place. ``by`` should tell rows apart: equal rows share a range.
    """
    df = stored(df.withColumn("_amount", F.lit(1) if amount is None else amount).repartitionByRange(parallelism(df.sparkSession), *by).withColumn("_range", F.spark_partition_id()), purpose)
    sums = df.groupBy("_range").agg(F.sum("_amount").alias("_s"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sums = sums.select("_range", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_s").over(Window.partitionBy(F.lit(0))).alias("_all"))
    inside = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(F.broadcast(sums), "_range")  # a row per range
    return joined.withColumn("_before", F.col("_ahead") + F.coalesce(F.sum("_amount").over(inside), F.lit(0))).drop("_range", "_ahead", "_amount")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of the input's (Spark compares them without case)."""
    there = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in there:
            w = "_" + w
        there.add(w.lower())
        out.append(w)
    return out


def plain(df: DataFrame, *cols: str) -> DataFrame:
    """Only the columns an operator works with, so that extra or clashing columns cannot disturb it."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def local_threads() -> None:
    """One thread per Python worker: the executor's cores are already taken by tasks."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def ship_package(spark: SparkSession) -> None:
    """Gives the Python workers this package, through the shared folder; once per Spark context."""
    import io
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_tracespark_shipped", False):
        return
    here = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/package-{uuid.uuid4().hex}/tracespark.zip")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data.getvalue()))
    finally:
        out.close()
    sc.addPyFile(at.toString())
    sc._tracespark_shipped = True
