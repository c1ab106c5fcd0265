"""Datasets by name: how their episodes are found, named, described and read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracespark.operators.admission import episode_name, natural_key
from tracespark.sources.records import TFRecordSource
from tracespark.sources.trace_episodes import TraceEpisodeSource
from tracespark.sources.zarr_frames import ZarrFrameSource


@dataclass(frozen=True)
class Dataset:
    find: Callable[[SparkSession, str], DataFrame]  # -> path
    name: Callable[[Column], Column]
    meta: Callable[[SparkSession, str], DataFrame]  # -> path, task
    load: Callable[[SparkSession, str], DataFrame] | None = None


def register_sources(spark: SparkSession) -> None:
    for source in (TFRecordSource, ZarrFrameSource, TraceEpisodeSource):
        spark.dataSource.register(source)


def listing(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path of every file below root whose name fits; only the listing is read, not the files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")


def frame_folders(spark: SparkSession, root: str, depth: int) -> DataFrame:
    """Folders exactly ``depth`` levels below root that hold images, in order."""
    folder = F.regexp_replace("path", r"/[^/]+$", "")
    base = F.size(F.split(F.lit(root.rstrip("/")), "/"))
    files = listing(spark, root, "*.{jpg,jpeg,png,JPG,JPEG,PNG}").select(F.regexp_replace(folder, r"^file:/*", "/").alias("path"))
    return files.where(F.size(F.split("path", "/")) - base == depth).distinct().orderBy("path")


def frame_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, t of a folder's images in natural order of their names."""
    from pyspark.sql import Window

    files = listing(spark, folder, "*.{jpg,jpeg,png}").select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("n"))
    return files.select("path", (F.row_number().over(Window.orderBy(natural_key(F.col("n")), "path")) - 1).alias("t"))  # one folder


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _stem(p: Column) -> Column:
    return F.regexp_replace(p, r"\.[^./]+$", "")


def _paired(spark: SparkSession, root: str) -> DataFrame:
    """Videos with a sidecar of the same stem."""
    side = listing(spark, root, "*.hdf5").select(_stem(F.col("path")).alias("s"))
    return listing(spark, root, "*.mp4").join(side, _stem(F.col("path")) == F.col("s"), "left_semi").orderBy("path")


def _task_files(spark: SparkSession, root: str) -> DataFrame:
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "task.txt").load(root)
    return t.select(F.regexp_replace("path", "task.txt$", "obs.mp4").alias("path"), _stripped(F.decode("content", "UTF-8")).alias("task"))


def shard_episodes(info: DataFrame) -> DataFrame:
    """shard, record of every episode a dataset_info.json promises. info: its splits, read as JSON."""
    s = info.select(F.explode("splits").alias("s")).select(F.posexplode("s.shardLengths").alias("shard", "n"))
    return s.select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1)).alias("record")).where("n > 0")


def instruction_text(features: list[Column]) -> Column:
    """First non-blank step of each of several language features, without repeats, one a line."""
    first = [F.get(F.filter(F.transform(f, lambda b: _stripped(F.decode(b, "UTF-8"))), lambda x: x != ""), F.lit(0)) for f in features]
    return F.array_join(F.array_distinct(F.array_compact(F.array(*first))), "\n")


def _none(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame([], "path string, task string")


def _children_with_a_store(spark: SparkSession, root: str) -> DataFrame:
    """Folders right below root that hold a zarr.json; the arrays inside an episode have one too and are none."""
    found = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/zarr.json").select("path")
    return found.select(F.regexp_replace("path", "/zarr.json$", "").alias("path")).orderBy("path")


DATASETS = {
    "agibot": Dataset(lambda s, r: listing(s, r, "obs.mp4").orderBy("path"), lambda p: episode_name(F.lit("agibot"), p), _task_files),
    "egodex": Dataset(_paired, lambda p: episode_name(F.lit("egodex"), p), _none),
    "droid": Dataset(lambda s, r: s.read.format("tfrecord").option("path", r).load().select(F.concat_ws("::ep", "shard", "record").alias("path")), lambda p: episode_name(F.lit("droid"), p), _none, lambda s, r: s.read.format("tfrecord").option("path", r).load()),
    "egoverse": Dataset(_children_with_a_store, lambda p: episode_name(F.lit("egoverse"), p), _none, lambda s, r: s.read.format("zarr_frames").option("path", r).load()),
}


def dataset(name: str) -> Dataset:
    if name not in DATASETS:
        raise KeyError(f"unknown dataset {name}; known: {', '.join(sorted(DATASETS))}")
    return DATASETS[name]


def caption_files(spark: SparkSession, path: str) -> DataFrame:
    """episode, chunk: caption records of JSON files of either layout (a list ``chunks`` or ``chunk_texts``)."""
    j = spark.read.option("multiLine", "true").json(path)
    parts = [F.col(c) for c in ("chunks", "chunk_texts") if c in j.columns]
    return j.select("episode" if "episode" in j.columns else F.input_file_name().alias("episode"), F.explode(F.coalesce(*parts)).alias("chunk"))


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """name: the lines of an allow-list, trimmed, blank ones left out."""
    return spark.read.text(path).select(_stripped(F.col("value")).alias("name")).where("name <> ''")


def colmap_cameras(spark: SparkSession, path: str) -> DataFrame:
    """camera_id, model, width, height, params of a reconstruction's cameras.txt."""
    p = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).where("value not like '#%' and trim(value) <> ''")
    return t.select(p[0].cast("bigint").alias("camera_id"), p[1].alias("model"), p[2].cast("int").alias("width"), p[3].cast("int").alias("height"), F.transform(F.slice(p, 5, 100), lambda x: x.cast("double")).alias("params"))


def colmap_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id, q (w, x, y, z), translation, camera_id, name of an images.txt; the lines of points are left out."""
    p = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).where("value not like '#%'").where(r"value rlike '^\\s*\\d+(\\s+[-+0-9.eE]+){7}\\s+\\d+\\s+\\S*[A-Za-z]\\S*'")
    d = lambda a, n: F.transform(F.slice(p, a, n), lambda x: x.cast("double"))
    return t.select(p[0].cast("bigint").alias("image_id"), d(2, 4).alias("q"), d(6, 3).alias("translation"), p[8].cast("bigint").alias("camera_id"), p[9].alias("name"))
