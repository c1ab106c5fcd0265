"""The tables that play tracks, cameras and frames in queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracespark.runtime import table

WIDTH, HEIGHT = 500.0, 100.0


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """events as tracks: one user is one keypoint, ordered by time."""
    e = table(spark, d, "events")
    t = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint")
    return e.select(
        (F.col("user_id") % 10).alias("episode"), F.col("user_id").alias("kp"), t.alias("t"), F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"), (1 + (F.col("event_id") % 97) / 10).alias("z"),
        (F.col("event_type") != "error").alias("visible"), F.col("event_type").alias("cluster"),
    )


def frames(tracks: DataFrame) -> DataFrame:
    return tracks.select("episode", "t").distinct()


TRK = """trk as (select user_id % 10 as episode, user_id as kp, row_number() over (partition by user_id order by ts, event_id) - 1 as t, value as x,
  cast(json_extract_string(props, '$.k') as double) as y, 1 + (event_id % 97) / cast(10 as double) as z, event_type <> 'error' as visible, event_type as cluster from events)"""
FRM = "frm as (select distinct episode, t from trk)"


def with_camera(tracks: DataFrame) -> DataFrame:
    """Adds a camera in closed form of t: focal length 100 + t, yaw 0.01 t, moving along x."""
    t = F.col("t").cast("double")
    return tracks.withColumn("fx", 100 + t).withColumn("fy", 100 + t).withColumn("cx", F.lit(320.0)).withColumn("cy", F.lit(240.0)).withColumn("yaw", 0.01 * t).withColumn("tx", 0.1 * t)


CAM = "cam as (select *, 100 + cast(t as double) as fx, 100 + cast(t as double) as fy, cast(320 as double) as cx, cast(240 as double) as cy, cast(0.01 as double) * t as yaw, cast(0.1 as double) * t as tx from trk)"


def pose() -> list:
    """The pose columns of with_camera()."""
    c, s, z, o = F.cos("yaw"), F.sin("yaw"), F.lit(0.0), F.lit(1.0)
    return [c, z, s, F.col("tx"), z, o, z, z, -s, z, c, z, z, z, z, o]


def cameras(tracks: DataFrame) -> DataFrame:
    """A table of cameras, one per episode and frame: growing focal length, rolling about the view axis, moving sideways and back."""
    t = F.col("t").cast("double")
    c, s = F.cos(0.01 * t), F.sin(0.01 * t)
    z, o = F.lit(0.0), F.lit(1.0)
    pose = F.array(c, -s, z, 0.1 * t, s, c, z, z, z, z, o, 0.01 * t, z, z, z, o)
    return tracks.select("episode", "t").distinct().select("episode", "t", (1 + 0.01 * t).alias("fx"), (1 + 0.01 * t).alias("fy"), F.lit(5.0).alias("cx"), F.lit(3.0).alias("cy"), pose.alias("pose"))


CAMT = "camt as (select distinct episode, t, 1 + cast(0.01 as double) * t as f, cast(0.01 as double) * t as roll, cast(0.1 as double) * t as tx, cast(0.01 as double) * t as tz from trk)"
_Z = "(p.z + tz)"
SEEN = f"(f * (cos(roll) * p.x - sin(roll) * p.y + tx) + 5 * {_Z}) / ({_Z} + 1e-8) as x, (f * (sin(roll) * p.x + cos(roll) * p.y) + 3 * {_Z}) / ({_Z} + 1e-8) as y, {_Z} as z"
OWN = f"{CAMT}, own as (select p.episode, kp, p.t, visible, cluster, {SEEN} from trk p join camt on p.episode = camt.episode and p.t = camt.t)"
ONE = f"{CAMT}, one as (select p.episode, kp, p.t, visible, cluster, {SEEN} from (select *, min(t) over (partition by episode, kp) as born from trk) p join camt on p.episode = camt.episode and p.born = camt.t)"
