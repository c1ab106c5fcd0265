"""Queries p3, p5 and p6: small files, intervals and implausible measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracespark.operators.compaction import compact
from tracespark.operators.deliveries import latest_chunks
from tracespark.operators.interval_runs import interval_runs
from tracespark.operators.measurement_hmm import NORMAL, OUT, SPIKE, STUCK, fit_sources, flag_peaks, flag_trajectories
from tracespark.runtime import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    c = compact(table(spark, d, "sample_files"))
    return c.dropped.where("n_points > 0").select("file_id", "frame_index").distinct()


def p3_compacted(spark: SparkSession, d: str) -> DataFrame:
    """The consolidated table's size, the files its journal names as inputs, those it names twice, and whether it has fewer files than went in."""
    c = compact(table(spark, d, "sample_files"))
    inputs = c.journal.select(F.explode("inputs").alias("f")).where("f not like 'txn-%'").groupBy("f").agg(F.count(F.lit(1)).alias("k"))
    used = inputs.agg(F.count(F.lit(1)).alias("n_inputs"), F.count_if(F.col("k") > 1).alias("n_twice"))
    done = c.blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.size("keypoints")).cast("bigint").alias("points"), F.count_distinct("output").alias("n"))
    return done.crossJoin(used).select("blocks", "points", "n_inputs", "n_twice", (F.col("n") * 100 < F.col("n_inputs")).alias("far_fewer"))  # one row each


def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every frame block once: file, frame and number of points."""
    return compact(table(spark, d, "sample_files")).blocks.select("file_id", "frame_index", F.size("keypoints").cast("bigint").alias("n_points"))


def _held_intervals(spark: SparkSession, d: str) -> DataFrame:
    return latest_chunks(table(spark, d, "chunks"), "segment_id", "start_idx", "end_idx")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    runs = interval_runs(_held_intervals(spark, d), ["video_id", "segment_id"], "start_idx", "end_idx")
    return runs.where("kind in ('overlap', 'gap')").select("video_id", "segment_id", "kind", "first_idx", "last_idx")


def p5_periods(spark: SparkSession, d: str) -> DataFrame:
    runs = interval_runs(_held_intervals(spark, d), ["video_id", "segment_id"], "start_idx", "end_idx")
    return runs.where("kind = 'period'").select("video_id", "segment_id", "first_idx", "last_idx")


def _chunk_flags(spark: SparkSession, d: str) -> DataFrame:
    return flag_peaks(latest_chunks(table(spark, d, "chunks"), "dataset", "start_idx", "end_idx", "peak_acceleration", "mean_acceleration"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    samples = flag_trajectories(table(spark, d, "samples")).where("impossible + spike + stuck > 0")
    peaks = _chunk_flags(spark, d).where("impossible or spike or stuck")
    return samples.select(F.lit("sample").alias("record"), "video_id", F.col("sample_id").cast("bigint").alias("record_no")).distinct().unionByName(
        peaks.select(F.lit("chunk").alias("record"), "video_id", F.col("chunk_id").cast("bigint").alias("record_no"))
    )


def p6_source_report(spark: SparkSession, d: str) -> DataFrame:
    """Per dataset: samples, how many of them hold each kind of implausible reading, and the parameters fitted to it."""
    s = table(spark, d, "samples")
    fitted = fit_sources(s, "dataset")
    f = flag_trajectories(s, video="dataset", fitted=fitted)
    n = lambda c: F.count_if(F.col(c) > 0).alias(f"n_{c}")
    per = f.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_samples"), n("impossible"), n("spike"), n("stuck"))
    rows = [(k, *(float(f"{x:.4g}") for x in (m.step, m.depth_step, m.tail, m.repeat, m.depth_limit, m.a[NORMAL, SPIKE], m.a[NORMAL, STUCK], m.a[STUCK, STUCK], m.a[NORMAL, OUT]))) for k, m in fitted.items()]
    model = spark.createDataFrame(rows, "source string, step_scale double, depth_step_scale double, tail double, repeat_rate double, depth_limit double, spike_rate double, stuck_rate double, stuck_stay double, out_rate double")
    return per.join(model, per.dataset.eqNullSafe(model.source), "left").drop("source")


QUERIES = {f.__name__: f for f in (p3_found, p3_compacted, p3_blocks, p5_found, p5_periods, p6_found, p6_source_report)}

_HELD = """held as (
  select video_id, chunk_id, segment_id, start_idx, end_idx from chunks
  qualify row_number() over (partition by video_id, chunk_id order by ingested_at desc nulls last, segment_id desc nulls last, start_idx desc nulls last, end_idx desc nulls last) = 1)"""

_FRAMES = f"""with {_HELD},
frames as (select video_id, segment_id, unnest(generate_series(start_idx, end_idx)) as t from held where start_idx <= end_idx),
depth as (select video_id, segment_id, t, count(*) as n from frames group by all)"""

_BLOCKS = """with f as (
  select file_id, video_id, unnest(frame_indices) as frame_index, generate_subscripts(frame_indices, 1) as i, offsets, keypoints from sample_files),
b as (select file_id, i, video_id, frame_index, list_sort(keypoints[offsets[i] - offsets[1] + 1 : offsets[i + 1] - offsets[1]]) as pts from f),
r as (select *, min(file_id) over (partition by video_id, frame_index, pts) as first_id,
  row_number() over (partition by video_id, frame_index, pts order by file_id, i) as k from b)"""

SQL = {
    "p3_found": f"{_BLOCKS} select distinct file_id, frame_index from r where len(pts) > 0 and file_id > first_id",
    "p3_blocks": f"{_BLOCKS} select file_id, frame_index, cast(len(pts) as bigint) as n_points from r where k = 1",
    "p3_compacted": f"""{_BLOCKS} select count(*) as blocks, cast(sum(len(pts)) as bigint) as points,
  (select count(distinct file_id) from sample_files) as n_inputs, cast(0 as bigint) as n_twice, true as far_fewer from r where k = 1""",
    "p5_found": f"""{_FRAMES},
bounds as (select video_id, segment_id, min(t) as lo, max(t) as hi from depth group by all),
axis as (select video_id, segment_id, unnest(generate_series(lo, hi)) as t from bounds),
state as (select a.video_id, a.segment_id, a.t, case when n is null then 'gap' when n > 1 then 'overlap' end as kind
  from axis a left join depth d on a.video_id is not distinct from d.video_id and a.segment_id is not distinct from d.segment_id and a.t = d.t),
islands as (select *, t - row_number() over (partition by video_id, segment_id, kind order by t) as g from state where kind is not null)
select video_id, segment_id, kind, cast(min(t) as integer) as first_idx, cast(max(t) as integer) as last_idx from islands group by video_id, segment_id, kind, g""",
    "p5_periods": f"""{_FRAMES},
islands as (select *, t - row_number() over (partition by video_id, segment_id order by t) as g from depth)
select video_id, segment_id, cast(min(t) as integer) as first_idx, cast(max(t) as integer) as last_idx from islands group by video_id, segment_id, g""",
}
