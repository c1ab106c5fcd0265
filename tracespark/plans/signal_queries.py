"""Queries over acceleration signals and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracespark.operators import signals as op
from tracespark.operators.deliveries import latest_chunks
from tracespark.runtime import spread, table

QUERIES: dict = {}
SQL: dict = {}


def _q(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def signals(spark: SparkSession, d: str) -> DataFrame:
    a = spread(table(spark, d, "acceleration"))  # few large rows: every core gets some
    return a.select(F.col("video_id").alias("episode"), F.col("segment_id").alias("segment"), "first_idx", F.transform("acceleration", lambda x: x.cast("double")).alias("a")).where("a is not null")


_SIG = "sig as (select video_id as episode, segment_id as segment, first_idx, list_transform(acceleration, lambda x: cast(x as double)) as a from acceleration where acceleration is not null)"


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Daily events per type as keypoint counts of five episodes."""
    e = table(spark, d, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return e.groupBy(F.col("event_type").alias("episode"), day.alias("t")).agg(F.count(F.lit(1)).alias("n"))


_CNT = """cnt as (select event_type as episode, date_diff('day', date '2024-01-01', cast(ts as date)) as t, count(*) as n from events group by 1, 2),
thr as (select cast(ceil(avg(n)) as bigint) as thr from cnt)"""


def _threshold(c: DataFrame) -> int:
    return int(c.agg(F.ceil(F.avg("n")).alias("m")).first().m or 0)


_NOISY = f"""{_CNT}, span as (select episode, max(t) + 1 as n from cnt group by 1),
runs as (select episode, min(t) as s, max(t) as e from (select episode, t, t - row_number() over (partition by episode order by t) as g from cnt, thr where n >= thr) group by episode, g),
wide as (select episode, greatest(s - 1, 0) as s, least(e + 1, n - 1) as e from runs join span using (episode)),
grp as (select *, sum(new) over (partition by episode order by s, e rows unbounded preceding) as g from (select *, case when s > max(e) over (partition by episode order by s, e rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as new from wide)),
noisy as (select episode, min(s) as start_idx, max(e) as end_idx from grp group by episode, g)"""


@_q(f"with {_NOISY} select episode, start_idx, end_idx from noisy")
def noisy_intervals(spark: SparkSession, d: str) -> DataFrame:
    c = counts(spark, d)
    return op.noisy_intervals(c, _threshold(c), 1).select("episode", F.col("start_idx").cast("bigint").alias("start_idx"), F.col("end_idx").cast("bigint").alias("end_idx"))


@_q(f"""with {_NOISY}, marks as (select * from noisy union all select episode, n, n from span),
gap as (select episode, coalesce(lag(end_idx) over (partition by episode order by start_idx), -1) + 1 as s, start_idx - 1 as e from marks)
select episode, s as start_idx, e as end_idx from gap join span using (episode) where e - s + 1 >= least(2, greatest(2, n))""")
def clean_segments(spark: SparkSession, d: str) -> DataFrame:
    c = counts(spark, d)
    spans = c.groupBy("episode").agg((F.max("t") + 1).alias("n"))
    out = op.clean_segments(op.noisy_intervals(c, _threshold(c), 1), spans, 2)
    return out.select("episode", F.col("start_idx").cast("bigint").alias("start_idx"), F.col("end_idx").cast("bigint").alias("end_idx"))


_WIN = "w as (select *, len(a) as n, (greatest(3, least(11, case when len(a) % 2 = 1 then len(a) else len(a) - 1 end)) - 1) // 2 as h from sig)"


@_q(f"with {_SIG}, {_WIN} select episode, segment, list_transform(range(n), lambda i: round(list_sum(list_transform(range(-h, h + 1), lambda k: a[greatest(0, least(n - 1, i + k)) + 1])) / (2 * h + 1), 5)) as smoothed from w")
def moving_average_edge_padded(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).select("episode", "segment", F.transform(op.moving_average(F.col("a")), lambda x: F.round(x, 5)).alias("smoothed"))


_W11 = "[" + ", ".join("[" + ", ".join(f"cast({v!r} as double)" for v in r) + "]" for r in op.savgol_weights(11)) + "]"


@_q(f"with {_SIG}, {_WIN} select episode, segment, list_transform(range(len(a)), lambda i: round(list_sum(list_transform(range(11), lambda k: {_W11}[i - greatest(0, least(len(a) - 11, i - 5)) + 1][k + 1] * a[greatest(0, least(len(a) - 11, i - 5)) + k + 1])), 5)) as smoothed from sig where len(a) >= 11 union all select episode, segment, list_transform(range(n), lambda i: round(list_sum(list_transform(range(-h, h + 1), lambda k: a[greatest(0, least(n - 1, i + k)) + 1])) / (2 * h + 1), 5)) as smoothed from w where n < 11")
def savgol_smoothed(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).select("episode", "segment", F.transform(op.savgol(F.col("a")), lambda x: F.round(x, 5)).alias("smoothed"))


_PEAKS = f"""{_SIG}, s as (select *, list_min(a) as lo, list_max(a) - list_min(a) as span from sig where len(a) > 2),
t as (select episode, segment, a, lo, span, unnest(range(1, len(a) - 1)) as i from s where span >= 1e-9),
c as (select *, a[i + 1] as v from t where a[i + 1] >= lo + cast(0.4 as double) * span and a[i + 1] >= a[i] and a[i + 1] >= a[i + 2]),
b as (select *, coalesce(list_max(list_filter(range(0, i), lambda k: a[k + 1] > v)), -1) as l, coalesce(list_min(list_filter(range(i + 1, len(a)), lambda k: a[k + 1] > v)), len(a)) as r from c),
peaks as (select episode, segment, i, v, v - greatest(list_min(a[l + 2:i + 1]), list_min(a[i + 1:r])) as prominence, span from b),
kept as (select * from peaks where prominence >= cast(0.4 as double) * span)"""


@_q(f"with {_PEAKS} select episode, segment, cast(i as int) as i, v as a, round(prominence, 6) as prominence from kept")
def acceleration_peaks(spark: SparkSession, d: str) -> DataFrame:
    return op.peak_candidates(signals(spark, d)).select("episode", "segment", "i", "a", F.round("prominence", 6).alias("prominence"))


@_q(f"""with {_PEAKS}, p as (select kept.episode, kept.segment, i, lead(i) over (partition by kept.episode, kept.segment order by i) as j, a from kept join sig on kept.episode = sig.episode and kept.segment = sig.segment),
v as (select episode, segment, i, j, i + list_position(a[i + 1:j + 1], list_min(a[i + 1:j + 1])) - 1 as boundary from p where j is not null)
select episode, segment, cast(boundary as int) as boundary from v where boundary > i and boundary < j""")
def valley_boundaries(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    return op.valley_boundaries(s, op.peak_candidates(s))


@_q(None)
def motion_chunks(spark: SparkSession, d: str) -> DataFrame:
    return op.chunk_signals(signals(spark, d))


@_q(None)
def motion_chunks_robot(spark: SparkSession, d: str) -> DataFrame:
    return op.chunk_signals(signals(spark, d), op.ROBOT)


@_q(f"""with {_SIG} select episode, segment, first_idx as first, first_idx + len(a) - 1 as last, cast(0 as bigint) as n_loose, true as short_enough, round(list_max(a), 6) as peak, true as long_enough from sig where len(a) > 0 and first_idx is not null""")
def motion_chunk_tiling(spark: SparkSession, d: str) -> DataFrame:
    """Per signal: the frames its chunks cover, breaks between them, and whether every chunk keeps the shortest and the longest length."""
    p = op.GENERAL
    c = op.chunk_signals(signals(spark, d), p)
    w = Window.partitionBy("episode", "segment").orderBy("start_idx")
    n = F.col("end_idx") - F.col("start_idx") + 1
    g = c.withColumn("loose", F.coalesce(F.col("start_idx") != F.lag("end_idx").over(w) + 1, F.lit(False))).groupBy("episode", "segment")
    least = F.least(F.lit(p.min_len), F.max("end_idx") - F.min("start_idx") + 1)
    return g.agg(F.min("start_idx").alias("first"), F.max("end_idx").alias("last"), F.count_if("loose").alias("n_loose"), (F.max(n) <= p.max_len).alias("short_enough"), F.round(F.max("peak_acceleration"), 6).alias("peak"), (F.min(n) >= least).alias("long_enough"))


_HELD = """held as (select video_id as episode, chunk_id, segment_id as segment, start_idx, end_idx from chunks
  qualify row_number() over (partition by video_id, chunk_id order by ingested_at desc nulls last, segment_id desc nulls last, start_idx desc nulls last, end_idx desc nulls last) = 1)"""


def _held(spark: SparkSession, d: str) -> DataFrame:
    c = latest_chunks(table(spark, d, "chunks"), "segment_id", "start_idx", "end_idx").where("start_idx <= end_idx")
    return c.select(F.col("video_id").alias("episode"), "chunk_id", F.col("segment_id").alias("segment"), "start_idx", "end_idx")


@_q(f"""with {_SIG}, {_HELD}, c as (select h.*, a[greatest(start_idx - first_idx, 0) + 1:greatest(end_idx - first_idx + 1, 0)] as part from held h left join sig on h.episode = sig.episode and h.segment = sig.segment where start_idx <= end_idx)
select episode, chunk_id, coalesce(list_max(part), 0) as peak, round(coalesce(list_sum(part) / nullif(len(part), 0), 0), 5) as mean from c""")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return op.chunk_stats(_held(spark, d), signals(spark, d)).select("episode", "chunk_id", "peak", F.round("mean", 5).alias("mean"))


@_q(f"""with {_HELD}, f as (select distinct video_id as episode, frame_index as t from samples)
select f.episode, f.t, max(chunk_id) as chunk_id from f join held h on f.episode = h.episode and f.t between start_idx and end_idx group by 1, 2""")
def frame_to_chunk_interval_join(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "samples").select(F.col("video_id").alias("episode"), F.col("frame_index").alias("t")).distinct()
    return op.frame_chunk(_held(spark, d), f)


@_q("""with span as (select video_id as episode, max(n_frames) as n from episodes where n_frames > 0 group by 1), k as (select *, least(n, 60) as k, (n + 59) // 60 as c from span),
t as (select distinct episode, n, c, unnest(case when k <= 1 then [0] else list_transform(range(k), lambda i: i * (n - 1) // (k - 1)) end) as t from k)
select episode, cast(t as bigint) as t, cast(least(t // 60, c - 1 - case when n % 60 = 1 and c > 1 then 1 else 0 end) as bigint) as chunk from t""")
def sparse_anchor_join(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "episodes").where("n_frames > 0").groupBy(F.col("video_id").alias("episode")).agg(F.max("n_frames").alias("n"))
    return op.sparse_anchors(spans, 60, 60).select("episode", F.col("t").cast("bigint").alias("t"), F.col("chunk").cast("bigint").alias("chunk"))
