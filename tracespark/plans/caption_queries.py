"""Queries over captions, clusters, retargeting, alignment and admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracespark.operators import admission as ad
from tracespark.operators import alignment as al
from tracespark.operators import captions as cp
from tracespark.operators import clusters as cl
from tracespark.operators import retarget as rt
from tracespark.operators.tracks import moving_tracks, track_diameter
from tracespark.plans.signal_queries import _HELD, _held
from tracespark.plans.standins import HEIGHT, TRK, WIDTH, tracks
from tracespark.runtime import table

QUERIES: dict = {}
SQL: dict = {}


def _q(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Captions -----------------------------------------------------------------------------------------


@_q(f"""with {TRK}, e as (select episode as g, cluster, kp, arg_min(x, t) as x0, arg_min(y, t) as y0, arg_max(x, t) as x1, arg_max(y, t) as y1 from trk group by 1, 2, 3),
s as (select g, cluster, avg(sqrt(power(x1 - x0, 2) + power(y1 - y0, 2))) * sqrt(count(*)) as score, count(*) as n from e group by 1, 2)
select g as "group", arg_min(cluster, (-round(score, 9), cluster)) as cluster, round(max(score), 5) as score from s where n >= 4 group by 1""")
def dominant_cluster(spark: SparkSession, d: str) -> DataFrame:
    p = tracks(spark, d).groupBy(F.col("episode").alias("group"), "cluster", "kp").agg(F.min_by("x", "t").alias("x0"), F.min_by("y", "t").alias("y0"), F.max_by("x", "t").alias("x1"), F.max_by("y", "t").alias("y1"))
    return cp.dominant_cluster(p).select("group", "cluster", F.round("score", 5).alias("score"))


_WINDOWS = f"""{_HELD}, c as (select *, count(*) over (partition by episode, segment) as n, lead(chunk_id) over w as c1, lead(chunk_id, 2) over w as c2, lead(end_idx) over w as e1, lead(end_idx, 2) over w as e2
  from held where start_idx <= end_idx window w as (partition by episode, segment order by chunk_id)),
win as (select episode, segment, 'pair' as merge_type, [chunk_id, c1] as source_chunk_ids, start_idx, e1 as end_idx from c where c1 is not null
  union all select episode, segment, 'triple', [chunk_id, c1, c2], start_idx, e2 from c where c2 is not null
  union all select episode, segment, 'full', list_sort(list(chunk_id)), arg_min(start_idx, chunk_id), arg_max(end_idx, chunk_id) from c where n = 1 or n >= 4 group by 1, 2)"""


@_q(f"with {_WINDOWS} select episode, merge_type, source_chunk_ids, start_idx, end_idx, merge_type || ':' || array_to_string(source_chunk_ids, '-') as cache_key from win")
def pair_triple_full_windows(spark: SparkSession, d: str) -> DataFrame:
    w = cp.merge_windows(_held(spark, d))
    return w.select("episode", "merge_type", "source_chunk_ids", "start_idx", "end_idx", cp.window_key(F.col("merge_type"), F.col("source_chunk_ids")).alias("cache_key"))


def _captions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "curated_training_texts").withColumnRenamed("video_id", "episode").drop("exported_at", "export_version", "source").distinct()


_CAP = "cap as (select distinct video_id as episode, chunk_id, start_idx, end_idx, instruction_1, instruction_2, instruction_3, embodiment_type, task_type, skill_labels, complexity_tier, error, short_description from curated_training_texts)"
_EVENT = "case when error is null then coalesce(case when trim(instruction_1) <> '' then instruction_1 end, case when trim(instruction_2) <> '' then instruction_2 end, case when trim(instruction_3) <> '' then instruction_3 end, '') else '' end"


@_q(f"with {_CAP} select distinct episode, chunk_id, start_idx, end_idx, {_EVENT} as event, coalesce(skill_labels, []) as labels from cap")
def merge_inputs(spark: SparkSession, d: str) -> DataFrame:
    return cp.merge_input(_captions(spark, d)).distinct()


@_q(f"with {_CAP} select distinct episode, [chunk_id] as source_chunk_ids, start_idx, end_idx, {_EVENT} as instruction, coalesce(skill_labels, []) as skill_labels, 1 as n_events from cap")
def single_chunk_merge_synthesis(spark: SparkSession, d: str) -> DataFrame:
    return cp.single_chunk_windows(cp.merge_input(_captions(spark, d))).select("episode", "source_chunk_ids", "start_idx", "end_idx", "instruction", "skill_labels", F.size("timeline").alias("n_events")).distinct()


@_q(f"""with {_CAP} select episode, count(distinct chunk_id) as n_chunks, list_sort(list(distinct chunk_id)) as chunk_ids from cap group by 1""")
def training_export(spark: SparkSession, d: str) -> DataFrame:
    return cp.training_export(_captions(spark, d)).select("episode", "n_chunks", F.transform("chunks", lambda c: c.chunk_id).alias("chunk_ids"))


@_q(None)
def training_export_json(spark: SparkSession, d: str) -> DataFrame:
    """The lean export, one JSON document per episode."""
    return cp.training_export(_captions(spark, d)).select("episode", F.to_json(F.struct("n_chunks", "n_errors", "chunks"), {"ignoreNullFields": "false"}).alias("document"))


_NORM = "trim(regexp_replace(lower(short_description), '\\s+', ' ', 'g'))"


@_q(f"""with t as (select distinct video_id as episode, chunk_id, short_description from curated_training_texts), n as (select *, {_NORM} as k from t),
p as (select *, lag(k) over (partition by episode order by chunk_id) as p from n) select episode, chunk_id, short_description as text from p where k <> '' and k = p""")
def adjacent_duplicate_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "curated_training_texts").select(F.col("video_id").alias("episode"), "chunk_id", F.col("short_description").alias("text")).distinct()
    return cp.adjacent_duplicates(t)


@_q("""with r as (select doc_id, trim(text) as t, regexp_extract(text, '(\\{.*\\})', 1, 's') as inner_part from documents where text is not null)
select doc_id, (json_valid(t) and t like '{%') or (inner_part <> '' and json_valid(inner_part)) as repaired from r""")
def caption_json_repair(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    reply = F.concat(F.lit("```json\n"), "text", F.lit("\n```"))
    return docs.select("doc_id", cp.repaired_json(reply).isNotNull().alias("repaired"))


@_q("with e as (select video_id, max(n_frames) as n, max(cam_trans_total) as m from episodes group by 1) select video_id, case when n >= 30 and m >= cast(0.5 as float) then 'complex' else 'simple' end as tier from e")
def complexity_tier(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "episodes").groupBy("video_id").agg(F.max("n_frames").alias("n"), F.max("cam_trans_total").alias("m"))
    return e.select("video_id", cp.complexity_tier(F.col("n"), F.col("m"), 30, 0.5).alias("tier"))


# Clusters -----------------------------------------------------------------------------------------


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 50).alias("frame"), (F.col("vec_id") % 50).alias("token"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "vec_id", "label")


_TOK = "tok as (select vec_id // 50 as frame, vec_id % 50 as token, list_transform(embedding, lambda x: cast(x as double)) as vec, vec_id, label from embeddings)"
_COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


@_q(f"""with {_TOK}, s as (select a.frame, a.token, b.token as partner, {_COS.format(a='a.vec', b='b.vec')} as s from tok a join tok b on a.frame = b.frame and a.token % 2 = 0 and b.token % 2 = 1),
r as (select *, row_number() over (partition by frame, token order by s desc, partner) as k from s) select frame, token, partner, round(s, 6) as similarity from r where k = 1""")
def token_partners(spark: SparkSession, d: str) -> DataFrame:
    return cl.token_partners(_tokens(spark, d)).select("frame", "token", "partner", F.round("similarity", 6).alias("similarity"))


@_q(None)
def token_merge_11_rounds(spark: SparkSession, d: str) -> DataFrame:
    return cl.merged_tokens(_tokens(spark, d)).select("frame", "token", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@_q(f"""with {_TOK}, c as (select label as centroid, vec from tok qualify row_number() over (partition by label order by vec_id) = 1),
s as (select t.vec_id, c.centroid, {_COS.format(a='t.vec', b='c.vec')} as s from tok t cross join c), r as (select *, row_number() over (partition by vec_id order by s desc, centroid) as k from s)
select vec_id, centroid, round(s, 6) as similarity from r where k = 1""")
def centroid_assignment(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    c = t.groupBy("label").agg(F.min_by("vec", "vec_id").alias("vec")).select(F.col("label").alias("centroid"), "vec")
    return cl.assign_centroids(t.select("vec_id", "vec"), c).select("vec_id", "centroid", F.round("similarity", 6).alias("similarity"))


@_q(None)
def temporal_centroid_merge(spark: SparkSession, d: str) -> DataFrame:
    return cl.temporal_centroids(_tokens(spark, d).withColumn("episode", F.col("label")), 0.35).select("episode", "centroid")


@_q("""with c as (select cluster_id as cluster, frame_index as t, count(*) as c from samples where cluster_id is not null group by 1, 2), n as (select cluster, t, cast(round_even(c * cast(5000 as double) / sum(c) over (partition by cluster), 0) as bigint) as n from c) select * from n where n >= 1""")
def proportional_allocation(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").where("cluster_id is not null").select(F.col("cluster_id").alias("cluster"), F.col("frame_index").alias("t"))
    return cl.proportional_allocation(s, 5000)


@_q("with c as (select cluster_id as cluster, frame_index as t, count(*) as c from samples where cluster_id is not null group by 1, 2) select cluster, t from c qualify row_number() over (partition by cluster order by c desc, t) = 1")
def cluster_peak_frames(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").where("cluster_id is not null").select(F.col("cluster_id").alias("cluster"), F.col("frame_index").alias("t"))
    return cl.peak_frames(s)


_KM = f"""{_TOK}, c0 as (select label as centroid, vec as c from tok qualify row_number() over (partition by label order by vec_id) = 1),
a0 as (select t.vec_id, t.vec, arg_min(centroid, (list_sum(list_transform(list_zip(t.vec, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), centroid)) as centroid from tok t cross join c0 group by 1, 2),
f as (select centroid, unnest(range(64)) as i, vec from a0), m as (select centroid, i, avg(vec[i + 1]) as m from f group by 1, 2), c1 as (select centroid, list(m order by i) as c from m group by 1),
a1 as (select t.vec_id, arg_min(centroid, (list_sum(list_transform(list_zip(t.vec, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), centroid)) as centroid from tok t cross join c1 group by 1)"""


@_q(f"with {_KM} select vec_id, centroid from a1")
def kmeans_lloyd_fixed_init(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    init = t.groupBy("label").agg(F.min_by("vec", "vec_id").alias("vec")).select(F.col("label").alias("centroid"), "vec")
    return cl.kmeans(t.select("vec_id", "vec"), init, 2)[1]


@_q(None)
def kmeans_nearest_members(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    init = t.groupBy("label").agg(F.min_by("vec", "vec_id").alias("vec")).select(F.col("label").alias("centroid"), "vec")
    c, where = cl.kmeans(t.select("vec_id", "vec"), init, 5)
    return cl.nearest_members(t.select("vec_id", "vec"), where, c)


# Retargeting --------------------------------------------------------------------------------------

_STEP = f"""{TRK}, l as (select episode, kp, t, sqrt(power((lead(x) over w - x) / {WIDTH}, 2) + power((lead(y) over w - y) / {HEIGHT}, 2) + power(lead(z) over w - z, 2)) as len from trk window w as (partition by episode, kp order by t)),
k as (select *, row_number() over (partition by episode, t order by len desc, kp) as rank, greatest(1, ceil(cast(0.02 as double) * count(*) over (partition by episode, t))) as k from l where len is not null),
r as (select episode, t, avg(len) as r from k where rank <= k group by 1, 2)"""


@_q(f"with {_STEP} select episode, t, round(r, 6) as r from r")
def robust_segment_length(spark: SparkSession, d: str) -> DataFrame:
    return rt.robust_step_length(tracks(spark, d), WIDTH, HEIGHT).select("episode", "t", F.round("r", 6).alias("r"))


# Alignment and fits -------------------------------------------------------------------------------


@_q(f"""with {TRK}, a as (select distinct episode, t, floor(t / 60) as k from trk)
select episode || '/' || cast(k as bigint) as chunk, list_transform([cos(yaw), 0, sin(yaw), k * 0.5, 0, 1, 0, -0.25, -sin(yaw), 0, cos(yaw), 1.5, 0, 0, 0, 1], lambda x: round(cast(x as double), 5) + 0) as transform, count(*) as n_anchors
from (select *, cast(0.2 as double) + cast(0.1 as double) * k as yaw from a) group by episode, k, yaw""")
def se3_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of anchors moved by a known turn and shift: the alignment must find them."""
    from tracespark.functions import geometry as g
    from tracespark.plans.standins import pose, with_camera

    c = with_camera(tracks(spark, d).select("episode", "t").distinct())
    m = pose()
    k = F.floor(F.col("t") / 60)
    yaw = 0.2 + 0.1 * k
    move = [F.cos(yaw), F.lit(0.0), F.sin(yaw), k * 0.5, F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(-0.25), -F.sin(yaw), F.lit(0.0), F.cos(yaw), F.lit(1.5), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    a = c.select(F.concat_ws("/", "episode", k).alias("chunk"), F.array(*m).alias("source"), F.array(*g.compose(move, m)).alias("target"))
    return al.align_chunks(a).select("chunk", F.transform("transform", lambda x: F.round(x, 5) + 0.0).alias("transform"), "n_anchors")


@_q("""with p as (select l_suppkey as episode, month(l_shipdate) as t, l_extendedprice as known, l_quantity as pred from lineitem), m as (select episode, t, median(known) / median(pred) as s from p where known > 0 and pred > 0 group by 1, 2)
select episode, round(avg(s), 4) as scale from m group by 1""")
def depth_scale_median(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("episode"), F.month("l_shipdate").alias("t"), F.col("l_extendedprice").alias("known"), F.col("l_quantity").alias("pred"))
    return al.depth_scale(p).select("episode", F.round("scale", 4).alias("scale"))


_OS = """o as (select l_returnflag, l_extendedprice as v, row_number() over (partition by l_returnflag order by l_extendedprice) as k, count(*) over (partition by l_returnflag) as n from lineitem),
q as (select l_returnflag, max(case when k = cast(floor(n * cast(0.25 as double)) as bigint) then v end) as q25, max(case when k = cast(floor(n * cast(0.75 as double)) as bigint) then v end) as q75 from o group by 1)"""


@_q(f"with {_OS} select l_returnflag, q25, q75 from q")
def order_statistic_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return al.order_statistic(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", {"q25": 0.25, "q75": 0.75})


@_q(f"with {_OS} select l_returnflag, count(*) as n_kept from lineitem join q using (l_returnflag) where l_extendedprice >= 1e-7 and l_extendedprice <= q75 + 1.5 * (q75 - q25) group by 1")
def iqr_roi_filter(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    q = al.order_statistic(li, "l_returnflag", "l_extendedprice", {"q25": 0.25, "q75": 0.75})
    kept = li.join(q, "l_returnflag").where("l_extendedprice >= 1e-7 and l_extendedprice <= q75 + 1.5 * (q75 - q25)")
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_kept"))


@_q("""with r as (select l_suppkey, l_extendedprice / l_quantity as r, sum((1 + l_discount) * abs(l_quantity)) as w from lineitem where l_quantity <> 0 group by 1, 2),
c as (select *, sum(w) over (partition by l_suppkey order by r rows unbounded preceding) as c, sum(w) over (partition by l_suppkey) as t from r) select l_suppkey, round(min(r), 6) as scale from c where 2 * c - t >= 0 group by 1""")
def weighted_l1_scale(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("w", 1 + F.col("l_discount"))
    return al.weighted_median_scale(li, "l_suppkey", "l_quantity", "l_extendedprice", "w").select("l_suppkey", F.round("scale", 6).alias("scale"))


@_q("select l_suppkey, round((count(*) * sum(l_quantity * l_extendedprice) - sum(l_quantity) * sum(l_extendedprice)) / (count(*) * sum(l_quantity * l_quantity) - sum(l_quantity) * sum(l_quantity)), 3) as slope from lineitem group by 1")
def affine_lstsq(spark: SparkSession, d: str) -> DataFrame:
    return al.affine_fit(table(spark, d, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice").select("l_suppkey", F.round("slope", 3).alias("slope"))


@_q("select l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 3) as mean, round(sum(l_quantity) / sum(l_quantity / l_extendedprice), 3) as harmonic, round(exp(sum(l_quantity * ln(l_extendedprice)) / sum(l_quantity)), 3) as geometric from lineitem group by 1")
def weighted_means(spark: SparkSession, d: str) -> DataFrame:
    m = al.weighted_means(F.col("l_extendedprice"), F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[F.round(c, 3).alias(n) for n, c in m.items()])


# Admission ----------------------------------------------------------------------------------------


@_q("select distinct video_id from episodes where video_id in (select trim(video_id) from chunks where chunk_id > 10)")
def allowlist_semijoin(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "chunks").where("chunk_id > 10").select(F.col("video_id").alias("name"))
    return ad.allow_listed(table(spark, d, "episodes").select("video_id").distinct(), names, "video_id")


@_q("""with l as (select video_id, case when count(error) = 0 then 'done' else 'low_coverage' end as status, avg(case when error is null then 1 else 0 end) as coverage from curated_training_texts group by 1)
select distinct video_id from episodes e where not exists (select 1 from l where l.video_id = e.video_id and (status = 'done' or coverage < 0.9))""")
def incremental_skip_antijoin(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "curated_training_texts").groupBy(F.col("video_id").alias("episode")).agg(F.when(F.count("error") == 0, "done").otherwise("low_coverage").alias("status"), F.avg(F.when(F.col("error").isNull(), 1).otherwise(0)).alias("coverage"))
    return ad.still_to_do(table(spark, d, "episodes").select("video_id").distinct(), c, 0.9, "video_id")


@_q("with l as (select video_id as episode, case when error is null then 'done' else 'failed' end as status, exported_at as happened from curated_training_texts), m as (select episode, status from l qualify row_number() over (partition by episode order by happened desc nulls last, status desc) = 1) select status, count(*) as n_episodes from m group by 1")
def ledger_summary(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "curated_training_texts").select(F.col("video_id").alias("episode"), F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), F.lit(None).cast("double").alias("coverage"), F.col("exported_at").alias("at"))
    return ad.run_summary(ad.ledger_upsert(c.limit(0), c))


@_q("select doc_id, md5('7/' || doc_id) as order_key from documents order by order_key, doc_id limit 25")
def seeded_sample_limit(spark: SparkSession, d: str) -> DataFrame:
    return ad.seeded_first(table(spark, d, "documents"), "doc_id", 7, 25)


@_q("with k as (select distinct video_id from episodes), n as (select video_id, row_number() over (order by video_id) - 1 as i, count(*) over () as n from k) select video_id from n where floor(i * 4 / n) = 1")
def shard_slice(spark: SparkSession, d: str) -> DataFrame:
    return ad.shard_of(table(spark, d, "episodes"), "video_id", 2, 4)


@_q("with a as (select s_suppkey, row_number() over (order by s_suppkey) as position from supplier), b as (select s_name, row_number() over (order by s_name) as position from supplier) select position, s_suppkey, s_name from a join b using (position)")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return ad.positional_pairs(s, s, "s_suppkey", "s_name")


@_q("select distinct c_name, lpad(regexp_extract(c_name, '(\\d+)$', 1), 20, '0') as digits from customer")
def natural_sort_names(spark: SparkSession, d: str) -> DataFrame:
    k = ad.natural_key(F.col("c_name"))
    return table(spark, d, "customer").select("c_name", F.substring(k, -20, 20).alias("digits")).distinct()


@_q("select distinct dataset, path, case when dataset = 'agibot' then string_split(path, '/')[-2] when dataset = 'egodex' then string_split(path, '/')[-3] || '__' || string_split(path, '/')[-2] || '__' || regexp_replace(string_split(path, '/')[-1], '\\.\\w+$', '') when dataset = 'droid' then 'droid_shard' || lpad(regexp_extract(path, 'shard-0*(\\d+)', 1), 5, '0') || '_ep' || case when length(regexp_extract(path, 'ep_?0*(\\d+)', 1)) >= 3 then regexp_extract(path, 'ep_?0*(\\d+)', 1) else lpad(regexp_extract(path, 'ep_?0*(\\d+)', 1), 3, '0') end else regexp_replace(string_split(path, '/')[-1], '\\.\\w+$', '') end as name from sample_files where path is not null")
def path_episode_naming(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "sample_files").where("path is not null").select("dataset", "path").distinct()
    return f.select("dataset", "path", ad.episode_name(F.col("dataset"), F.col("path")).alias("name"))


@_q("""with h as (select p_partkey, sha256('hash_randint_7_' || p_partkey) as h, sha256('hash_random_7_' || p_partkey) as u from part),
n as (select p_partkey, list_reduce(list_transform(range(16), lambda i: cast('0x' || substr(h, 4 * i + 1, 4) as bigint)), lambda a, b: (a * 65536 + b) % 1000) as r,
  list_transform(range(8), lambda i: cast(cast('0x' || substr(u, 8 * i + 1, 8) as bigint) as double)) as w from h)
select p_partkey, cast(r - 500 as bigint) as number, round(case when d < 0 then d + 1 else d end, 9) as unit from (select *, (w[5] - w[1]) / 4294967296 + (w[6] - w[2]) / power(2, 64) + (w[7] - w[3]) / power(2, 96) as d from n)""")
def stable_hash_int(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", ad.stable_int(k, -500, 500, 7).alias("number"), F.round(ad.stable_unit(k, 7), 9).alias("unit"))


@_q("""with m as (select p_brand as item, sum(p_size) as w from part group by 1), c as (select item, sum(w) over (order by item rows unbounded preceding) as c, sum(w) over () as t from m),
u as (select distinct doc_id as draw, (doc_id % 1000) / cast(1000 as double) as u from documents) select draw, arg_min(item, c) as item from u join c on c.c >= u * t group by 1""")
def weighted_sampler(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").groupBy(F.col("p_brand").alias("item")).agg(F.sum("p_size").alias("w"))
    draws = table(spark, d, "documents").select(F.col("doc_id").alias("draw"), ((F.col("doc_id") % 1000) / 1000).alias("u")).distinct()
    return ad.weighted_choice(items, draws, "item", "w")


@_q("""with e as (select video_id, max(width) as w, max(height) as h from episodes group by 1)
select dataset, count(*) as n_samples, count(*) filter (keypoint_x < 0 or keypoint_y < 0 or keypoint_x >= w or keypoint_y >= h) as n_outside, count(*) filter (w is null or h is null) as n_unsized
from samples left join e using (video_id) group by 1""")
def output_audit(spark: SparkSession, d: str) -> DataFrame:
    """Samples, how many anchors lie outside their recording's frame (half open), and how many have no known frame, per dataset."""
    e = table(spark, d, "episodes").groupBy("video_id").agg(F.max("width").alias("w"), F.max("height").alias("h"))
    s = table(spark, d, "samples").join(e, "video_id", "left")
    x, y = F.col("keypoint_x"), F.col("keypoint_y")
    return s.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_samples"), F.count_if((x < 0) | (y < 0) | (x >= F.col("w")) | (y >= F.col("h"))).alias("n_outside"), F.count_if(F.col("w").isNull() | F.col("h").isNull()).alias("n_unsized"))
