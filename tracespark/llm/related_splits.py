"""Train, validation and test labels that keep related records together.

Records and the entities they belong to form a bipartite graph; minimum labels travel record -> entity
-> record until nothing changes, so every connected component carries one label. Components are then
dealt to the splits within their stratum, each to where the label mix of the splits deviates least: the
few components above a share of their stratum first, all others in independent buckets of bounded size.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracespark.operators.deliveries import latest_deliveries
from tracespark.runtime import stored

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
LARGE_SHARE = 0.001
BUCKET_GROUPS = 2000
ID_BLOCK = 4096

# Words that say what kind of name it is or where it lay, not which recording it names.
_GENERIC = {"data", "raw", "shard", "episode", "ep", "part", "task", "clip"}
_EXPORT_MARK = re.compile(r"(?:\s*\(\d+\)|_copy|\.(?:mp4|hdf5|npz|mov|avi|mkv|webm|zarr))$", re.IGNORECASE)


def recording_key(name: str, dataset: str | None) -> str:
    """What a spelling of a recording's name says: its words without order, its numbers in order.

    Width variants, case, separators, leading zeros, folders, file endings and copy marks make no
    difference. A name without words and numbers keeps its own spelling as key.
    """
    s = unicodedata.normalize("NFKC", name).strip().rstrip("/\\").strip()
    while (t := _EXPORT_MARK.sub("", s).strip()) != s and t:
        s = t
    generic = _GENERIC | ({dataset.lower()} if dataset else set())
    words = []
    for w in re.findall(r"[^\W\d_]+", s):
        if w.lower() in generic:
            continue
        words += [x for x in re.findall(r"[^\W\d_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", w).lower()) if x not in generic]
    numbers = [str(int(n)) for n in re.findall(r"[0-9]+", s)]
    if not words and not numbers:
        return "=" + name
    return " ".join(sorted(words)) + "|" + " ".join(numbers)


def recording_entities(chunks: DataFrame) -> DataFrame:
    """Edges ``dataset, video_id, entity`` of recordings: the key of the spelling, and fingerprints of the content; 128 bits each.

    A re-export under another name shares content. One chunk may agree by chance, so an entity is two chunks
    at once: each (start_idx, end_idx, mean_acceleration) together with the one that follows, and with the one
    after that, by chunk_id. A copy that lost some of its chunks still shares the pairs of those it kept. The only
    chunk of a recording is fingerprinted with its peak. Of each chunk_id the delivery that holds counts; null is a chunk_id that
    comes first; a chunk without start_idx, end_idx or mean_acceleration does not count for content. A null video_id is no
    recording and has no edges. An empty table gives no edges.

    A long recording spreads over blocks of ``ID_BLOCK`` ids that overlap by two ids; chunks further apart than that over an edge are no pair.
    """

    @F.pandas_udf("string")
    def key(names: pd.Series, datasets: pd.Series) -> pd.Series:
        return pd.Series([recording_key(n, d) for n, d in zip(names, datasets)], dtype=object)

    wide = lambda *parts: F.struct(F.xxhash64(F.lit(3), *parts).alias("a"), F.xxhash64(F.lit(5), *parts).alias("b"))
    rows = chunks.select("dataset", "video_id", "chunk_id", "start_idx", "end_idx", "mean_acceleration", "peak_acceleration", "ingested_at").where("video_id is not null")
    named = rows.groupBy("dataset", "video_id").agg(F.lit(1)).select("dataset", "video_id", wide(F.lit("name"), key("video_id", "dataset")).alias("entity"))
    at = F.coalesce(F.col("chunk_id").cast("bigint"), F.lit(-1))
    block = F.floor(at / ID_BLOCK)
    both = F.when(F.pmod(at, F.lit(ID_BLOCK)) < 2, F.array(block, block - 1)).otherwise(F.array(block))
    full = rows.where("start_idx is not null and end_idx is not null and mean_acceleration is not null").withColumn("block", F.explode(both))
    # One shuffle for the deliveries and for the order within a block.
    held = latest_deliveries(full.repartition("dataset", "video_id", "block"), ["dataset", "video_id", "block", "chunk_id"], "ingested_at", ["start_idx", "end_idx", "mean_acceleration", "peak_acceleration"])
    w = Window.partitionBy("dataset", "video_id", "block").orderBy(at)
    chunk, own = F.struct("start_idx", "end_idx", "mean_acceleration"), block == F.col("block")
    seen = held.select("dataset", "video_id", own.alias("own"), chunk.alias("x"), "peak_acceleration", F.lead(chunk, 1).over(w).alias("y"), F.lead(chunk, 2).over(w).alias("z"))
    pair = lambda other: F.when(F.col(other).isNotNull(), wide(F.lit("pair"), "x.start_idx", "x.end_idx", "x.mean_acceleration", f"{other}.start_idx", f"{other}.end_idx", f"{other}.mean_acceleration"))
    seen = stored(seen.where("own").select("dataset", "video_id", F.array_compact(F.array(pair("y"), pair("z"))).alias("pairs"), wide(F.lit("only"), "x.start_idx", "x.end_idx", "x.mean_acceleration", F.col("peak_acceleration").isNull(), "peak_acceleration").alias("only")), "content")
    single = seen.groupBy("dataset", "video_id").agg(F.count(F.lit(1)).alias("n"), F.first("only").alias("entity")).where("n = 1").drop("n")
    return named.unionByName(seen.select("dataset", "video_id", F.explode("pairs").alias("entity"))).unionByName(single)


def components(edges: DataFrame, scope: str, record: str, entity: str) -> DataFrame:
    """Connected components of the record-entity graph: ``scope, record, label``, label the smallest record name.

    Labels only meet within one ``scope`` value (null is one). A round lets the smallest label of each entity
    reach its records and the records that gave them their labels, then lets every record take its label's
    label: distances double, so rounds grow with the logarithm of the longest chain, and they end only
    when no label changed. The aggregations combine map-side, so an entity with a third of all records costs
    one buffer per task. Repeated edges change nothing; edges with a null record or entity are left out.
    """
    e = stored(edges.select(F.col(scope).alias("s"), F.col(record).alias("r"), F.col(entity).alias("e")).where("r is not null and e is not null"), "edges")
    # An entity of one record links nothing; the record itself stays.
    linking = e.groupBy("s", "e").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo < hi").select("s", "e")
    labels = stored(e.select("s", "r", F.col("r").alias("label")).distinct(), "labels")
    x, y = e.alias("x"), linking.alias("y")
    e = stored(x.join(y, F.col("x.s").eqNullSafe(F.col("y.s")) & (F.col("x.e") == F.col("y.e")), "left_semi").distinct(), "edges")
    while True:
        x, y = e.alias("x"), labels.alias("y")
        known = x.join(y, F.col("x.s").eqNullSafe(F.col("y.s")) & (F.col("x.r") == F.col("y.r"))).select("x.s", "x.r", "x.e", "y.label")
        low = known.groupBy("s", "e").agg(F.min("label").alias("low")).alias("y")
        x = known.alias("x")
        told = x.join(low, F.col("x.s").eqNullSafe(F.col("y.s")) & (F.col("x.e") == F.col("y.e"))).where("low < label")
        told = told.select("x.s", F.explode(F.array("x.r", "x.label")).alias("r"), "low").groupBy("s", "r").agg(F.min("low").alias("low"))
        x, y = labels.alias("x"), told.alias("y")
        new = stored(x.join(y, F.col("x.s").eqNullSafe(F.col("y.s")) & (F.col("x.r") == F.col("y.r")), "left").select("x.s", "x.r", F.least("label", "low").alias("label"), (F.col("low") < F.col("label")).alias("moved")), "labels")
        if not new.where("moved").limit(1).count():
            return new.select(F.col("s").alias(scope), F.col("r").alias(record), "label")
        x, y = new.alias("x"), new.select("s", "r", F.col("label").alias("low")).alias("y")
        labels = stored(x.join(y, F.col("x.s").eqNullSafe(F.col("y.s")) & (F.col("x.label") == F.col("y.r"))).select("x.s", "x.r", F.col("low").alias("label")), "labels")


def deal_groups(counts: np.ndarray, want: np.ndarray, have: np.ndarray) -> np.ndarray:
    """The split of each group, given in order; ``have`` is updated.

    counts: (groups, labels) rows of each group. want, have: (splits, labels) rows that each split should
    get and has. Each group goes where the summed relative deviation from ``want``, over all labels and over
    the rows as a whole, falls most or grows least; of equals to the split that should get most.
    """
    out = np.zeros(len(counts), np.int64)
    scale = np.maximum(want, 1e-9)
    whole = scale.sum(1)
    order = np.argsort(-want.sum(1), kind="stable")
    for i, c in enumerate(counts):
        # change of sum (have - want)^2 / want when the group is added
        cost = ((2 * (have - want) + c) * c / scale).sum(1) + (2 * (have.sum(1) - want.sum(1)) + c.sum()) * c.sum() / whole
        k = order[int(np.argmin(cost[order]))]
        have[k] += c
        out[i] = k
    return out


def assign_splits(groups: DataFrame, stratum: str, group: str, label: str, size: str, proportions: dict[str, float] | None = None, large_share: float = LARGE_SHARE, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """``stratum, group, split`` for groups given as ``stratum, group, label, size``: rows of each label.

    Within each stratum every split gets its share of the rows of every label, as nearly as whole groups
    allow. Groups of at least ``large_share`` of a stratum's rows, at most 1 / large_share per stratum, are
    dealt first, in one task a stratum; the others by hash in buckets of about ``bucket_groups`` groups, each
    towards what the large ones left over. Nothing is brought to the driver, and neither the number of strata
    nor of groups is limited. Labels of a stratum are taken to be few (they are columns of a matrix). Null
    strata, groups and labels are values of their own; null and negative sizes count as 0. Repeated rows add
    up. An empty table gives an empty result.
    """
    proportions = proportions or PROPORTIONS
    splits, share = list(proportions), np.array(list(proportions.values()), float)
    n = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    kind_s, kind_g = (groups.schema[c].dataType.simpleString() for c in (stratum, group))
    cells = groups.select(F.col(stratum).alias("s"), F.col(group).alias("g"), F.col(label).cast("string").alias("l"), n.alias("n")).groupBy("s", "g", "l").agg(F.sum("n").alias("n"))
    g = stored(cells.groupBy("s", "g").agg(F.sum("n").alias("n"), F.collect_list(F.struct("l", "n")).alias("cells")), "groups")
    totals = g.groupBy("s").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    x, y = g.alias("x"), totals.alias("y")
    marked = x.join(y, F.col("x.s").eqNullSafe(F.col("y.s"))).select("x.s", "g", "n", "cells", "k", ((F.col("n") > 1) & (F.col("n") >= large_share * F.col("all"))).alias("large"))

    def matrix(rows: pd.DataFrame, names: list) -> np.ndarray:
        at = {l: i for i, l in enumerate(names)}
        m = np.zeros((len(rows), len(names)))
        for i, cs in enumerate(rows["cells"]):
            for c in cs:
                m[i, at[c["l"]]] += c["n"]
        return m

    def labels_of(rows: pd.DataFrame) -> list:
        return sorted({c["l"] for cs in rows["cells"] for c in cs}, key=lambda l: (l is not None, l))

    def in_order(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_g=rows["g"].astype(str))
        return rows.sort_values(["n", "_g"], ascending=[False, True], kind="stable").reset_index(drop=True)

    def none(x):
        return None if x is None or x != x else x

    def deal_large(rows: pd.DataFrame) -> pd.DataFrame:
        rows = in_order(rows)
        all_ = rows[rows["g_total"]]
        named = [c["l"] for c in all_["cells"].iloc[0]]
        total = np.array([c["n"] for c in all_["cells"].iloc[0]], float)
        rows = rows[~rows["g_total"]]
        have = np.zeros((len(splits), len(named)))
        to = deal_groups(matrix(rows, named), share[:, None] * total[None], have)
        # What each split still needs of each label, for the buckets.
        left = np.maximum(share[:, None] * total[None] - have, 0)
        left = np.where(left.sum(0) > 0, left / np.maximum(left.sum(0), 1e-9), share[:, None])
        s = none(all_["s"].iloc[0])
        out = [(s, none(a), splits[t], None, None) for a, t in zip(rows["g"], to)] + [(s, None, None, l, left[:, i].tolist()) for i, l in enumerate(named)]
        return pd.DataFrame(out, columns=["s", "g", "split", "l", "left"])

    per_label = cells.groupBy("s", "l").agg(F.sum("n").alias("n")).groupBy("s").agg(F.collect_list(F.struct("l", "n")).alias("cells"))
    first = marked.where("large").select("s", "g", "n", "cells", F.lit(False).alias("g_total")).unionByName(per_label.select("s", F.lit(None).cast(kind_g).alias("g"), F.lit(0).cast("bigint").alias("n"), "cells", F.lit(True).alias("g_total")))
    dealt = stored(first.groupBy("s").applyInPandas(deal_large, f"s {kind_s}, g {kind_g}, split string, l string, left array<double>"), "dealt")
    rest = dealt.where("left is not null").groupBy("s").agg(F.collect_list(F.struct("l", "left")).alias("rest"))

    def deal_small(rows: pd.DataFrame) -> pd.DataFrame:
        rows = in_order(rows)
        named = labels_of(rows)
        m = matrix(rows, named)
        left = {r["l"]: np.asarray(r["left"], float) for r in rows["rest"].iloc[0]}
        want = np.stack([left[l] for l in named], 1) * m.sum(0)[None]
        to = deal_groups(m, want, np.zeros_like(want))
        return pd.DataFrame({"s": rows["s"], "g": rows["g"], "split": [splits[t] for t in to]})

    x, y = marked.where("not large").alias("x"), rest.alias("y")
    bucket = F.pmod(F.xxhash64("g"), F.greatest(F.lit(1), F.ceil(F.col("k") / bucket_groups)))
    small = x.join(y, F.col("x.s").eqNullSafe(F.col("y.s"))).select("x.s", "g", "n", "cells", "rest", bucket.alias("b"))
    split_small = small.groupBy("s", "b").applyInPandas(deal_small, f"s {kind_s}, g {kind_g}, split string")
    return dealt.where("split is not null").select("s", "g", "split").unionByName(split_small).select(F.col("s").alias(stratum), F.col("g").alias(group), "split")


def motion_class(acceleration) -> F.Column:
    """Label of a chunk by its mean acceleration: the octave, 26 values; ``none`` without a usable reading."""
    x = acceleration.cast("double")
    usable = x.isNotNull() & ~F.isnan(x) & (x > 0)
    return F.when(usable, F.greatest(F.lit(-12), F.least(F.lit(12), F.floor(F.log2(F.when(usable, x))))).cast("string")).otherwise(F.lit("none"))


def recordings(chunks: DataFrame) -> DataFrame:
    """``dataset, video_id, recording``: every spelling with the smallest spelling of its recording."""
    return components(recording_entities(chunks), "dataset", "video_id", "entity").withColumnRenamed("label", "recording")


def split_chunks(chunks: DataFrame, proportions: dict[str, float] | None = None, **options) -> DataFrame:
    """``video_id, chunk_id, dataset, recording, motion, split`` of every distinct key of chunks.

    All spellings of a recording of one dataset share a split; the splits of a dataset agree in their mix of
    motion classes. A key delivered more than once has the class of the delivery that holds. Chunks with a
    null video_id belong to no recording: each dataset's are kept together as one group. Deterministic for the
    same rows.
    """
    keyed = latest_deliveries(chunks, ["dataset", "video_id", "chunk_id"], "ingested_at", ["mean_acceleration"])
    k, c = keyed.alias("k"), recordings(chunks).alias("c")
    named = k.join(c, F.col("k.dataset").eqNullSafe(F.col("c.dataset")) & (F.col("k.video_id") == F.col("c.video_id")), "left").select("k.dataset", "k.video_id", "k.chunk_id", F.coalesce("c.recording", F.lit("")).alias("recording"), motion_class(F.col("mean_acceleration")).alias("motion"))
    named = stored(named, "recordings")
    sizes = named.groupBy("dataset", "recording", "motion").agg(F.count(F.lit(1)).alias("n"))
    split = assign_splits(sizes, "dataset", "recording", "motion", "n", proportions, **options)
    n, s = named.alias("n"), split.alias("s")
    return n.join(s, F.col("n.dataset").eqNullSafe(F.col("s.dataset")) & (F.col("n.recording") == F.col("s.recording"))).select("n.video_id", "n.chunk_id", "n.dataset", "n.recording", "n.motion", "s.split")


def same_recording(chunks: DataFrame) -> DataFrame:
    """``video_id_a, video_id_b``: different spellings of one recording of one dataset, smaller first; once per pair.

    Pairs are formed among the spellings of one recording only; recordings() gives each spelling once.
    """
    comp = recordings(chunks)
    a, b = comp.alias("a"), comp.alias("b")
    on = F.col("a.dataset").eqNullSafe(F.col("b.dataset")) & (F.col("a.recording") == F.col("b.recording")) & (F.col("a.video_id") < F.col("b.video_id"))
    return a.join(b, on).select(F.col("a.video_id").alias("video_id_a"), F.col("b.video_id").alias("video_id_b")).distinct()
