"""Size-tiered incremental compaction of tiny frame files into few well-sized ones, with an idempotent journal.

A compacted table is a folder. Each run takes the files that no committed run has consumed, and the files of
earlier runs that are still small, and deals them to lanes of a bounded number of files and bytes. Inside a
lane, files of one size tier (powers of ``fanout``) merge ``fanout`` at a time, tier by tier; what new files
leave over at the end merges too, while small files of earlier runs wait for enough of their own size. Every
merge is a journal row with its inputs, its output and a transaction id derived from the inputs. A merge
whose output merges on within the same run is carried out together with the merge that follows it.

A run writes its fingerprints and frames into a folder of its own attempt and its journal last, which one
rename makes visible. A run that dies before leaves nothing that counts: its files are still unconsumed. Reading
goes through the journal, so an output that a later run merged on, or that no journal names, is never read.

A frame block is (video, frame, its keypoints in any order). Exactly one delivery of a block survives,
the one of the smallest file id (then the earliest place in that file); a block that an earlier run wrote
stays, and whatever delivers it again does not survive.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracespark.runtime import file_system, stored, work_dir

TARGET_BYTES = 128 << 20
FANOUT = 8
LANE_FILES = 1 << 16
MADE = "txn-"  # names of outputs; other inputs are file ids

JOURNAL = "lane bigint, txn string, level int, inputs array<string>, output string, in_bytes bigint, final boolean"
COMMITTED = f"{JOURNAL}, attempt string"
MARKS = "kept boolean, file_id {kind}, name string, rid bigint, place int, video_id string, frame_index int, n_points int, h1 bigint, h2 bigint, first_file_id {kind}, attempt string"


@dataclass
class Compaction:
    """A compacted table; every part is a table, and only what a committed run wrote counts."""

    root: str
    spark: SparkSession
    file_kind: str
    block_schema: str

    def _runs(self) -> list[str]:
        fs, path = file_system(self.spark, f"{self.root}/journal")
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    @property
    def journal(self) -> DataFrame:
        """One row per merge: lane, txn, level, inputs, output, in_bytes, final, attempt (the folder of its frames)."""
        runs = self._runs()
        if not runs:
            return self.spark.createDataFrame([], COMMITTED)
        return self.spark.read.schema(COMMITTED).parquet(*[f"{self.root}/journal/{r}" for r in runs])

    @property
    def outputs(self) -> DataFrame:
        """attempt, output, in_bytes: the consolidated files that hold now."""
        j = self.journal
        return j.where("final").select("attempt", "output", "in_bytes").join(j.select(F.explode("inputs").alias("output")).where(F.col("output").startswith(MADE)), "output", "left_anti").select("attempt", "output", "in_bytes")

    def _part(self, name: str, schema: str) -> DataFrame:
        """A part as the committed attempts wrote it."""
        fs, path = file_system(self.spark, f"{self.root}/{name}")
        if not fs.exists(path) or not self._runs():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").join(self.journal.select("attempt").distinct(), "attempt", "left_semi")

    @property
    def marks(self) -> DataFrame:
        """Every delivery of a block: its fingerprint, whether it was kept, and the file that delivered the block first."""
        return self._part("marks", MARKS.format(kind=self.file_kind))

    @property
    def blocks(self) -> DataFrame:
        """output, video_id, frame_index, keypoints, file_id: every frame block exactly once."""
        held = self._part("frames", f"{self.block_schema}, attempt string, output string")
        return held.join(self.outputs.select("attempt", "output"), ["attempt", "output"], "left_semi").select("output", "video_id", "frame_index", "keypoints", "file_id")

    @property
    def dropped(self) -> DataFrame:
        """file_id, video_id, frame_index, n_points, first_file_id: deliveries of a block that a smaller file id had delivered before."""
        return self.marks.where("not kept and file_id > first_file_id").select("file_id", "video_id", "frame_index", "n_points", "first_file_id").distinct()

    def commit(self, attempt: str) -> None:
        """Makes the journal of an attempt visible, in one step."""
        fs, _ = file_system(self.spark, self.root)
        to = file_system(self.spark, f"{self.root}/journal/run-{len(self._runs()):06d}")[1]
        fs.mkdirs(to.getParent())
        if fs.exists(to) or not fs.rename(file_system(self.spark, f"{self.root}/pending/{attempt}")[1], to):
            raise RuntimeError(f"another run has committed to {self.root}")


def frame_blocks(files: DataFrame, *also: str) -> DataFrame:
    """file_id, place, video_id, frame_index, keypoints and the columns ``also``: the blocks of each file.

    The i-th frame owns the keypoints from offsets[i] - offsets[0] up to offsets[i+1] - offsets[0].
    A file whose lists are null has no blocks; a frame whose offsets are missing or null has no
    keypoints. Other columns are ignored.
    """
    at = lambda i: F.get("offsets", i).cast("bigint") - F.get("offsets", F.lit(0)).cast("bigint")
    lo = F.greatest(F.coalesce(at(F.col("place")), F.lit(0)), F.lit(0)).cast("int")
    hi = F.coalesce(at(F.col("place") + 1), F.lit(0)).cast("int")
    kps = F.coalesce("keypoints", F.array().cast(files.schema["keypoints"].dataType))
    return (
        files.select("file_id", "video_id", "offsets", "keypoints", *also, F.posexplode("frame_indices").alias("place", "frame_index"))
        .select("file_id", "place", "video_id", "frame_index", *also, F.when(hi > lo, F.slice(kps, lo + 1, hi - lo)).otherwise(F.slice(kps, 1, 0)).alias("keypoints"))
    )


def block_identity(blocks: DataFrame) -> DataFrame:
    """Adds h1, h2 (128 bits over video, frame and the sorted keypoints), so that only fingerprints are shuffled.

    -0.0 equals 0.0 and NaN equals NaN; a null coordinate equals a null one.
    """
    pts = F.array_sort(F.transform("keypoints", lambda p: F.struct((p.x + F.lit(0.0).cast("float")).alias("x"), (p.y + F.lit(0.0).cast("float")).alias("y"))))
    with_pts = blocks.withColumn("_pts", pts)
    # xxhash64 skips nulls, so a flag per coordinate keeps (null, 1) and (1, null) apart.
    flags = F.transform("_pts", lambda p: F.struct(p.x.isNull().alias("a"), p.y.isNull().alias("b")))
    parts = [F.col("video_id").isNull(), F.col("video_id"), F.col("frame_index").isNull(), F.col("frame_index"), F.size("_pts"), F.col("_pts"), flags]
    return with_pts.withColumn("h1", F.xxhash64(F.lit(11), *parts)).withColumn("h2", F.xxhash64(*parts, F.lit(23))).drop("_pts")


def merge_plan(sizes: list[tuple[str, int]], lane: int, target: int, fanout: int) -> list[tuple]:
    """The journal rows of one lane, for files and outputs of earlier runs (named ``txn-...``).

    Files merge within their tier. What new files leave over in a tier moves up and merges at the end; an
    output of an earlier run that finds too few of its size stays as it is and has no row.
    """
    tier = lambda n: len(_powers(max(n, 1), fanout))
    earlier = {f for f, _ in sizes if f.startswith(MADE)}
    by_tier: dict[int, list[tuple[str, int]]] = {}
    for f in sorted(sizes, key=lambda x: (x[0] not in earlier, x[0])):
        by_tier.setdefault(tier(f[1]), []).append(f)
    rows: list[tuple] = []
    done: list[tuple[str, int]] = []

    def merge(group: list[tuple[str, int]], level: int) -> tuple[str, int]:
        names = [g[0] for g in group]
        txn = hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()[:24]
        rows.append((lane, txn, level, names, f"{MADE}{txn}", sum(g[1] for g in group), False))
        return f"{MADE}{txn}", rows[-1][5]

    level = 0
    while by_tier:
        t = min(by_tier)
        files = by_tier.pop(t)
        level += 1
        waiting: list[tuple[str, int]] = []
        for f in files:
            if f[1] >= target:
                done.append(f)
                continue
            waiting.append(f)
            if len(waiting) == fanout or sum(w[1] for w in waiting) >= target:
                out = merge(waiting, level)
                waiting = []
                if out[1] >= target:
                    done.append(out)
                else:
                    by_tier.setdefault(max(tier(out[1]), t + 1), []).append(out)
        waiting = [w for w in waiting if w[0] not in earlier]
        if waiting:
            if by_tier:  # the rest moves up a tier and merges with what is there
                by_tier.setdefault(min(by_tier), []).extend(waiting)
            elif len(waiting) == 1 and waiting[0][0].startswith(MADE):
                done.append(waiting[0])
            else:
                done.append(merge(waiting, level))
    outputs = {d[0] for d in done}
    rows = [(*r[:6], r[4] in outputs) for r in rows]
    single = lambda f: hashlib.sha256(f.encode()).hexdigest()[:24]
    rows += [(lane, single(f[0]), 0, [f[0]], f"{MADE}{single(f[0])}", f[1], True) for f in done if not f[0].startswith(MADE)]
    return rows


def _powers(n: int, fanout: int) -> list[int]:
    out = []
    while n >= fanout:
        n //= fanout
        out.append(n)
    return out


def compact(files: DataFrame, root: str | None = None, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, lane_files: int = LANE_FILES) -> Compaction:
    """One run of compaction of files (file_id, video_id, frame_indices, offsets, keypoints, n_bytes) into ``root``.

    root: the folder of the compacted table, by default a fresh one of the session's shared folder. Files that a
    committed run consumed are not compacted again: the same files once more are no new run. target_bytes:
    wanted size of a consolidated file. fanout: files of a tier that merge at once. lane_files: most files
    planned together, which bounds what one planning task holds. One run at a time may write to a root.

    Null or negative n_bytes count as 0. Files without lists hold no blocks; they are in the journal
    as inputs. Rows repeated under one file_id count as deliveries of the same file: their blocks
    survive once and none is a later delivery. Rows without a file_id are one file, "null" in the journal,
    which comes after all others; its repeats of their blocks do not survive and are no later deliveries. An empty table gives empty tables. Other columns are
    ignored.
    """
    spark = files.sparkSession
    root = root or work_dir(spark, "compaction")
    kind = files.schema["file_id"].dataType.simpleString()
    c = Compaction(root, spark, kind, f"video_id string, frame_index int, keypoints {files.schema['keypoints'].dataType.simpleString()}, file_id {kind}")
    attempt = uuid.uuid4().hex
    name = F.coalesce(F.col("file_id").cast("string"), F.lit("null"))  # in the journal
    rid = F.xxhash64(F.col("video_id").isNull(), "video_id", "frame_indices", "offsets", "keypoints")  # tells apart rows of one file_id
    rows = files.select("file_id", "video_id", "frame_indices", "offsets", "keypoints", "n_bytes", name.alias("name"), rid.alias("rid"))
    before = bool(c._runs())
    if before:
        used = c.journal.select(F.explode("inputs").alias("name")).where(~F.col("name").startswith(MADE)).distinct()
        rows = rows.join(used, "name", "left_anti")

    sizes = rows.groupBy("name").agg(F.greatest(F.coalesce(F.max("n_bytes"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_bytes"))
    total = sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()
    if before and not total.n:
        return c
    lanes = max(1, -(-total.n // lane_files), int(total.b // (target_bytes * 16)))
    if before:
        sizes = sizes.unionByName(c.outputs.where(F.col("in_bytes") < target_bytes).select(F.col("output").alias("name"), F.col("in_bytes").alias("n_bytes")))

    def plan(key: tuple, rows):
        import pandas as pd

        out = merge_plan([(str(i), int(n)) for i, n in zip(rows["name"], rows["n_bytes"])], int(key[0]), target_bytes, fanout)
        return pd.DataFrame(out, columns=["lane", "txn", "level", "inputs", "output", "in_bytes", "final"])

    lane = F.pmod(F.xxhash64("name"), F.lit(lanes))
    planned = stored(sizes.select(lane.alias("lane"), "name", "n_bytes").groupBy("lane").applyInPandas(plan, JOURNAL), "plan")

    # Which final output each file ends in: follow the merges upwards, one level a step; lanes keep it narrow.
    def ends(key: tuple, rows):
        import pandas as pd

        made = set(rows["output"])
        parent = {i: o for ins, o in zip(rows["inputs"], rows["output"]) for i in ins}
        out = []
        for leaf in [i for i in parent if i not in made]:
            at = parent[leaf]
            while at in parent:
                at = parent[at]
            out.append((leaf, at))
        return pd.DataFrame(out, columns=["name", "output"])

    home = stored(planned.groupBy("lane").applyInPandas(ends, "name string, output string"), "home")

    # Fingerprints are computed once; points do not travel with them.
    seen = frame_blocks(rows.select("*"), "name", "rid")
    ids = stored(block_identity(seen).select("file_id", "name", "rid", "place", "video_id", "frame_index", F.size("keypoints").alias("n_points"), "h1", "h2"), "fingerprints")
    # Exact copies of a hot block combine map-side.
    first = ids.groupBy("h1", "h2").agg(F.min(F.struct(F.col("file_id").isNull().alias("unnamed"), "file_id", "place", "rid")).alias("f"))
    if before:
        old = c.marks.where("kept").select("h1", "h2", F.col("file_id").alias("old_file"), F.lit(True).alias("old"))
        first = first.join(old, ["h1", "h2"], "left")
    else:
        first = first.withColumn("old_file", F.lit(None).cast(kind)).withColumn("old", F.lit(None).cast("boolean"))
    is_first = F.col("old").isNull() & F.col("file_id").eqNullSafe(F.col("f.file_id")) & (F.col("place") == F.col("f.place")) & (F.col("rid") == F.col("f.rid"))
    marked = ids.join(first, ["h1", "h2"]).select(is_first.alias("kept"), "file_id", "name", "rid", "place", "video_id", "frame_index", "n_points", "h1", "h2", F.when(F.col("old"), F.col("old_file")).otherwise(F.col("f.file_id")).alias("first_file_id"))
    marked.write.parquet(f"{root}/marks/attempt={attempt}")
    marks = spark.read.parquet(f"{root}/marks/attempt={attempt}")

    # Points travel with their file, and only the places that survive are taken out at the end.
    places = marks.where("kept").groupBy("name", "rid").agg(F.collect_set("place").alias("places"))
    moving = rows.drop("n_bytes").join(places, ["name", "rid"]).dropDuplicates(["name", "rid"]).join(home, "name")
    n_out = planned.where("final").count()
    outputs = max(1, min(n_out, 100_000))
    new = frame_blocks(moving.repartition(outputs, "output"), "output", "places").where(F.array_contains("places", F.col("place"))).select("output", "video_id", "frame_index", "keypoints", "file_id")
    if before:
        old = c.blocks.withColumnRenamed("output", "name").join(home, "name").select("output", "video_id", "frame_index", "keypoints", "file_id")
        new = new.unionByName(old).repartition(outputs, "output")
    # A folder per output, and all of an output in one task: a file belongs to one output.
    new.sortWithinPartitions("output", "video_id", "frame_index").write.partitionBy("output").parquet(f"{root}/frames/attempt={attempt}")
    planned.withColumn("attempt", F.lit(attempt)).coalesce(1).write.parquet(f"{root}/pending/{attempt}")
    c.commit(attempt)
    return c
