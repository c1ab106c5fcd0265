"""Texts that were cut: at a field limit, in mid-transfer, in mid-word.

Three kinds of evidence, each from all texts:

* near copies: parts of the sets of five-word shingles and, for long texts, min-hash bands name candidates;
  each text is verified (Jaccard similarity at least 0.8) against every candidate whose shingles allow it, and
  aligned word by word. The copy whose alignment ends early was cut; one that ends where a finished
  copy ends was not. Only texts without such a copy are judged by the rest.
* a pile of unfinished texts at one length of a (source, field, version), in characters or bytes: a limit.
* terminality: a logistic model of closing words and their context, trained on the corpus itself
  (sentence ends against all places inside sentences), gives the chance that an unfinished text is over.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracespark.runtime import spread, stored

SHINGLE, BANDS, ROWS, SIMILAR = 5, 20, 4, 0.8
TRAINING_TEXTS = 12_000  # texts the closing-word model is fitted on, chosen by hash
DIM = 1 << 18
VOCAB = 1 << 20
LINKS = 32  # most frequent words that hardly ever end a sentence count as linking clauses
HOT = 256  # texts in a bucket from which on they meet by parts of their sets instead

_FINISHED = re.compile(r"[.!?。！？][\"'”’)\]»]*$|\w[\"”’)\]»]+$")
_OPEN = {"(": ")", "[": "]", "“": "”", "«": "»"}
_ELLIPSIS = re.compile(r"(?:…|\.{2,})[\"'”’)\]»]*$")  # one character or a run of dots
_BROKEN = re.compile(_ELLIPSIS.pattern + r"|(?:�|\\(?:u[0-9a-fA-F]{0,3})?|[,;:–—→/(\[“«-])$")
SURELY_FINISHED = r"""right(text, 2) rlike r'[^.…][.!?]\z' and not text rlike r'[(\[“«"]'"""  # most finished texts, told in the JVM; finished() tells the rest
_SENTENCE_END = re.compile(r"[.!?。！？][\"'”’)\]»]*$")
_CLOSING = frozenset(".!?。！？\"'”’)]»\n")  # what a match can end with


def finished(text: str) -> bool:
    """Ends with a closing mark, and nothing it opened is left open."""
    t = text.rstrip()
    if t[-1:] in (".", "!", "?") and t[-2:-1] not in ("", ".", "…") and not any(x in t for x in '([“«"'):
        return True  # the usual case, without the patterns
    if not _FINISHED.search(t) or _ELLIPSIS.search(t):
        return False
    return not left_open(t)


def left_open(t: str) -> bool:
    return any(t.count(a) > t.count(b) for a, b in _OPEN.items()) or (t.startswith('"') and t.count('"') % 2 == 1)


def ends_sentence(word: str) -> bool:
    return word[-1:] in _CLOSING and bool(_SENTENCE_END.search(word)) and not _ELLIPSIS.search(word)


def words_of(text: str) -> list[str]:
    return re.sub(r"\d+", "0", text).split()


def sentence_of(words: list[str]) -> list[str]:
    """The words since the last finished sentence."""
    k = len(words)
    while k > 0 and not ends_sentence(words[k - 1] if k < len(words) else words[k - 1] + "~"):
        k -= 1
    return words[k:]


def features(sentence: list[str], known: bool, links: frozenset[int]) -> list[int]:
    """Hashed features of a sentence that would end here. links: slots of the corpus's most frequent words among those that hardly ever end a sentence; they tell what kind of clause is open."""
    n = len(sentence)
    w1 = sentence[-1] if n else ""
    w2, w3 = (sentence[-2] if n > 1 else "^"), (sentence[-3] if n > 2 else "^")
    low = [w.strip(",.;:!?\"'()").lower() for w in sentence]
    linked = [word_slot(w) in links for w in low]
    at = [i for i, w in enumerate(low) if w and linked[i]]
    last, before = (low[at[-1]] if at else "-"), (low[at[-2]] if len(at) > 1 else "-")
    at = at[-1] if at else -1
    head = sentence[0] if n else ""
    frame = ",".join(sorted({w for w, x in zip(low, linked) if x}))
    f = [
        "b", f"1 {w1}", f"2 {w2} {w1}", f"3 {w3} {w2} {w1}", f"h {head} {w1}", f"l {last} {w1}", f"f {frame} {w1}", f"fl {frame} {last}", f"d {last} {n - 1 - at}",
        f"n {min(n, 12)}", f"hl {head} {last}", f"fd {frame} {last} {n - 1 - at}", f"k {known}", f"fh {frame} {head}", f"2l {last} {w2} {w1}", f"hd {head} {frame} {last} {n - 1 - at}",
        f"kl {known} {last}", f"pl {before} {last} {w1}", f"pd {before} {last} {n - 1 - at} {known}",
    ]
    return [zlib.crc32(x.encode()) & (DIM - 1) for x in f]


N_FEATURES = 19


@lru_cache(maxsize=1 << 18)
def word_slot(w: str) -> int:
    return zlib.crc32(w.strip(",.;:!?\"'()“”").lower().encode()) & (VOCAB - 1)


def train(texts: list[str], known: np.ndarray, links: frozenset[int] = frozenset(), epochs: int = 4, seed: int = 7) -> np.ndarray:
    """Weights of the logistic model. Every sentence end of the texts is a positive, every other place in a sentence and some places in its words are negatives."""
    rng = np.random.default_rng(seed)
    seen: dict[tuple[int, ...], list[float]] = {}

    def add(sentence: list[str], y: int, weight: float = 1.0) -> None:
        k = tuple(features(sentence, bool(known[word_slot(sentence[-1])]), links))
        c = seen.setdefault(k, [0.0, 0.0])
        c[y] += weight

    for t in texts:
        words = words_of(t)
        start = 0
        for i, w in enumerate(words):
            if i == len(words) - 1 and _ELLIPSIS.search(w):
                break  # an ellipsis tells nothing of where sentences end
            ends = ends_sentence(w) or i == len(words) - 1
            sentence = words[start : i + 1]
            if ends:
                add([*sentence[:-1], re.sub(r"[.!?。！？\"'”’)\]»]+$", "", w) or w], 1)
                start = i + 1
            else:
                add(sentence, 0)
            core = w.rstrip(".,!?\"')")
            if len(core) > 2 and rng.random() < 0.6:
                add([*sentence[:-1], core[: int(rng.integers(1, len(core)))]], 0)
    if not seen:
        return np.zeros(DIM, np.float32)
    X = np.array(list(seen), np.int64)
    C = np.array(list(seen.values()))
    w, g2 = np.zeros(DIM), np.full(DIM, 1e-6)
    order = np.arange(len(X))
    for _ in range(epochs):
        rng.shuffle(order)
        for a in range(0, len(order), 256):
            b = order[a : a + 256]
            z = w[X[b]].sum(1)
            p = 1 / (1 + np.exp(-z))
            d = C[b].sum(1) * p - C[b, 1]
            d = np.clip(d, -5, 5)
            grad = np.bincount(X[b].ravel(), np.repeat(d, N_FEATURES), minlength=DIM)
            hit = np.unique(X[b])
            g2[hit] += grad[hit] ** 2
            w[hit] -= 0.3 * grad[hit] / np.sqrt(g2[hit])
    return w.astype(np.float32)


def chance_over(text: str, w: np.ndarray, known: np.ndarray, links: frozenset[int] = frozenset()) -> float:
    """Chance that an unfinished text is nevertheless over."""
    s = sentence_of(words_of(text))
    if not s:
        return 1.0
    return float(1 / (1 + np.exp(-np.clip(w[features(s, bool(known[word_slot(s[-1])]), links)].sum(), -40, 40))))


# Near copies --------------------------------------------------------------------------------------

_A = np.random.default_rng(20).integers(1, 1 << 61, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(21).integers(1, 1 << 61, BANDS * ROWS, dtype=np.uint64)


_CODES: dict[str, int] = {}  # words seen by this worker; emptied when it grows too large
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def word_codes(text: str) -> list[int]:
    """64-bit codes of the words; case and end marks make no difference."""
    if len(_CODES) > 500_000:
        _CODES.clear()
    out = []
    for w in text.lower().split():
        c = _CODES.get(w)
        if c is None:
            x = w.strip(".,!?;:\"'()…").encode()
            c = _CODES[w] = zlib.crc32(x) << 32 | zlib.adler32(x)
        out.append(c)
    return out


def _shingled(codes: np.ndarray) -> np.ndarray:
    """Hash of the five words from each place on."""
    n = len(codes) - SHINGLE + 1
    h = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE if n > 0 else 0):
            h += codes[k : k + n] * _MIX[k]
            h ^= h >> np.uint64(31)
    return h


def shingle_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the five-word shingles of a text."""
    return _shingled(np.array(word_codes(text), np.uint64))


def band_keys(all_codes: list[list[int]], at_once: int = 1024) -> list[list[int]]:
    """The bucket of each band of each text, given by the codes of its words; none for texts shorter than a shingle. All shingles of a block of texts at once."""
    out: list[list[int]] = []
    for start in range(0, len(all_codes), at_once):
        codes = all_codes[start : start + at_once]
        words = np.array([len(c) for c in codes])
        h = _shingled(np.array([x for c in codes for x in c], np.uint64))
        text_of = np.repeat(np.arange(len(codes)), words)
        inside = text_of[: len(h)] == text_of[SHINGLE - 1 :] if len(h) else np.zeros(0, bool)
        h = h[inside]
        size = np.maximum(words - SHINGLE + 1, 0)
        keys = np.zeros((len(codes), BANDS), np.int64)
        full = np.flatnonzero(size)
        if len(full):
            first = np.cumsum(size[full]) - size[full]
            with np.errstate(over="ignore"):
                for band in range(BANDS):
                    key = np.zeros(len(full), np.uint64)
                    for r in range(band * ROWS, (band + 1) * ROWS):
                        low = np.minimum.reduceat((h * _A[r] + _B[r]) >> np.uint64(3), first)
                        key = (key ^ low) * np.uint64(0x9E3779B97F4A7C15)
                        key ^= key >> np.uint64(29)
                    keys[full, band] = key.view(np.int64)
        out += [k.tolist() if n else [] for k, n in zip(keys, size)]
    return out


APART = round((1 + SIMILAR) / (1 - SIMILAR))  # similar sets of a and b shingles differ in at most (a + b) / APART of them
#: Sets that differ in at most the key's number of shingles agree in so many (second) of so many (first) parts.
PARTS = {0: (1, 1), 1: (8, 7), 2: (5, 3), 3: (5, 2), 4: (6, 2), 5: (6, 1), 6: (7, 1), 7: (8, 1)}
LONG = max(PARTS) + 1  # differences from which on texts meet in bands; in hot buckets, by parts for the next of STEPS
STEPS = [LONG]
while STEPS[-1] < 1 << 30:
    STEPS.append(STEPS[-1] * 5 // 4)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread over all 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _MIX[0]
        x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def _listed(rows: list[np.ndarray], values: list[np.ndarray], n: int) -> pa.ListArray:
    """n lists: each value in the list of its row."""
    row, value = np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *values])
    ends = np.cumsum(np.bincount(row, minlength=n))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(value[np.argsort(row, kind="stable")]))


def set_shapes(codes: list[list[int]]) -> dict[str, np.ndarray | pa.ListArray]:
    """Of each text, given by the codes of its words: ``size``, its number of distinct shingles; ``bits`` and ``bits2``, a map of them; ``near`` and ``far``, keys of parts of the set; ``wide``, whether bands are needed.

    Two similar texts differ in at most d = (a + b) / APART shingles, and each has keys for that d, so one key at
    least is common to both: in ``near`` below LONG differences, else in ``far``. Parts without a shingle give no
    key; texts that have such below LONG are wide, like all that may differ in LONG.
    """
    n = len(codes)
    words = np.array([len(c) for c in codes], np.int64)
    h = _shingled(np.array([x for c in codes for x in c], np.uint64))
    text_of = np.repeat(np.arange(n), words)
    inside = text_of[: len(h)] == text_of[SHINGLE - 1 :] if len(h) else np.zeros(0, bool)
    h, text_of = h[inside], text_of[: len(h)][inside]
    order = np.lexsort((h, text_of))
    h, text_of = h[order], text_of[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (text_of[1:] != text_of[:-1])
    h, text_of = _mixed(h[once]), text_of[once]
    size = np.bincount(text_of, minlength=n)
    bits = np.zeros((n, 2), np.uint64)
    np.bitwise_or.at(bits, (text_of, (h >> np.uint64(57) & np.uint64(1)).astype(np.int64)), np.uint64(1) << (h >> np.uint64(58)))
    low, high = 2 * size // (APART + 1), 2 * size // (APART - 1)
    wide = high >= LONG
    rows: tuple[list, list] = ([], [])
    keys: tuple[list, list] = ([], [])
    classes = [(0, d, d, *PARTS[d]) for d in PARTS] + [(1, a, b, b + 2, 1) for a, b in zip([LONG, *(x + 1 for x in STEPS)], STEPS)]
    for late, first, last, parts, take in classes:
        if first > high.max(initial=-1):
            break
        on = np.flatnonzero((low <= last) & (high >= first) & (size > 0))
        at = np.full(n, -1)
        at[on] = np.arange(len(on))
        mine = at[text_of] >= 0
        cell = at[text_of[mine]] * parts + ((h[mine] & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        sums, held = np.zeros(len(on) * parts, np.uint64), np.bincount(cell, minlength=len(on) * parts).reshape(-1, parts) > 0
        np.add.at(sums, cell, h[mine])
        sums = sums.reshape(-1, parts)
        for c, chosen in enumerate(combinations(range(parts), take)):
            key = np.full(len(on), last * 65_536 + c + 1, np.uint64)
            with np.errstate(over="ignore"):
                for j in chosen:
                    key = _mixed(key * _MIX[2] + sums[:, j])
            there = held[:, chosen].any(1)
            rows[late].append(on[there])
            keys[late].append(key[there].view(np.int64))
            if not late:
                wide[on[~there]] = True
    return {"size": size.astype(np.int32), "bits": bits[:, 0].view(np.int64), "bits2": bits[:, 1].view(np.int64), "near": _listed(rows[0], keys[0], n), "far": _listed(rows[1], keys[1], n), "wide": wide}


SHAPE = "tid bigint, over boolean, size int, bits bigint, bits2 bigint, near array<bigint>, far array<bigint>, keys array<bigint>"


READ = pa.schema([("tid", pa.int64()), ("over", pa.bool_()), ("size", pa.int32()), ("bits", pa.int64()), ("bits2", pa.int64()), *((x, pa.list_(pa.int64())) for x in ("near", "far", "keys")), *((x, pa.int64()) for x in ("s", "n", "ends"))])


def shape_rows(tid: pa.Array, texts: list[str]) -> pa.RecordBatch:
    """The rows of SHAPE of some texts: over, whether finished; keys, the buckets of the bands of wide texts, the band being part of the key; the rest as in set_shapes."""
    codes = [word_codes(t) for t in texts]
    shape = set_shapes(codes)
    wide = np.flatnonzero(shape.pop("wide"))
    found = np.array(band_keys([codes[i] for i in wide]), np.int64).reshape(-1, BANDS).view(np.uint64)
    with np.errstate(over="ignore"):
        found = _mixed(found ^ np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[4])
    shape["keys"] = _listed([np.repeat(wide, BANDS)], [found.view(np.int64).ravel()], len(texts))
    return pa.RecordBatch.from_pydict({"tid": tid, "over": pa.array([finished(t) for t in texts], pa.bool_()), **{k: x if isinstance(x, pa.ListArray) else pa.array(x) for k, x in shape.items()}})


def without_ellipsis(text: str) -> str:
    return _ELLIPSIS.sub("", text.rstrip()).rstrip("…�").rstrip()


def _aligned(t: str, c: str, found: list[re.Match]) -> re.Match:
    """Of several places of a closing phrase in the copy, the one with the most words before it in common; then the nearest to the text's end."""
    if len(found) == 1:
        return found[0]
    before = t.split()[:-1]

    def rank(m: re.Match) -> tuple[int, int]:
        words = c[: m.end()].split()[:-1]
        same = next((k for k, (x, y) in enumerate(zip(reversed(before), reversed(words))) if x != y), min(len(before), len(words)))
        return same, -abs(m.end() - len(t))

    return max(found, key=rank)


GOES_ON, ENDS_TOO = 2, 1


def told_by(text: str, copy: str) -> int:
    """What a near copy tells of an unfinished text: GOES_ON within the sentence or word, ENDS_TOO at the same place, finished; 0 when the two are no near copies or nothing follows from them."""
    a, b = set(shingle_hashes(text).tolist()), set(shingle_hashes(copy).tolist())
    if not a or not b or len(a & b) < SIMILAR * len(a | b) or finished(text):
        return 0
    t, c = without_ellipsis(text), copy.rstrip()
    tw = t.split()
    # Align the text's closing words in the copy; the last may be half a word.
    tail = re.escape(" ".join(tw[-4:-1])).replace(r"\ ", r"\s+") + r"\s+" + re.escape(tw[-1])
    found = list(re.finditer(tail, c))
    if not found:
        return 0
    rest = c[_aligned(t, c, found).end() :]
    if rest and re.match(r"[.!?。！？\"'”’)\]»\s]*$", rest):
        return ENDS_TOO if finished(copy) else 0
    # What follows in the copy must belong to the sentence: neither a new one nor a remark in brackets.
    return 0 if not rest or re.match(r"[.!?。！？]|\s*[(\[]", rest) else GOES_ON


def near_copy_pairs(shaped: DataFrame) -> DataFrame:
    """``tid, copy``: each unfinished text with every text that may be similar. shaped: rows of SHAPE.

    They share a part of the set of shingles (``near``) or, if wide, a band; in buckets of more than ``HOT`` texts
    parts (``far``) stand for the band. Only pairs whose sizes and maps of shingles allow the similarity are made, so
    their number follows the similar ones and not the square of a bucket.
    """

    def met(rows: DataFrame) -> DataFrame:
        mate = rows.select("key", F.col("tid").alias("copy"), F.col("size").alias("copy_size"), F.col("bits").alias("copy_bits"), F.col("bits2").alias("copy_bits2"))
        # A bit that differs stands for at least one shingle that only one of the texts has.
        differ = F.bit_count(F.col("bits").bitwiseXOR(F.col("copy_bits"))) + F.bit_count(F.col("bits2").bitwiseXOR(F.col("copy_bits2")))
        fits = (F.col("tid") != F.col("copy")) & (F.least("size", "copy_size") >= SIMILAR * F.greatest("size", "copy_size")) & (differ * APART <= F.col("size") + F.col("copy_size"))
        return rows.where("not over").join(mate, "key").where(fits).select("tid", "copy")

    numbers = ["tid", "over", "size", "bits", "bits2"]
    banded = shaped.select(*numbers, F.explode("keys").alias("key"))
    wanted = banded.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.count_if(~F.col("over")).alias("u")).where("k > 1 and u > 0").drop("u")
    members = stored(banded.join(wanted, "key"), "members")
    hot = members.where(F.col("k") > HOT).select("tid").distinct()
    pairs = met(shaped.select(*numbers, F.explode("near").alias("key")))
    pairs = pairs.unionByName(met(members.where(F.col("k") <= HOT)))
    return pairs.unionByName(met(shaped.join(hot, "tid", "left_semi").select(*numbers, F.explode(F.concat("near", "far")).alias("key")))).distinct()


def near_copy_verdicts(texts: DataFrame, shaped: DataFrame | None = None) -> DataFrame:
    """``text, told`` of every unfinished text that has a verified near copy which tells something: GOES_ON beside one that goes on, else ENDS_TOO.

    texts: one column ``text``; shaped: their rows of SHAPE, where they are known already.
    """

    def shaped_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield shape_rows(b["tid"], b["text"].to_pylist())

    named = texts.select("text", F.xxhash64("text").alias("tid"))
    if shaped is None:
        shaped = stored(spread(named.distinct()).mapInArrow(shaped_texts, SHAPE), "shapes")
    # Only numbers travel with the keys; the texts of candidate pairs are fetched afterwards, and verified as they are.
    pairs = stored(near_copy_pairs(shaped), "pairs")
    asked = pairs.select("tid").union(pairs.select("copy")).distinct()
    named = stored(named.join(asked, "tid", "left_semi").distinct(), "asked")
    full = pairs.join(named, "tid").join(named.select(F.col("tid").alias("copy"), F.col("text").alias("copy_text")), "copy")
    tells = F.pandas_udf(lambda t, c: pd.Series([told_by(x, y) for x, y in zip(t, c)], dtype="int32"), "int")
    return full.select("text", tells("text", "copy_text").alias("told")).where("told > 0").groupBy("text").agg(F.max("told").alias("told"))


# Limits -------------------------------------------------------------------------------------------


def find_limits(unfinished: DataFrame) -> DataFrame:
    """``source, field, version, m, n``: lengths n, in m (chars or bytes), at which unfinished texts pile up.

    unfinished: source, field, version, text. A pile holds at least 5 texts, 6 times what the lengths 3 to 12 below
    hold on average, and at least twice what all lengths of more than 3 above hold together. Lengths are counted
    in Spark, whatever their number; each is a row.
    """
    chars, size = F.length(F.rtrim("text")), F.octet_length(F.rtrim(F.regexp_replace("text", "�+$", "")))
    by = ["source", "field", "version", "m"]
    hist = unfinished.select("source", "field", "version", F.explode(F.array(F.struct(F.lit("chars").alias("m"), chars.alias("n")), F.struct(F.lit("bytes").alias("m"), size.alias("n")))).alias("x"))
    hist = hist.select("source", "field", "version", "x.m", "x.n").groupBy(*by, "n").agg(F.count(F.lit(1)).alias("k"))
    # One row per length of a source's field and version.
    w = Window.partitionBy(*by).orderBy("n")
    below, longer = F.sum("k").over(w.rangeBetween(-12, -3)), F.sum("k").over(w.rangeBetween(4, Window.unboundedFollowing))
    cells = F.greatest(F.lit(1), F.least(F.lit(10), F.col("n") - 3))
    pile = (F.col("k") >= 5) & (F.col("k") >= 6 * (F.coalesce("below", F.lit(0)) / cells + 0.1)) & (F.coalesce("longer", F.lit(0)) <= 0.5 * F.col("k"))
    return hist.withColumn("below", below).withColumn("longer", longer).where(pile).select(*by, "n")


def text_fields(table: DataFrame, fields: list[str], ident: str, source: str, version: str) -> DataFrame:
    """``ident, field, source, version, text`` of every text that is neither null nor blank."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    return table.select(F.col(ident).alias("id"), F.col(source).alias("source"), F.col(version).alias("version"), pairs.alias("x")).select("id", "source", "version", "x.field", "x.text").where("length(trim(text)) > 0")


def find_cut_texts(table: DataFrame, fields: list[str], ident: str = "text_id", source: str = "source", version: str = "export_version", also: tuple[str, ...] = (), decide: float = 0.5, training_texts: int = TRAINING_TEXTS) -> DataFrame:
    """``ident, field, source, cut, reason`` of every non-blank text of ``fields``.

    A verified near copy decides first: reason ``copy`` when one goes on. Of the others: ``broken`` (ends in
    mid-character, in an ellipsis or after a mark that cannot end a text); none when a near copy ends at the same
    place, finished; ``limit`` (unfinished at a detected limit); ``open`` (unfinished, and its closing words are
    inside a sentence or word); or null. ``also``: further columns whose texts train
    the model. A finished text, a null and an empty or blank text are never cut. Nulls in source or
    version form sources of their own, texts without an ident one group. Repeated rows count once. An empty table gives an empty result.
    training_texts bounds the sample the closing-word model is fitted on; limits, vocabulary, linking words and copies
    use every text.
    """
    texts = text_fields(table, fields, ident, source, version)
    each = F.explode(F.array(*[F.struct(F.lit(own).alias("own"), F.col(f).alias("text")) for own, names in ((True, fields), (False, also)) for f in names]))
    named = table.select(each.alias("x")).select("x.own", "x.text").where("length(trim(text)) > 0").withColumn("tid", F.xxhash64("text"))
    corpus = named.groupBy("text", "tid").agg(F.max("own").alias("own"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pass over the texts: the shapes of those of ``fields``, the hashes of the others, and how often each word occurs and ends a sentence."""
        for b in batches:
            own, other = b.filter(b["own"]), b.filter(pc.invert(b["own"]))
            parts = [shape_rows(own["tid"], own["text"].to_pylist()), pa.RecordBatch.from_pydict({"tid": other["tid"]})]
            seen: dict[int, list[int]] = {}
            for w, n in Counter(w for t in b["text"].to_pylist() for w in words_of(t)[:-1]).items():
                c = seen.setdefault(word_slot(w), [0, 0])
                c[0] += n
                c[1] += n * ends_sentence(w)
            counts = np.array([[s, *c] for s, c in seen.items()], np.int64).reshape(-1, 3)
            parts.append(pa.RecordBatch.from_pydict({"s": counts[:, 0], "n": counts[:, 1], "ends": counts[:, 2]}))
            for part in parts:
                names = part.schema.names
                yield pa.RecordBatch.from_arrays([part[f.name] if f.name in names else pa.nulls(part.num_rows, f.type) for f in READ], schema=READ)

    shaped = stored(corpus.mapInArrow(read, SHAPE + ", s bigint, n bigint, ends bigint"), "shapes")

    # Vocabulary: a fixed table of word counts, whatever the size of the corpus.
    common = stored(shaped.where("s is not null").groupBy("s").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).where("n >= 3"), "vocabulary")
    links = frozenset(r.s for r in common.where("ends <= 0.001 * n").orderBy(F.desc("n"), "s").limit(LINKS).collect())
    packed = common.groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).collect()  # VOCAB / 64 rows
    known = np.zeros(VOCAB // 64, np.int64)
    known[[r.word for r in packed]] = [r.bits for r in packed]
    known = np.unpackbits(known.view(np.uint8), bitorder="little").astype(bool)
    last = shaped.where("tid is not null").select("tid").orderBy("tid").limit(training_texts).agg(F.max("tid")).first()[0]
    sample = [r.text for r in named.where(F.col("tid") <= last).select("text", "tid").distinct().orderBy("tid").collect()] if last is not None else []
    weights = train(sample, known, links)

    done = F.pandas_udf(lambda t: pd.Series([finished(x) for x in t]), "boolean")
    open_ = stored(texts.where(f"not ({SURELY_FINISHED})").where(~done("text")).distinct(), "unfinished")

    # A pile outweighs all longer lengths twice, so of a source's field and version few lengths can be limits.
    limits: dict = {}
    for r in find_limits(open_).toLocalIterator():
        limits.setdefault((r.source, r.field, r.version, r.m), set()).add(r.n)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, chances = [], {}
            for i, s, v, f, t, told in pdf[["id", "source", "version", "field", "text", "told"]].itertuples(index=False, name=None):
                r = t.rstrip()
                s, v = (None if x is None or x != x else x for x in (s, v))
                n, b = len(r), len(re.sub("�+$", "", r).encode())
                lim_c, lim_b = limits.get((s, f, v, "chars"), ()), limits.get((s, f, v, "bytes"), ())
                if told == GOES_ON:
                    reason = "copy"
                elif _BROKEN.search(r):
                    reason = "broken"
                elif told == ENDS_TOO:
                    reason = None
                elif n in lim_c or b in lim_b:
                    reason = "limit"
                elif left_open(r):
                    reason = "open"
                elif (chances.get(r) or chances.setdefault(r, chance_over(r, weights, known, links))) < (0.9 if n + 1 in lim_c or b + 1 in lim_b else decide):
                    reason = "open"
                else:
                    reason = None
                out.append((i, f, s, reason))
            yield pd.DataFrame(out, columns=["id", "field", "source", "reason"])

    kind = table.schema[ident].dataType.simpleString()
    copies = near_copy_verdicts(named.where("own").select("text"), shaped.where("size is not null")).withColumnRenamed("text", "matched")
    asked = open_.join(copies, open_.text == copies.matched, "left").select("id", "source", "version", "field", "text", F.coalesce("told", F.lit(0)).alias("told"))
    found = asked.mapInPandas(judge, f"id {kind}, field string, source string, reason string")
    every = texts.select("id", "field", "source", F.lit(None).cast("string").alias("reason")).unionByName(found)
    cut = every.groupBy("id", "field", "source").agg(F.min("reason").alias("reason"))
    return cut.select(F.col("id").alias(ident), "field", "source", F.col("reason").isNotNull().alias("cut"), "reason")
