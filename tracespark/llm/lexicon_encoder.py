"""Encoding of a corpus with a byte-level BPE vocabulary through a minimal acyclic transducer.

The frequent words of the whole corpus (as the vocabulary's splitting pattern sees words) are encoded
once and compiled into a minimal acyclic automaton with shared suffixes. Its edges carry numbers whose
sum along a word is the word's rank; the rank points to the word's ids. The arrays are memory-mapped by
the workers, which look up all distinct words of a batch at once, a byte position at a time. Words that
the automaton does not accept are merged exactly, pair by pair in rank order, by the vocabulary itself.
"""

from __future__ import annotations

import base64
import io
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracespark.runtime import shared_dir, spread

TOKENIZER_DIR = "/opt/tokenizers"
# The splitting pattern that belongs to the byte_bpe_50k vocabulary, as a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEXICON_WORDS = 1 << 16
MIN_COUNT = 4
MAX_WORD_BYTES = 48


@lru_cache(maxsize=4)
def _vocabulary(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def merge_word(word: str, path: str) -> list[int]:
    """Ids of one word by exact merging."""
    return _vocabulary(path)._core_bpe.encode_single_piece(word.encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def split_words(text: str) -> list[str]:
    return _pattern().findall(text)


# The automaton ------------------------------------------------------------------------------------


@dataclass
class Lexicon:
    """keys: sorted state * 256 + byte; to, skip: target state and rank increment of each edge; final:
    whether a state ends a word; at, ids: ids[at[r]:at[r + 1]] are the ids of the word of rank r."""

    keys: np.ndarray
    to: np.ndarray
    skip: np.ndarray
    final: np.ndarray
    at: np.ndarray
    ids: np.ndarray

    @staticmethod
    def compile(words: dict[bytes, list[int]]) -> Lexicon:
        """Builds the minimal automaton from words in byte order, merging finished states with equal ones as it goes."""
        ordered = sorted(w for w in words if w)
        children: list[dict[int, int]] = [{}]
        final: list[bool] = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # (parent, byte, child) of the last word, not yet merged
        last = b""

        def settle(depth: int) -> None:
            while len(path) > depth:
                parent, byte, child = path.pop()
                mark = (final[child], tuple(sorted(children[child].items())))
                children[parent][byte] = register.setdefault(mark, child)

        for w in ordered:
            k = 0
            while k < min(len(w), len(last)) and w[k] == last[k]:
                k += 1
            settle(k)
            at = path[-1][2] if path else 0
            for byte in w[k:]:
                children.append({})
                final.append(False)
                child = len(children) - 1
                children[at][byte] = child
                path.append((at, byte, child))
                at = child
            final[at] = True
            last = w
        settle(0)

        # Words below each state, children first; then compact state numbers and edge increments.
        below: dict[int, int] = {}
        stack = [0]
        while stack:
            s = stack[-1]
            todo = [c for c in children[s].values() if c not in below]
            if todo:
                stack += todo
                continue
            below[s] = int(final[s]) + sum(below[c] for c in children[s].values())
            stack.pop()
        number = {s: i for i, s in enumerate([0, *(s for s in below if s != 0)])}
        edges = []
        for s, i in number.items():
            before = int(final[s])
            for byte, c in sorted(children[s].items()):
                edges.append((i * 256 + byte, number[c], before))
                before += below[c]
        edges.sort()
        e = np.array(edges, np.int64).reshape(-1, 3)
        fin = np.zeros(len(number), bool)
        fin[[i for s, i in number.items() if final[s]]] = True
        lists = [words[w] for w in ordered]
        return Lexicon(e[:, 0].copy(), e[:, 1].astype(np.int32), e[:, 2].astype(np.int32), fin, np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64), np.array([i for x in lists for i in x], np.int32))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 for words that are not accepted; all words advance together."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        length = np.fromiter((len(w) for w in words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(length) - length
        live = np.flatnonzero((length > 0) & (length <= MAX_WORD_BYTES))
        state, rank = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        depth = 0
        while len(live):
            done = length[live] == depth
            if done.any():
                ok = live[done][self.final[state[done]]]
                out[ok] = rank[done][self.final[state[done]]]
                live, state, rank = live[~done], state[~done], rank[~done]
                if not len(live):
                    break
            key = state * 256 + flat[start[live] + depth]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            live, k = live[hit], k[hit]
            state, rank = self.to[k].astype(np.int64), rank[hit] + self.skip[k]
            depth += 1
        return out

    def to_bytes(self) -> bytes:
        buf = io.BytesIO()
        for a in (self.keys, self.to, self.skip, self.final, self.at, self.ids):
            np.lib.format.write_array(buf, a, version=(1, 0))
        return buf.getvalue()

    @staticmethod
    def mapped(path: str) -> Lexicon:
        """Memory-maps the arrays; workers of one machine share the pages."""
        parts = []
        with open(path, "rb") as f:
            for _ in range(6):
                np.lib.format.read_magic(f)  # version 1.0, as written
                shape, _, dtype = np.lib.format.read_array_header_1_0(f)
                count = int(np.prod(shape))
                parts.append(np.memmap(path, dtype, "r", f.tell(), shape) if count else np.empty(shape, dtype))
                f.seek(count * dtype.itemsize, 1)
        return Lexicon(*parts)


@lru_cache(maxsize=4)
def _mapped(name: str) -> Lexicon:
    return Lexicon.mapped(SparkFiles.get(name))


def _published(spark: SparkSession, data: bytes) -> str:
    """Puts a file into the shared folder and has every executor fetch it; returns its name there."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(at.toString())
    return name


def frequent_words(texts: DataFrame, column: str, words: int = LEXICON_WORDS, min_count: int = MIN_COUNT) -> list[str]:
    """The most frequent words of all texts, ties by code point. Each task counts first, so only distinct words are shuffled."""

    def partial(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(c: Counter):
            return pa.RecordBatch.from_arrays([pa.array([w.encode() for w in c], pa.binary()), pa.array(list(c.values()), pa.int64())], names=["w", "n"])

        c: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                t = t.as_py()
                if t:
                    c.update(w for w in split_words(t) if len(w) <= MAX_WORD_BYTES)
            if len(c) > 200_000:
                yield rows(c)
                c = Counter()
        yield rows(c)

    counts = texts.select(F.col(column).cast("string").alias("t")).mapInArrow(partial, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    return [bytes(r.w).decode() for r in counts.where(F.col("n") >= min_count).orderBy(F.desc("n"), "w").limit(words).collect()]


def encode_corpus(texts: DataFrame, ident: str = "doc_id", column: str = "text", vocabulary: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR, lexicon_words: int = LEXICON_WORDS, lengths_only: bool = False) -> DataFrame:
    """``ident, ids`` (or ``ident, n_tokens``) of every row: the vocabulary's ids of the whole text, without special tokens.

    A null text and an empty text both have the empty list (0 tokens). The text of special tokens is
    ordinary text. Repeated rows stay repeated, and nulls in ``ident`` are kept. ``tokenizer_dir`` must
    hold the vocabulary on every machine. ``lexicon_words`` bounds the automaton, which is the only
    thing sent to the executors; words beyond it are merged exactly, so it never changes the result.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = texts.sparkSession
    path = f"{tokenizer_dir}/{vocabulary}.tiktoken"
    rows = spread(texts.select(F.col(ident).alias("id"), F.col(column).alias("t")))
    lexicon = Lexicon.compile({w.encode(): merge_word(w, path) for w in frequent_words(texts, column, lexicon_words)})
    name = _published(spark, lexicon.to_bytes())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lex = _mapped(name)
        for b in batches:
            words: list[str] = []
            count = np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(b.column(1)):
                t = t.as_py()
                if t:
                    w = split_words(t)
                    count[i] = len(w)
                    words += w
            index: dict[str, int] = {}
            code = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
            distinct = [w.encode() for w in index]
            rank = lex.ranks(distinct)
            # ids of the distinct words: from the automaton, or merged.
            known = rank >= 0
            n = np.zeros(len(distinct), np.int64)
            n[known] = lex.at[rank[known] + 1] - lex.at[rank[known]]
            merged = {int(i): merge_word(distinct[i].decode(), path) for i in np.flatnonzero(~known)}
            for i, m in merged.items():
                n[i] = len(m)
            per_word = n[code]
            doc = np.repeat(np.arange(b.num_rows), count)
            total = np.bincount(doc, per_word, minlength=b.num_rows).astype(np.int64)
            if lengths_only:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total)], names=[ident, "n_tokens"])
                continue
            # One table of the distinct words' ids, then a gather for all words at once.
            first = np.cumsum(n) - n
            pool = np.empty(int(n.sum()), np.int32)
            k = np.flatnonzero(known)
            if len(k):
                step = np.arange(n[k].sum()) - np.repeat(np.cumsum(n[k]) - n[k], n[k])
                pool[np.repeat(first[k], n[k]) + step] = lex.ids[np.repeat(lex.at[rank[k]], n[k]) + step]
            for i, m in merged.items():
                pool[first[i] : first[i] + n[i]] = m
            step = np.arange(per_word.sum()) - np.repeat(np.cumsum(per_word) - per_word, per_word)
            ids = pool[np.repeat(first[code], per_word) + step] if len(code) else np.empty(0, np.int32)
            offsets = np.r_[0, np.cumsum(total)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[ident, "ids"])

    kind = texts.schema[ident].dataType.simpleString()
    return rows.mapInArrow(run, f"`{ident}` {kind}, " + ("n_tokens bigint" if lengths_only else "ids array<int>"))
