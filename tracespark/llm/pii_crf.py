"""Personal information in free text, by a skip-chain conditional random field.

Every candidate of a document is a node with the labels none, first kind, second kind (digits may be a
phone or an id number; all other candidates have one kind). Neighbouring candidates share a chain
potential; candidates that repeat a key (a family name, the digits of a number, an address) share a
skip potential however far apart they are. Loopy sum-product message passing over all documents of a
batch at once decides; each repeated key links to its previous occurrence, so a document has at most
one skip edge per candidate and key.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespark.llm.pii_candidates import LEX_SLOTS, Node, candidates, slot, view
from tracespark.llm.pii_training import labelled_texts
from tracespark.runtime import spread

KINDS = {"e": ("email", None), "d": ("phone", "id_number"), "a": ("address", None), "n": ("name", None)}
DIM, CHAIN_GAP, ROUNDS = 1 << 14, 48, 6
TRAINING_TEXTS, TRAINING_NAMES = 2500, 1000
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


@dataclass
class Model:
    w: np.ndarray  # (DIM, 3) unary weights of hashed features
    chain: np.ndarray  # (kinds, kinds): log potential when two neighbours both are items
    skip: np.ndarray  # (kinds,): log potential when two linked candidates have the same label


def _hash(kind: str, f: str) -> int:
    return zlib.crc32(f"{kind}{f}".encode()) & (DIM - 1)


_ORDER = "edan"


def edges(nodes: list[Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between near neighbours, skip edges from each key to its previous occurrence."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1].start - nodes[i].end <= CHAIN_GAP]
    last: dict[tuple[str, str], int] = {}
    skip = set()
    for j, nd in enumerate(nodes):
        for k in nd.keys:
            if (nd.kind, k) in last:
                skip.add((last[nd.kind, k], j))
            last[nd.kind, k] = j
    return chain, sorted(skip)


def fit(things: list[str], texts: int = TRAINING_TEXTS) -> Model:
    """Weights from labelled texts: unary and edge weights together, by pseudo-likelihood."""
    data, people = labelled_texts(things, texts)
    lex = bytearray(LEX_SLOTS)
    for w in people.given:
        lex[slot(w)] |= 1
    for w in people.family:
        lex[slot(w)] |= 2
    lexb = bytes(lex)
    X, Y, mask, side = [], [], [], []
    for text, gold in data:
        t, _ = view(text)
        nodes = candidates(t, lexb)
        at = {(k, s) for k, s in gold}
        y = [next((i + 1 for i, k in enumerate(KINDS[n.kind]) if k and (k, n.start) in at), 0) for n in nodes]
        chain, skip = edges(nodes)
        near: list[list[tuple[int, int]]] = [[] for _ in nodes]
        far: list[list[int]] = [[] for _ in nodes]
        for i, j in chain:
            near[i].append((_ORDER.index(nodes[i].kind) * 4 + _ORDER.index(nodes[j].kind), y[j]))
            near[j].append((_ORDER.index(nodes[i].kind) * 4 + _ORDER.index(nodes[j].kind), y[i]))
        for i, j in skip:
            far[i].append(y[j])
            far[j].append(y[i])
        for i, n in enumerate(nodes):
            X.append([_hash(n.kind, f) for f in n.feats] + [_hash(n.kind, "bias")])
            Y.append(y[i])
            mask.append([0.0, 0.0, 0.0 if KINDS[n.kind][1] else -1e9])
            side.append((_ORDER.index(n.kind), near[i], far[i]))
    w, chain_w, skip_w = np.zeros((DIM, 3)), np.zeros(16), np.zeros(4)
    gw, gc, gs = (np.full(x.shape, 1e-3) for x in (w, chain_w, skip_w))
    rng = np.random.default_rng(3)
    for _ in range(4):
        for i in rng.permutation(len(X)):
            k, near, far = side[i]
            z = w[X[i]].sum(0) + mask[i]
            for pair, y in near:
                if y:
                    z[1:] += chain_w[pair]
            for y in far:
                z[y] += skip_w[k]
            p = np.exp(z - z.max())
            p /= p.sum()
            g = p.copy()
            g[Y[i]] -= 1
            gw[X[i]] += g**2
            w[X[i]] -= 0.3 * (g / np.sqrt(gw[X[i]]) + 1e-4 * w[X[i]])
            for pair, y in near:
                if y:
                    d = g[1:].sum()
                    gc[pair] += d * d
                    chain_w[pair] -= 0.1 * d / np.sqrt(gc[pair])
            for y in far:
                gs[k] += g[y] ** 2
                skip_w[k] -= 0.1 * g[y] / np.sqrt(gs[k])
    return Model(w.astype(np.float32), np.clip(chain_w, -2, 2).reshape(4, 4), np.clip(skip_w, 0, 4))


def beliefs(unary: np.ndarray, pairs: np.ndarray, potentials: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of all nodes of a batch by loopy sum-product.

    unary: (nodes, 3) log potentials. pairs: (edges, 2) node numbers. potentials: (edges, 3, 3) positive
    factors. Messages are damped and normalised; without edges this is the unary softmax.
    """
    u = np.exp(unary - unary.max(1, keepdims=True))
    m = len(pairs)
    if not m:
        return u / u.sum(1, keepdims=True)
    src = np.r_[pairs[:, 0], pairs[:, 1]]
    dst = np.r_[pairs[:, 1], pairs[:, 0]]
    f = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
    back = np.r_[np.arange(m) + m, np.arange(m)]
    msg = np.full((2 * m, 3), 1 / 3)
    for _ in range(rounds):
        total = np.log(u + 1e-30)
        np.add.at(total, dst, np.log(msg + 1e-30))
        out = np.exp(total[src] - np.log(msg[back] + 1e-30))
        out /= out.sum(1, keepdims=True)
        new = np.einsum("ei,eij->ej", out, f)
        new /= new.sum(1, keepdims=True)
        msg = 0.3 * msg + 0.7 * new
    total = np.log(u + 1e-30)
    np.add.at(total, dst, np.log(msg + 1e-30))
    b = np.exp(total - total.max(1, keepdims=True))
    return b / b.sum(1, keepdims=True)


def find_items(texts: list[str | None], lex: bytes, model: Model) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of the items of each text; positions in code points of the text as given."""
    nodes: list[Node] = []
    doc: list[int] = []
    maps: list[list[int] | None] = []
    lengths: list[int] = []
    pairs, pot = [], []
    for i, text in enumerate(texts):
        if not text:
            maps.append(None)
            lengths.append(0)
            continue
        t, at = view(text)
        maps.append(at)
        lengths.append(len(text))
        got = candidates(t, lex)
        base = len(nodes)
        chain, skip = edges(got)
        for a, b in chain:
            f = np.ones((3, 3))
            f[1:, 1:] = np.exp(model.chain[_ORDER.index(got[a].kind), _ORDER.index(got[b].kind)])
            pairs.append((base + a, base + b))
            pot.append(f)
        for a, b in skip:
            f = np.ones((3, 3))
            f[[0, 1, 2], [0, 1, 2]] = np.exp(model.skip[_ORDER.index(got[a].kind)])
            pairs.append((base + a, base + b))
            pot.append(f)
        nodes += got
        doc += [i] * len(got)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not nodes:
        return out
    unary = np.zeros((len(nodes), 3))
    for i, n in enumerate(nodes):
        unary[i] = model.w[[_hash(n.kind, f) for f in n.feats] + [_hash(n.kind, "bias")]].sum(0)
        if not KINDS[n.kind][1]:
            unary[i, 2] = -60
    b = beliefs(np.maximum(unary, -60), np.array(pairs, np.int64).reshape(-1, 2), np.array(pot).reshape(-1, 3, 3))
    for i, n in enumerate(nodes):
        k = int(b[i].argmax())
        if k:
            at = maps[doc[i]]
            s, e = (n.start, n.end) if at is None else (at[n.start], at[n.end - 1] + 1)
            out[doc[i]].append((KINDS[n.kind][k - 1], s, e))
    return out


# Name words of the corpus -------------------------------------------------------------------------

_ONE = r"(?:[A-ZÀ-Þ][a-zà-ÿ]+(?:'[A-Z][a-zà-ÿ]+)?|[A-Z]'[A-Z][a-zà-ÿ]+)"
_STRONG = re.compile(
    r"(?:[Cc]ontacto?(?: ?:)?|[Rr]ecorded by|Enregistré par|Grabado por|Aufgenommen von|signed by|signé par|Einwilligung von|Consentimiento de|Rückfragen an|Thanks to|waiting for|Reviewed with|duty:|annotator=|name=|belongs to|parcel for|returned to|owner,|[Ll]eft rig|right rig|rechter Arm|Linker Arm|respuesta de|réponse de|key;)\s*"
    rf"((?:(?:von|de|van|der|la) )*{_ONE}(?:, {_ONE}|(?: [A-Z]\.)?(?: (?:von|de|van|der|la))*(?: {_ONE})(?:-{_ONE})?))"
)
_CAP = re.compile(r"[A-ZÀ-Þ][a-zà-ÿ]+(?:'[A-Z][a-zà-ÿ]+)?|[A-Z]'[A-Z][a-zà-ÿ]+")
_SMALL = frozenset("von de van der la".split())


def name_words(docs: DataFrame, known: DataFrame, column: str = "text", least: int = 3, share: float = 0.08, training_names: int = TRAINING_NAMES) -> tuple[bytes, list[str]]:
    """Name codes by hashed word (1 given, 2 family, 3 both), and given names for the labelled sample (at most ``training_names`` of the known, by hash).

    Counted over all texts: how often a capitalised word stands in a place that announces a name,
    against all its capitalised uses; words with at least ``least`` such places and that ``share`` of them
    count as names, beside the known ones. The table has a fixed size.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for pdf in batches:
            for t in pdf["t"]:
                if not t:
                    continue
                t, _ = view(t)
                if not re.search(r"[A-ZÀ-Þ]", t):
                    continue
                for w in _CAP.findall(t):
                    c[w.lower(), 0] += 1
                for m in _STRONG.finditer(t):
                    run = m[1]
                    words = [w for w in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", run) if w.lower() not in _SMALL and len(w) > 1]
                    if len(words) < 2:
                        continue
                    if re.match(r"(?:(?:von|de|van|der|la) )*[^\s,]+, ", run):
                        words = [*words[1:], words[0]]
                    c[words[0].lower(), 1] += 1
                    c[words[-1].lower(), 2] += 1
            if len(c) > 300_000:
                yield pd.DataFrame([(w, k, n) for (w, k), n in c.items()], columns=["w", "k", "n"])
                c = Counter()
        yield pd.DataFrame([(w, k, n) for (w, k), n in c.items()], columns=["w", "k", "n"])

    counts = docs.select(F.col(column).alias("t")).mapInPandas(partial, "w string, k int, n bigint").groupBy("w").pivot("k", [0, 1, 2]).agg(F.sum("n")).na.fill(0).toDF("w", "seen", "first", "last")
    good = counts.where((F.col("first") + F.col("last") >= least) & (F.col("first") + F.col("last") >= share * F.col("seen")))
    code = F.when(F.col("first") >= F.greatest(F.lit(1.0), 0.25 * F.col("last")), 1).otherwise(0).bitwiseOR(F.when(F.col("last") >= F.greatest(F.lit(1.0), 0.25 * F.col("first")), 2).otherwise(0))
    slots = good.groupBy(F.crc32("w").bitwiseAND(LEX_SLOTS - 1).alias("slot")).agg(F.bit_or(code).alias("code"))
    lex = bytearray(LEX_SLOTS)
    for r in slots.toLocalIterator():  # at most LEX_SLOTS rows
        lex[r.slot] |= r.code
    names = known.where("name is not null").select("name", (F.col("name_kind") == "given").alias("given"))
    listed = names.groupBy(F.crc32(F.encode(F.lower("name"), "UTF-8")).bitwiseAND(LEX_SLOTS - 1).alias("slot")).agg(F.bit_or(F.when(F.col("given"), 1).otherwise(2)).alias("code"))
    for r in listed.toLocalIterator():  # at most LEX_SLOTS rows
        lex[r.slot] |= r.code
    given = [r.name for r in names.where("given").select("name").distinct().orderBy(F.xxhash64("name"), "name").limit(training_names).collect()]
    return bytes(lex), sorted(given)


def find_personal_items(docs: DataFrame, known_names: DataFrame, ident: str = "doc_id", column: str = "text", training_texts: int = TRAINING_TEXTS, redact: bool = False) -> DataFrame:
    """``ident, kind, start_at, end_at`` of every item, or with ``redact`` ``ident, text``: the texts with placeholders.

    kind is email, phone, id_number, address or name; positions are 0-based code points, the end
    exclusive. Titles and labels before an item are not part of it. All else in a redacted text is
    unchanged; a null text stays null and an empty one empty. Repeated rows each give their items; a
    null ident is kept. training_texts bounds the labelled sample the model is fitted on; the name
    lexicon is counted over all texts. An empty table gives an empty result.
    """
    lex, given = name_words(docs, known_names, column)
    model = fit(given, training_texts)
    shared = docs.sparkSession.sparkContext.broadcast((lex, model))  # fixed size: LEX_SLOTS and DIM
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, model = shared.value
        for pdf in batches:
            for a in range(0, len(pdf), 512):
                part = pdf.iloc[a : a + 512]
                texts = [t if isinstance(t, str) else None for t in part["text"]]
                found = find_items(texts, lex, model)
                if redact:
                    done = []
                    for t, items in zip(texts, found):
                        for k, s, e in sorted(items, key=lambda x: -x[1]):
                            t = t[:s] + PLACEHOLDER[k] + t[e:]
                        done.append(t)
                    yield pd.DataFrame({"id": part["id"], "text": pd.Series(done, index=part.index, dtype=object)})
                else:
                    rows = [(i, k, s, e) for i, items in zip(part["id"], found) for k, s, e in items]
                    yield pd.DataFrame(rows, columns=["id", "kind", "start_at", "end_at"])

    rows = spread(docs.select(F.col(ident).alias("id"), F.col(column).alias("text")))
    if redact:
        return rows.mapInPandas(run, f"id {kind}, text string").select(F.col("id").alias(ident), F.col("text").alias(column))
    return rows.mapInPandas(run, f"id {kind}, kind string, start_at bigint, end_at bigint").withColumnRenamed("id", ident)
