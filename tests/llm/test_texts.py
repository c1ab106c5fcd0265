"""Cut texts, encoding and packing."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracespark.llm import truncation as tr
from tracespark.llm.lexicon_encoder import Lexicon, encode_corpus, merge_word, split_words
from tracespark.llm.packing import evolve, pack

T = "text_id bigint, source string, export_version string, short_description string, detailed_description string"


def captions(r):
    who, do, what, end = ["The left arm", "The person", "A hand"], ["lifts", "turns", "pushes"], ["the steel bowl", "a paper cup", "the glass jar"], ["in two steps", "with a short pause", "and sets it on the tray"]
    return lambda n=1: " ".join(f"{r.choice(who)} {r.choice(do)} {r.choice(what)} {r.choice(end)}." for _ in range(n))


def test_planted_cuts(spark):
    r = random.Random(3)
    s = captions(r)
    rows = [(i, "a", "1", s(), s(3)) for i in range(400)]
    rows += [(1000 + i, "b", "1", s(3)[:60], None) for i in range(60)]  # a limit of 60
    cut = {1000 + i for i, x in enumerate(rows[400:]) if not x[3].endswith(".")}
    rows += [(2000, "a", "1", "The left arm lifts the", None), (2001, "a", "1", "The person turns a paper cu", None), (2002, "a", "1", "A hand pushes the glass…", None), (2003, "a", "1", "The person turns the steel bowl in two steps", None), (2004, "a", "1", "", "  "), (2005, None, None, "A hand pushes the", None), (2006, "a", "1", None, None)]
    df = spark.createDataFrame(rows + rows[:5], T).withColumn("field", F.lit("f")).withColumn("id", F.lit(1)).withColumn("reason", F.lit("r"))
    out = tr.find_cut_texts(df, ["short_description", "detailed_description"]).collect()
    found = {(x.text_id, x.field) for x in out if x.cut}
    assert {k for k, _ in found if k < 1000} == set()
    assert {k for k, _ in found if 1000 <= k < 2000} == cut
    assert {k for k, _ in found if k >= 2000} == {2000, 2001, 2002, 2005}
    assert not any(x.text_id in (2004, 2006) for x in out)


def test_dots_are_an_ellipsis(spark):
    for x in ("The arm lifts the...", "The arm lifts the..", 'He said "it lifts the..."', "(it lifts the...)", "The arm lifts the…", "It lifts the…”"):
        assert not tr.finished(x) and tr._BROKEN.search(x)
    assert tr.finished("The arm lifts.") and tr.finished('"The arm lifts."') and not tr._BROKEN.search("The arm lifts.")
    assert tr.sentence_of("One. The arm... lifts the".split()) == "The arm... lifts the".split()
    words = [f"w{i}" for i in range(40)]
    assert tr.told_by(" ".join(words[:36]) + "...", " ".join(words) + ".") == tr.GOES_ON
    rows = [(1, "a", "1", "The left arm lifts the...", None), (2, "a", "1", "The left arm lifts the bowl.", None)]
    out = tr.find_cut_texts(spark.createDataFrame(rows, T), ["short_description"]).collect()
    assert {(x.text_id, x.cut, x.reason) for x in out} == {(1, True, "broken"), (2, False, None)}


def bands(*texts):
    return tr.band_keys([tr.word_codes(t) for t in texts])


def test_near_copies_end_early():
    words = [f"w{i}" for i in range(40)]
    whole = " ".join(words) + "."
    assert tr.told_by(" ".join(words[:36]), whole) == tr.told_by(" ".join(words[:36]) + " w3", whole.replace("w36", "w3644")) == tr.GOES_ON
    assert tr.told_by(" ".join(words), whole) == tr.ENDS_TOO and tr.told_by(" ".join(words), whole[:-1] + "?") == tr.ENDS_TOO
    assert tr.told_by(" ".join(words[:20]), whole) == tr.told_by(" ".join(words), " ".join(words) + ". More here.") == tr.told_by("a b", "a b c") == tr.told_by(whole, whole + " x.") == 0
    a, b, none = bands(whole, " ".join(words[:37]), "too short")
    assert len(a) == tr.BANDS and set(a) & set(b) and none == []


def test_bands_find_nearly_all_pairs_at_the_similarity():
    r = random.Random(11)
    found = total = 0
    while total < 300:
        words = [f"v{r.randrange(400)}" for _ in range(80)]
        other = list(words)
        other[r.randrange(80)] = "changed"
        other = other[: r.randint(68, 80)]
        a, b = (set(tr.shingle_hashes(" ".join(w)).tolist()) for w in (words, other))
        if 0.8 <= len(a & b) / len(a | b) < 0.9:
            total += 1
            x, y = bands(" ".join(words), " ".join(other))
            found += any(p == q for p, q in zip(x, y))
    assert found / total >= 0.98


def test_near_copy_table(spark):
    words = [f"w{i}" for i in range(40)]
    more = [f"u{i}" for i in range(40)]
    rows = [(" ".join(words) + ".",), (" ".join(words[:35]),), ("other words " * 9,), ("x",), (" ".join(more),), (" ".join(["so", *more[1:]]) + ".",)]
    assert {(r.text, r.told) for r in tr.near_copy_verdicts(spark.createDataFrame(rows, "text string")).collect()} == {(" ".join(words[:35]), tr.GOES_ON), (" ".join(more), tr.ENDS_TOO)}


def test_a_verified_copy_decides_first(spark):
    words = "the left arm slowly carries one heavy red box over a long table towards the far wall of the hall and then puts it down with great care beside two other boxes near the old door".split()
    whole, cut = " ".join(words) + ".", " ".join(words[:-4])
    also = " ".join(["our", *words[1:]])  # no full stop, but a copy ends there
    rows = [(1, "a", "1", whole, None), (2, "a", "1", cut, None), (3, "a", "1", also, None)]
    out = {x.text_id: x.reason for x in tr.find_cut_texts(spark.createDataFrame(rows, T), ["short_description"]).collect()}
    assert out == {1: None, 2: "copy", 3: None}


@pytest.mark.parametrize("hot", [256, 2])
def test_every_bucket_mate_is_a_copy(spark, monkeypatch, hot):
    monkeypatch.setattr(tr, "HOT", hot)
    words = [f"w{i}" for i in range(60)]
    cut = " ".join(words[:50])
    copy = " ".join(words[:55]) + "."
    longer = [f"x{i}{'y' * 60} {cut}." for i in range(20)]  # end where the text ends, longer in every bucket
    keys = dict(zip([cut, copy, *longer], bands(cut, copy, *longer)))
    assert all(max((x for x in keys if keys[x][k] == keys[cut][k]), key=len) != copy for k in range(tr.BANDS))
    rows = [(x,) for x in keys]
    assert [(r.text, r.told) for r in tr.near_copy_verdicts(spark.createDataFrame(rows, "text string")).collect()] == [(cut, tr.GOES_ON)]


def test_similar_sets_share_a_key():
    r = random.Random(5)
    codes = []
    for n in [*range(5, 44)] * 12 + [80, 150, 400]:
        words = [r.getrandbits(62) for _ in range(n)]
        codes += [words, words[r.randint(0, n // 9) : n - r.randint(0, n // 9)], [1, *words[1:]], [*words, *words[:6]]]
    shapes = tr.set_shapes(codes)
    sets = [set(tr._shingled(np.array(c, np.uint64)).tolist()) for c in codes]
    assert shapes["size"].tolist() == [len(s) for s in sets]
    near, far, bands = shapes["near"].to_pylist(), shapes["far"].to_pylist(), tr.band_keys(codes)
    similar = 0
    for i in range(0, len(codes), 4):
        for a, b in ((i, i + 1), (i, i + 2), (i + 1, i + 2), (i, i + 3)):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= tr.SIMILAR * len(sets[a] | sets[b]):
                similar += 1
                assert set(near[a]) & set(near[b]) or shapes["wide"][a] and shapes["wide"][b] and any(x == y for x, y in zip(bands[a], bands[b]))
                assert set(near[a] + far[a]) & set(near[b] + far[b])
                differ = sum(((int(shapes[x][a]) ^ int(shapes[x][b])) & (1 << 64) - 1).bit_count() for x in ("bits", "bits2"))
                assert differ * tr.APART <= len(sets[a]) + len(sets[b])
    assert similar > 600


def test_pairs_follow_the_similar_texts_and_not_the_buckets(spark):
    shared = " ".join(f"w{i}" for i in range(24))
    rows = [(f"a{i} b{i} c{i} d{i} e{i} f{i} {shared}",) for i in range(400)]  # alike by 0.63, with the same closing words: they fill the same buckets
    rows += [(f"{rows[0][0]} z",), (f"z {rows[1][0]}",)]
    buckets = Counter(k for x in bands(*[r[0] for r in rows]) for k in enumerate(x))
    assert sum(k * k for k in buckets.values() if k > 100) > 100_000  # pairs, were they made by the bucket
    shaped = spark.createDataFrame(tr.shape_rows(pa.array(range(402)), [r[0] for r in rows]).to_pylist(), tr.SHAPE)
    pairs = {tuple(p) for p in tr.near_copy_pairs(shaped).collect()}
    assert {(0, 400), (400, 0), (1, 401), (401, 1)} <= pairs and len(pairs) <= 4 * len(rows)


def test_most_finished_texts_are_told_in_the_jvm(spark):
    texts = ["It lifts.", "It lifts", "It lifts..", "It lifts…", "It lifts.…", "It lifts!", "(It lifts.", "“It lifts.”", '"It lifts.', "It. ", ".", "It lifts.\n", "a\nb.", "«a.", "a [b].", "x…."]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    sure = {r.text for r in df.where(tr.SURELY_FINISHED).collect()}
    assert {"It lifts.", "It lifts!", "a\nb."} <= sure and all(tr.finished(x) for x in sure)


def test_closing_phrases_that_occur_twice_are_aligned():
    phrase, words = "and sets it on", [f"w{i}" for i in range(40)]
    whole = " ".join([*words[:20], phrase, *words[20:], phrase, "the tray"]) + "."
    assert tr.told_by(" ".join([*words[:20], phrase, *words[20:], phrase]), whole) == tr.GOES_ON
    ended = whole.removesuffix(" the tray.") + "."
    assert tr.told_by(ended[:-1], ended) == tr.ENDS_TOO


def test_limits_need_a_pile(spark):
    rows = [("s", "f", "1", "x" * n) for n in range(20, 60) for _ in range(2)]
    far = [("s", "f", "2", "y" * 70_000)] * 9 + [("s", "f", None, "é" * 40)] * 9
    find = lambda r: {tuple(x) for x in tr.find_limits(spark.createDataFrame(r, "source string, field string, version string, text string")).collect()}
    assert find(rows) == set()
    assert find(rows + [("s", "f", "1", "x" * 60)] * 40 + far) == {("s", "f", "1", "chars", 60), ("s", "f", "1", "bytes", 60), ("s", "f", "2", "chars", 70_000), ("s", "f", "2", "bytes", 70_000), ("s", "f", None, "chars", 40), ("s", "f", None, "bytes", 80)}


def test_a_cut_text_without_an_ident_is_cut(spark):
    rows = [(None, "a", "1", "The left arm lifts the...", None), (1, "a", "1", "The left arm lifts the bowl.", None)]
    out = tr.find_cut_texts(spark.createDataFrame(rows, T), ["short_description"]).collect()
    assert {(x.text_id, x.cut, x.reason) for x in out} == {(None, True, "broken"), (1, False, None)}


def test_empty_captions(spark):
    assert tr.find_cut_texts(spark.createDataFrame([], T), ["short_description"]).count() == 0


TEXTS = ["", None, " ", "hello world", "don't we're THEY'LL", "naïve café — 北京烤鸭 🤖👍🏽", "  \n\t two  spaces \r\n", "x" * 5000 + " " + "ab" * 700, "<|endoftext|> is text", "a b​c ｆｕｌｌ", "12345678 3.14 §§§ !!!??"]


def test_ids_equal_the_public_encoder(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = [(i, x) for i, x in enumerate(TEXTS * 3)] + [(None, "null id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("id", F.lit(5)).withColumn("ids", F.lit("z"))
    got = sorted(((r.doc_id, r.ids) for r in encode_corpus(df).collect()), key=repr)
    assert got == sorted(((i, t.encode(x, add_special_tokens=False).ids if x else []) for i, x in rows), key=repr)
    n = sorted(((r.doc_id, r.n_tokens) for r in encode_corpus(df, lengths_only=True).collect()), key=repr)
    assert n == sorted(((i, len(x)) for i, x in got), key=repr)
    assert encode_corpus(df.limit(0)).count() == 0


def test_lexicon_is_exact_and_minimal():
    r = random.Random(1)
    words = {"".join(r.choice("abc") for _ in range(r.randint(1, 7))).encode() for _ in range(300)}
    table = {w: [i, i + 1] for i, w in enumerate(sorted(words))}
    lex = Lexicon.compile(table)
    probe = sorted(words) + [b"zzz", b"", b"abcabcabcabc", *(w + b"c" for w in sorted(words)[:50])]
    for w, k in zip(probe, lex.ranks(probe)):
        assert (list(lex.ids[lex.at[k] : lex.at[k + 1]]) == table[w]) if w in table else k == -1
    suffixes = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(lex.final) == len(suffixes)  # one state per set of endings
    assert Lexicon.compile({}).ranks([b"a"]).tolist() == [-1]


def test_words_rejoin_to_the_text():
    for x in TEXTS:
        if x:
            assert "".join(split_words(x)) == x
    assert merge_word(" the", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def test_packing_holds_every_part_once(spark):
    r = random.Random(2)
    rows = [(i, r.choice([0, 1, 7, 30, 55, 99, 100, 101, 250, 1000])) for i in range(800)] + [(None, 5), (7, 7), (7, 7), (3, None), (4, -2)]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint").withColumn("uid", F.lit(0)).withColumn("part", F.lit(0)).withColumn("block", F.lit("b"))
    out = pack(df, "doc_id", "n", capacity=100, block_items=128).collect()
    used, parts = {}, {}
    for x in out:
        used[x.container_id] = used.get(x.container_id, 0) + x.n_units
        parts.setdefault(x.doc_id, []).append(x.n_units)
    assert max(used.values()) <= 100
    want = {}
    for i, n in rows:
        n = max(n or 0, 0)
        want.setdefault(i, []).extend([100] * (n // 100) + ([n % 100] if n % 100 or n == 0 else []))
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    least = -(-sum(used.values()) // 100)
    assert len(used) <= least * 1.06 + 1
    assert pack(df.limit(0), "doc_id", "n").count() == 0


def test_genetic_search_beats_best_fit_on_hard_sizes():
    plain = searched = after = 0
    for seed in range(4):
        size = np.random.default_rng(seed).integers(500, 1100, 400).tolist()
        one = evolve(size, 2048, [], np.random.default_rng(0), population=1, generations=0)  # plain best fit
        islands = [evolve(size, 2048, [], np.random.default_rng([seed, i])) for i in range(3)]
        moved = [evolve(size, 2048, [islands[i], islands[i - 1]], np.random.default_rng([9, seed, i])) for i in range(3)]
        for p in (one, *islands, *moved):
            assert sorted(i for b in p for i in b) == list(range(400)) and all(sum(size[i] for i in b) <= 2048 for b in p)
        plain, searched, after = plain + len(one), searched + min(map(len, islands)), after + min(map(len, moved))
    assert after <= searched <= 0.97 * plain
