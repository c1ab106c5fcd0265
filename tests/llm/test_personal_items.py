"""Personal information: planted items, things that are none, positions and placeholders."""

import numpy as np
from pyspark.sql import functions as F

from tracespark.llm.pii_candidates import digit_shape, view
from tracespark.llm.pii_crf import beliefs, find_personal_items, fit, find_items, LEX_SLOTS
from tracespark.llm.pii_candidates import slot

KNOWN = [("Amber", "given"), ("Olive", "given"), ("Basil", "given"), ("Kestelbach", "family"), ("Tarnholt", "family"), (None, "given")]
CASES = [
    ("Contact Amber Kestelbach at amber.k@lab.example today.", {("name", "Amber"), ("email", "amber.k@")}),
    ("Recorded by Dr. Tarnholt.", {("name", "Tarnholt")}),
    ("Call (555) 555-0123 first.", {("phone", "(555)")}),
    ("The release sheet shows SSN 900-20-6362.", {("id_number", "900-20")}),
    ("The participant lives at 1977 Tanner Row, Haldenbrook 59015 and asked not to be filmed.", {("address", "1977")}),
    ("Die Person wohnt in der Kupfergasse 87a, 99549 Bad Quellwitz.", {("address", "Kupfergasse")}),
    ("Aufgenommen von Kestelbach, Amber.", {("name", "Kestelbach")}),
    ("采集员：澹台砚秋。 地址：青石路236号。", {("name", "澹台"), ("address", "青石路")}),
    ("mail x_1(at)studio9.invalid or a at tarnworth dot example", {("email", "x_1"), ("email", "a at")}),
    ("Serial S/N 555-2041-7719 needs a belt. Olive oil and Basil leaves. Run 2031-04-12 08:30:11. torch@2.1", set()),
    ("Café note: Call 555.555.0100 n­ow", {("phone", "555.555")}),
    ("", set()),
    (None, set()),
]


def test_cases_positions_and_placeholders(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(None, "Call (555) 555-0123 first.")], "doc_id bigint, text string").withColumn("kind", F.lit(1)).withColumn("id", F.lit(2))
    known = spark.createDataFrame(KNOWN, "name string, name_kind string")
    got: dict = {}
    for r in find_personal_items(docs, known).collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.start_at))
    for i, (t, want) in enumerate(CASES):
        assert got.get(i, set()) == {(k, t.index(s)) for k, s in want}, (i, t)
    assert got[None] == {("phone", 5)}
    red = {r.doc_id: r.text for r in find_personal_items(docs, known, redact=True).collect()}
    assert red[0] == "Contact [NAME] at [EMAIL] today." and red[2] == "Call [PHONE] first." and red[9] == CASES[9][0] and red[11] == "" and red[12] is None
    assert find_personal_items(docs.limit(0), known.limit(0)).count() == 0


def test_a_repeated_family_name_is_one_person_throughout():
    lex = bytearray(LEX_SLOTS)
    for w, c in (("amber", 1), ("zorvald", 2)):
        lex[slot(w)] = c
    model = fit(["Amber"], 1200)
    text = "Recorded by Amber Zorvald. " + "The gripper lifts the bowl. " * 20 + "Zorvald says it is fine."
    assert {(k, s) for k, s, _ in find_items([text], bytes(lex), model)[0]} == {("name", 12), ("name", text.rindex("Zorvald"))}


def test_messages_agree_with_enumeration():
    rng = np.random.default_rng(0)
    u = rng.normal(0, 1, (4, 3))
    pairs = np.array([(0, 1), (1, 2), (2, 3)])
    pot = np.exp(rng.normal(0, 1, (3, 3, 3)))
    p = np.zeros((3,) * 4)
    for s in np.ndindex(*p.shape):
        p[s] = np.exp(sum(u[i, s[i]] for i in range(4))) * np.prod([pot[k, s[a], s[b]] for k, (a, b) in enumerate(pairs)])
    p /= p.sum()
    exact = np.array([[p.take(k, i).sum() for k in range(3)] for i in range(4)])
    assert np.allclose(beliefs(u, pairs, pot, 80), exact, atol=1e-6)


def test_view_keeps_positions():
    t, at = view("SolÃ¨ne ｗｒｏｔｅ​ 5")
    assert t == "Solène wrote 5" and at[t.index("w")] == "SolÃ¨ne ｗ".index("ｗ")
    assert view("plain") == ("plain", None)


def test_digit_shapes():
    assert [digit_shape(x) for x in ("+44 7700 900479", "555-555-0145", "900-20-6362", "QX554261C", "993024198808232778", "555-2041-7719", "2031-04-12")] == ["p_plus", "p_us", "i_ssn", "i_passport", "i_cn", "other", "other"]
