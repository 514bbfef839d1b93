"""Worked cases of normalisation, splitting and scores, and brute-force checks."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from glossmill.functions import scores, text
from glossmill.operators import curate, segment


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("صباح الخير جميعاً.", "صباح الخير جميعا."),
        ("مرحبا بالعالم، هذا اختبار.", "مرحبا بالعالم, هذا اختبار."),
        ("أُجّل الاجتماع", "اجل الاجتماع"),
        ("أهلاً  بكم؟؟ «نعم» ــ ١٢٣ _–", 'اهلا بكم? "نعم" 123 -'),
    ],
)
def test_arabic(spark, given, want):
    assert one(spark, given, text.normalize_arabic) == want


def test_latin(spark):
    assert one(spark, "a\\\"b\\\\c <b>x</b>\n«q» – –!!", text.normalize_latin) == 'a"b\\c x"q" - -!'
    assert one(spark, "é", text.nfc) == unicodedata.normalize("NFC", "é")
    assert one(spark, None, text.normalize_latin) is None


@pytest.mark.parametrize(
    ("q", "t", "want"),
    [("Good morning", "Good morning", 1.0), ("  GOOD Morning ", "good morning", 1.0), ("morning", "Good morning", 0.8042), ("Good morning", "morning", 0.125), ("good evening", "Good morning", 0.0833), ("x", "yy", 0.0)],
)
def test_memory_score(spark, q, t, want):
    row = spark.createDataFrame([(q, t)], "q string, t string").select(scores.memory_score(F.col("q"), F.col("t"))).first()
    assert round(row[0], 4) == want


def test_sentences(spark):
    assert one(spark, "a. b!! c؟ ", text.sentences) == ["a", "b", "c"]
    assert one(spark, "3.5 m", text.sentences) == ["3", "5 m"]


def brute_split(t, most):
    if len(t) <= most:
        return [t]
    out, cur = [], ""

    def pack(units):
        nonlocal cur
        for u in units:
            if cur and len(cur) + 1 + len(u) <= most:
                cur += " " + u
            else:
                if cur:
                    out.append(cur)
                cur = u

    for s in filter(None, re.split(r"(?<=[.!?])\s+", t)):
        if len(s) > most:
            pack([]) if not cur else out.append(cur)
            cur = ""
            pack(s.split())
            out.append(cur)
            cur = ""
        else:
            pack([s])
    if cur:
        out.append(cur)
    return out


def test_split_by_limit(spark):
    assert one(spark, "One. Two two. Three three three! Four?", lambda c: segment.split_by_limit(c, 15)) == ["One. Two two.", "Three three", "three!", "Four?"]
    assert one(spark, "abcdefghijklmnopqrs tu. Vw.", lambda c: segment.split_by_limit(c, 10)) == ["abcdefghijklmnopqrs", "tu.", "Vw."]
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", "!"]) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", segment.split_by_limit(F.col("t"), 20).alias("s")).collect()
    for r in rows:
        assert r.s == brute_split(texts[r.i], 20)


def test_merge_fragments(spark):
    row = spark.createDataFrame([(["Ab", "cd ef", "gh", "Done.", "x"],)], "p array<string>").select(segment.merge_fragments(F.col("p")).alias("m")).select(segment.merged(F.col("m"))).first()
    assert row[0] == ["Ab cd ef", "gh", "Done.", "x"]


def test_chrf(spark):
    rows = [(1, "abc", "abc"), (2, "abcd", "xyz"), (3, "", "abc"), (4, "the cat sat", "the cat sits")]
    got = dict(scores.chrf(spark.createDataFrame(rows, "k int, hyp string, ref string"), ["k"]).collect())
    from collections import Counter

    def brute(h, r):
        h, r = h.replace(" ", ""), r.replace(" ", "")
        ps, qs = [], []
        for n in range(1, 7):
            a, b = Counter(h[i : i + n] for i in range(len(h) - n + 1)), Counter(r[i : i + n] for i in range(len(r) - n + 1))
            if a and b:
                m = sum((a & b).values())
                ps.append(m / sum(a.values()))
                qs.append(m / sum(b.values()))
        if not ps:
            return 0.0
        p, q = sum(ps) / len(ps), sum(qs) / len(qs)
        return 5 * p * q / (4 * p + q) if p + q else 0.0

    for k, h, r in rows:
        assert got[k] == pytest.approx(brute(h, r))


def test_rules(spark):
    rows = spark.createDataFrame([("",), ("1234567",), ("12345678",), (None,)], "human_edit string")
    assert [tuple(r)[1:] for r in curate.fallback_rules(rows).collect()] == [("reject", "empty human_edit"), ("reject", "too short"), ("accept", ""), ("reject", "empty human_edit")]
    assert curate.strategy("nothing") is curate.fallback_rules


def test_validate_identical_is_rejected(spark):
    items = spark.createDataFrame([(1, "same text here", {"model1": "same text here"}, 1.0, 1.0), (2, "another", {}, 1.0, 1.0), (3, "another", {}, 0.0, 1.0)], "item_id int, human_edit string, llm_outputs map<string,string>, meaning double, quality double")
    got = {r.item_id: (r.decision, r.reason) for r in curate.validate(items, "item_id").collect()}
    assert got[1] == ("reject", "human edit too similar to model output (similarity=1.000)")
    assert got[2][0] == "error"
    assert got[3][0] == "reject"


def test_words_to_lines(spark):
    """Against a fold by hand: a line's anchor is its first word, and words are in order of x."""
    rng = random.Random(7)
    words = [(d, f"w{i}", rng.random() * 500, rng.random() * 60) for d in (1, 2, 3) for i in range(80)]
    df = spark.createDataFrame([(d, w, x, x + 5, t, t + 9, 10.0 + (i % 3)) for i, (d, w, x, t) in enumerate(words)], "doc_id int, text string, x0 double, x1 double, top double, bottom double, size double")
    got = {(r.doc_id, r.line): (r.text, r.top, r.x0) for r in segment.words_to_lines(df, ["doc_id"]).collect()}
    want = {}
    for d in (1, 2, 3):
        line, anchor = -1, None
        held = {}
        for _, w, x, t in sorted((v for v in words if v[0] == d), key=lambda v: (round(v[3], 1), v[2])):
            if anchor is None or abs(t - anchor) > 2.5:
                line, anchor = line + 1, t
            held.setdefault(line, []).append((x, w, t))
        for n, own in held.items():
            want[d, n] = (" ".join(w for _, w, _ in sorted(own)), min(t for _, _, t in own), min(own)[0])
    assert got == want


def test_pages(spark):
    """Pages come one after another, without their numbers, fragments merged within a page."""
    rows = []
    for page in (1, 2):
        lines = ["Front matter of the paper here", "goes on in lower case, and ends.", "Second line of the text stands.", "A third one follows it closely.", "The fourth has nothing to add.", str(page)]
        for n, t in enumerate(lines):
            top = 100.0 * page * 0 + n * 40.0
            rows += [(1, page, w, 10.0 * k, 10.0 * k + 8, top, top + 10, 10.0) for k, w in enumerate(t.split())]
    df = spark.createDataFrame(rows, "doc_id int, page int, text string, x0 double, x1 double, top double, bottom double, size double")
    got = [(r.paragraph, r.page, r.text) for r in segment.page_paragraphs(df).orderBy("paragraph").collect()]
    assert [p for p, _, _ in got] == list(range(1, len(got) + 1)) and [p for _, p, _ in got] == sorted(p for _, p, _ in got)
    assert not any(t in ("1", "2") for _, _, t in got)
    assert "Front matter of the paper here goes on in lower case, and ends." in [t for _, _, t in got][0]
