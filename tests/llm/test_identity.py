"""Rows that share an id, texts of many lines, hashes that collide, and loose candidate families."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glossmill.llm import common, line_dedup, minhash, near_dedup, substring_dedup


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def fresh(rng, n):
    return " ".join(f"u{rng.randrange(10**7)}" for _ in range(n))


@pytest.mark.parametrize("most", [common.SENT_BYTES, 0])
def test_lines_of_shared_ids(spark, monkeypatch, most):
    """A row loses its own repeated lines only; both sides of the broadcast bound give the same."""
    monkeypatch.setattr(common, "SENT_BYTES", most)
    rng = random.Random(1)
    one, two, other = (fresh(rng, 12) for _ in range(3))
    rows = [(1, f"{one}\n{two}"), (7, f"A head of its own.\n{other}\n{one}"), (7, f"{two}\nUNIQUE content that occurs nowhere else\n{fresh(rng, 9)}"), (7, f"{two}\nUNIQUE content that occurs nowhere else\n{fresh(rng, 9)}")]
    rows[3] = rows[2]
    got = Counter((r.doc_id, r.text, r.lines_removed) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    kept = "\n".join(rows[2][1].split("\n")[1:])
    assert got == Counter({(1, rows[0][1], 0): 1, (7, f"A head of its own.\n{other}", 1): 1, (7, kept, 1): 2})


def test_many_lines(spark):
    rng = random.Random(2)
    lines = [f"line {i} {rng.randrange(10**9)} {rng.randrange(10**9)}" for i in range(100_000)]
    began = time.monotonic()
    got = line_dedup.dedup_lines(frame(spark, [(1, "\n".join(lines[::2])), (2, "\n".join(lines))])).where("doc_id = 2").first()
    assert got.text == "\n".join(lines[1::2]) and got.lines_removed == 50_000
    assert time.monotonic() - began < 120


def test_colliding_hashes_delete_nothing(spark):
    """Lines of one first hash but different second ones don't count as equal."""
    found = spark.createDataFrame([(1, 0, 5, 1), (2, 0, 5, 2), (3, 0, 5, 1)], "doc_id bigint, line int, node bigint, check bigint")
    first = found.groupBy("node", "check").agg({"doc_id": "min"}).collect()
    assert sorted(tuple(r) for r in first) == [(5, 1, 1), (5, 2, 2)]
    rng = random.Random(1)
    lines = [fresh(rng, rng.randrange(1, 9)) for _ in range(3_000)]
    raw, at = common.text_bytes(pa.array([*lines, *lines, "x", "X"]))
    got = line_dedup.checks(raw, at[:-1], at[1:]).tolist()
    assert got[:3_000] == got[3_000:6_000] and got[-1] == got[-2] and len(set(got)) > 2_500


def test_near_copies_of_shared_ids(spark):
    rng = random.Random(3)
    a, b = fresh(rng, 80), fresh(rng, 80)
    rows = [(5, a), (5, b), (6, a + " more"), (7, b + " more"), (8, fresh(rng, 80)), (9, b), (9, fresh(rng, 80)), (9, b)]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows)).collect())
    assert got == Counter({(5, 5, True): 2, (6, 5, False): 1, (7, 5, False): 1, (8, 8, True): 1, (9, 5, False): 2, (9, 9, True): 1})
    left = near_dedup.one_of_each(frame(spark, [*rows, rows[4], (None, a), (11, None), (12, "")])).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter([rows[0], rows[1], rows[4], rows[6], (None, a), (11, None), (12, "")])


def test_one_of_each_on_one_id(spark):
    """Near copies under one id are one group as well."""
    text = fresh(random.Random(4), 90)
    left = near_dedup.one_of_each(frame(spark, [(3, text), (3, text + " end"), (3, text), (4, text)])).collect()
    assert len(left) == 1 and left[0].doc_id == 3


def test_bands_miss_as_seldom_as_stated():
    """Sets of a Jaccard similarity of 0.8 share none of 8 bands about as often as ideal hashes."""
    rng = np.random.default_rng(5)
    missed, pairs = 0, 4000
    for _ in range(pairs):
        common_part, mine, theirs = (np.sort(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (80, 10, 10))
        both = [np.sort(np.concatenate([common_part, x])) for x in (mine, theirs)]
        keys = minhash.band_keys(minhash.signatures(np.concatenate(both), np.array([0, 90, 180]), 32), 4)
        missed += not (keys[0] == keys[1]).any()
    ideal = (1 - 0.8**4) ** 8
    assert abs(missed / pairs - ideal) < 5 * np.sqrt(ideal / pairs)


def test_loose_family_grows_linearly(spark, monkeypatch):
    """A family that is held together by candidates only: what its groups are sent grows with its
    items, not with their square."""
    sent = []
    plain = minhash._blocks

    def counted(rows, *args):
        sent[-1] += rows.count()
        return plain(rows, *args)

    monkeypatch.setattr(minhash, "_blocks", counted)
    rng, per = np.random.default_rng(6), {}
    for n in (2_500, 20_000):
        # each set shares a fifth of its shingles with the one before: bands agree now and then
        base = rng.integers(0, 2**60, (n, 8))
        texts = [" ".join(map(str, [*base[i - 1][:3], *base[i]])) for i in range(n)]
        scratch = common.Scratch(spark, "test")
        members = scratch.save(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "family bigint, node bigint, text string").repartition(8))
        sent.append(0)
        links = minhash.resolve(scratch, members, near_dedup.word_sets(1), 16, 1, 80, 1e-6)
        assert links.count() == 0
        per[n] = sent[-1] / n
    assert per[20_000] < 1.5 * per[2_500] and per[20_000] < 30


def test_passages_of_shared_ids(spark):
    rng = random.Random(7)
    a, b = fresh(rng, 60), fresh(rng, 70)
    rows = [(1, f"{fresh(rng, 20)} {a}"), (4, f"{a} {fresh(rng, 8)}"), (4, f"{fresh(rng, 30)} {b}"), (4, fresh(rng, 5)), (9, f"{b} {fresh(rng, 30)}"), (9, f"{b} {fresh(rng, 30)}")]
    got = substring_dedup.cut_passages(frame(spark, [*rows, rows[4]]))
    left = Counter((r.doc_id, " ".join(r.text.split()), r.words_removed) for r in got.collect())
    want = Counter([(1, rows[0][1], 0), (4, rows[1][1][len(a) + 1 :], 60), (4, rows[2][1], 0), (4, rows[3][1], 0), *((9, r[1][len(b) + 1 :], 70) for r in (rows[4], rows[5], rows[4]))])
    assert left == want


def word_runs(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


@pytest.mark.parametrize("changed", [0, 6])
def test_parts_first_seen_in_small_documents(spark, changed):
    """A passage of 160 words whose overlapping 45-word parts stand in five earlier documents."""
    rng = random.Random(8 + changed)
    whole = fresh(rng, 160).split()
    rows = [(i, f"{fresh(rng, 12)} {' '.join(whole[s : s + 45])} {fresh(rng, 12)}") for i, s in enumerate((0, 29, 58, 87, 115))]
    theirs = list(whole)
    for i in rng.sample(range(160), changed):
        theirs[i] = f"other{i}"
    rows += [(10, f"{fresh(rng, 15)} {' '.join(whole)} {fresh(rng, 7)}"), (11, f"{fresh(rng, 9)} {' '.join(theirs)} {fresh(rng, 30)}")]
    covered = set()
    for r in substring_dedup.repeated_passages(frame(spark, rows)).collect():
        assert r.doc_id == 11 and r.source_doc_id == 10 and r.source_begin - 15 == r.begin - 9
        covered.update(range(r.begin - 9, r.begin - 9 + r.n_words))
    assert len(covered) >= (160 if not changed else 100), len(covered)


def test_long_passages_with_few_seeds_of_one_source(spark):
    """An extension beyond the first flank is followed to its end."""
    rng = random.Random(10)
    whole = fresh(rng, 900).split()
    words = substring_dedup._words(" ".join(whole))
    segments = [(450, 470, 10)]
    own = np.concatenate([substring_dedup._words(fresh(rng, 20)), words])
    (i, i1, j, j1, equal), before, after = substring_dedup.align(words, own, segments)
    assert (i, i1, j, j1, equal) == (0, 900, 20, 920, 900) and before and after
    linked = spark.createDataFrame([(2, 1, [450, 470, 10])], substring_dedup.CHAINS)
    docs = frame(spark, [(1, f"{fresh(rng, 20)} {' '.join(whole)} {fresh(rng, 40)}"), (2, " ".join(whole))])
    got = substring_dedup.aligned(common.Scratch(spark, "test"), docs, linked, 0, 50, 0.8, 64).collect()
    assert [(r.doc_id, r.begin, r.n_words, r.source_doc_id, r.source_begin, r.matches) for r in got] == [(2, 0, 900, 1, 20, 900)]


def test_fuzzy_passages_against_brute_force(spark, documents):
    """Whatever two documents of the smallest table share on one diagonal, 50 words or more at an
    identity of 0.8 around 17 equal words (which hold a seed), is found nearly whole."""
    texts = {d: np.array([hash(x) for x in t.encode().lower().split()]) for d, t in documents}
    places, wanted = {}, []
    for d in sorted(texts):
        w, met = texts[d].tolist(), set()
        for i in range(len(w) - 16):
            run = tuple(w[i : i + 17])
            met.update((e, i - j) for e, j in places.get(run, ()) if e != d)
        for i in range(len(w) - 16):
            places.setdefault(tuple(w[i : i + 17]), []).append((d, i))
        for e, shift in met:
            i = max(0, shift)
            n = min(len(w) - i, len(texts[e]) - (i - shift))
            same = texts[d][i : i + n] == texts[e][i - shift : i - shift + n]
            x, y = substring_dedup._longest(same, 0.8)
            if y - x >= 50 and len(set(w[i + x : i + y])) > 10:
                wanted.append((d, i + x, i + y))
    covered = {}
    for r in substring_dedup.repeated_passages(frame(spark, documents)).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.begin, r.begin + r.n_words))
    assert len(wanted) > 20
    for d, x, y in wanted:
        assert len(covered.get(d, set()) & set(range(x, y))) >= 0.9 * (y - x), (d, x, y)


def test_passages_of_wide_ids(spark):
    """Ids that don't fit a place are numbered, in their order."""
    rng = random.Random(11)
    a, low, high = fresh(rng, 60), -(2**62), 2**62
    rows = [(high, f"{a} {fresh(rng, 9)}"), (low, f"{fresh(rng, 4)} {a}"), (3, fresh(rng, 70))]
    got = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    assert [(r.doc_id, r.begin, r.n_words, r.source_doc_id, r.source_begin) for r in got] == [(high, 0, 60, low, 4)]
