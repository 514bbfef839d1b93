"""Line, document and passage dedup against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from glossmill.llm import common, line_dedup, minhash, near_dedup, substring_dedup


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            p, q = find(a), find(b)
            if p != q and linked(a, b):
                parent[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def word_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def variants(n, seed, words=60):
    """Copies of one text with more and more words changed, so that links form chains."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(words)] = f"v{i}_{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_union_find(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    want = components({x for e in edges if e[0] != e[1] for x in e}, lambda a, b: (a, b) in edges or (b, a) in edges)
    for few in (1_000_000, 0):
        monkeypatch.setattr(common, "FEW_EDGES", few)
        got = common.components(common.Scratch(spark, "test"), spark.createDataFrame(edges, "a bigint, b bigint"))
        assert {r.node: r.root for r in got.collect()} == want


def test_stars():
    rng = np.random.default_rng(2)
    for _ in range(100):
        a, b = rng.integers(-9, 30, (2, rng.integers(1, 40)))
        node, root = common.stars(a, b)
        pairs = set(zip(a.tolist(), b.tolist()))
        want = components(sorted({*a.tolist(), *b.tolist()}), lambda x, y: (x, y) in pairs or (y, x) in pairs)
        assert dict(zip(node.tolist(), root.tolist())) == {x: r for x, r in want.items() if x != r}


def test_posterior_bounds():
    least = minhash.least_matches(128, 0.8, 1e-6)
    assert least[128] == max(least) and 75 <= least[128] <= 90 and least[7] == 0
    rng = np.random.default_rng(1)
    assert (rng.binomial(128, 0.8, 200_000) < least[128]).mean() < 1e-4


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, documents, k):
    rows = documents + [(10_000 + i, t) for i, t in enumerate(variants(40, 5))]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=k).collect()}
    sets = {d: word_set(t, k) for d, t in rows}
    want = components(sets, lambda a, b: similar(sets[a], sets[b]))
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(got[d].n_shingles == len(sets[d]) and got[d].kept == (want[d] == d) for d in sets)


def test_large_family(spark, monkeypatch):
    """A family of many blocks gives the same components as all pairs."""
    rows = list(enumerate(variants(150, 8, 70)))
    sets = {d: word_set(t, 4) for d, t in rows}
    members = spark.createDataFrame([(7, d, t) for d, t in rows], "family bigint, node bigint, text string")
    scratch = common.Scratch(spark, "test")
    links = minhash.resolve(scratch, scratch.save(members), near_dedup.word_sets(4), 128, 4, 80, 1e-6, block=16)
    want = components(sets, lambda a, b: similar(sets[a], sets[b]))
    pairs = {tuple(p) for p in links.collect()}
    pairs |= {(b, a) for a, b in pairs}
    got = components(sets, lambda a, b: (a, b) in pairs)
    assert got == want


def test_near_odd(spark, odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 10 and by[None].component_id is None and by[None].kept
    assert by[5].component_id == 4 and by[7].component_id == 6 and by[1].component_id == 1 and by[2].kept
    assert near_dedup.near_duplicates(none).count() == 0


LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def line_form(line):
    return line.encode().translate(LOWER).strip(b" \t\n\r\x0b\x0c").decode()


def brute_lines(rows, k):
    first = {}
    for d, t in sorted(rows):
        for i, line in enumerate(t.split("\n")):
            if line_form(line):
                first.setdefault(line_form(line), (d, i))
    sets = {n: frozenset(n[i : i + k] for i in range(len(n) - k + 1)) if len(n) >= k else frozenset([n]) for n in first}
    root = components(sets, lambda a, b: abs(len(sets[a]) - len(sets[b])) <= 0.25 * max(len(sets[a]), len(sets[b])) and similar(sets[a], sets[b]))
    stays = defaultdict(list)
    for n, r in root.items():
        stays[r].append(first[n])
    keep = {n: min(stays[r]) for n, r in root.items()}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if not line_form(x) or keep[line_form(x)] == (d, i)) for d, t in rows}


def test_line_dedup(spark, documents):
    rows = documents[:120] + [(20_000 + i, "Kept line of its own, number %d.\n\n%s" % (i, t)) for i, t in enumerate(variants(15, 4, 20))]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(rows, line_dedup.SHINGLE)


def test_lines_odd(spark, odd, none):
    got = line_dedup.dedup_lines(odd.withColumnRenamed("score", "lines_removed")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == 10 and by[1][0].text is None and by[2][0].text == "" and by[3][0].text == " \n\t "
    assert by[None][0].text.startswith("a text") and by[4][0].text == "one" and [r.text for r in by[5]] == ["", ""]
    assert by[7][0].text == "" and by[7][0].lines_removed == 1 and by[6][0].key == "c"
    assert line_dedup.dedup_lines(none).count() == 0


def test_split_lines():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n\té日") for _ in range(rng.randrange(12))) for _ in range(500)]
    raw, at = common.text_bytes(__import__("pyarrow").array(texts))
    begin, end, text, number = line_dedup.split_lines(raw, at)
    got = [(int(t), int(n), raw[a:b].tobytes()) for a, b, t, n in zip(begin, end, text, number, strict=True)]
    want = [(t, i, x.encode().strip(b" \t\n\r\x0b\x0c")) for t, s in enumerate(texts) for i, x in enumerate(s.split("\n")) if x.encode().strip(b" \t\n\r\x0b\x0c")]
    assert got == want


def brute_chain(segments, cost):
    """The largest worth of any chain, by trying all predecessors."""
    best = []
    for i, j, m in segments:
        got = [b - cost * (i - p - r + j - q - r) for (p, q, r), b in zip(segments, best) if p + r <= i and q + r <= j]
        best.append(m + max([0.0, *got]))
    return max(best)


def test_fenwick_chain():
    rng = random.Random(6)
    for _ in range(300):
        segments = sorted({(rng.randrange(60), rng.randrange(60), rng.randrange(1, 9)) for _ in range(rng.randrange(1, 14))})
        chains = substring_dedup.chain(segments, 0.25, 10**9)
        worth = lambda c: sum(m for _, _, m in c) - 0.25 * sum(b[0] - a[0] - a[2] + b[1] - a[1] - a[2] for a, b in zip(c, c[1:]))
        assert worth(chains[0]) == pytest.approx(brute_chain(segments, 0.25))
        assert sorted(s for c in chains for s in c) == segments


def test_passages(spark, documents):
    rng = random.Random(7)
    fresh = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    exact, fuzzy, short = fresh(70), fresh(80), fresh(30)
    changed = list(fuzzy)
    for i in (15, 33, 34, 60):
        changed[i] = "other"
    del changed[50]
    rows = [(1, [*fresh(40), *exact, *fresh(30)]), (2, [*fresh(10), *exact]), (3, [*fuzzy, *fresh(50)]), (4, [*fresh(60), *changed]), (5, [*short, *fresh(60)]), (6, [*fresh(60), *short]), (7, fresh(200))]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id bigint, text string")
    got = {(r.doc_id, r.source_doc_id): (r.begin, r.n_words, r.source_begin) for r in substring_dedup.repeated_passages(df).collect()}
    assert set(got) == {(2, 1), (4, 3)}
    assert got[(2, 1)] == (10, 70, 40) and got[(4, 3)][0] == 60 and got[(4, 3)][1] >= 78
    left = {r.doc_id: r for r in substring_dedup.cut_passages(df).collect()}
    assert left[2].text.split() == rows[1][1][:10] and left[2].words_removed == 70
    assert all(left[d].text == " ".join(w) for d, w in rows if d in (1, 3, 5, 6, 7))


def test_lines_first_seen_apart(spark):
    """A passage whose parts were first seen in different documents finds its first whole holder."""
    rng = random.Random(11)
    fresh = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    rows, want = [], {}
    for x, (m, n) in enumerate([(25, 25), (25, 25), (30, 30), (40, 40), (48, 48), (40, 10), (48, 2), (2, 48), (25, 30)]):
        one, two = fresh(m), fresh(n)
        whole, base = one + two, 100 * x
        rows += [(base + 1, [*fresh(20), *one, *fresh(20)]), (base + 2, [*fresh(9), *two, *fresh(20)]), (base + 10, [*fresh(30), *whole, *fresh(5)]), (base + 20, [*fresh(15), *whole, *fresh(30)])]
        want[(base + 20, base + 10)] = (15, m + n, 30)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id bigint, text string")
    got = {(r.doc_id, r.source_doc_id): (r.begin, r.n_words, r.source_begin) for r in substring_dedup.repeated_passages(df).collect()}
    assert got == want


def test_longest_part():
    rng = np.random.default_rng(4)
    for _ in range(300):
        same = rng.random(rng.integers(1, 40)) < 0.75
        runs = [(i, j) for i in range(len(same)) for j in range(i + 1, len(same) + 1) if same[i] and same[j - 1] and same[i:j].mean() >= 0.8 - 1e-9]
        i, j = substring_dedup._longest(same, 0.8)
        assert (i, j) in runs or (not runs and (i, j) == (0, 0))
        assert j - i == max([q - p for p, q in runs], default=0)


def test_chain_is_cut_back(spark):
    """A passage is not lost for what follows it in the same chain."""
    rng = random.Random(12)
    fresh = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    rows, want = [], set()
    for x, (m, gap, n) in enumerate(10 * [(55, 20, 12), (60, 24, 14), (80, 26, 12), (50, 26, 50)]):
        one, two, d = fresh(m), fresh(n), 10 * x
        rows += [(d + 1, [*fresh(30), *one, *fresh(gap), *two, *fresh(30)]), (d + 2, [*fresh(40), *one, *fresh(gap), *two, *fresh(20)])]
        want |= {(d + 2, 40, m, 30)} | ({(d + 2, 40 + m + gap, n, 30 + m + gap)} if n >= 50 else set())
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id bigint, text string")
    assert {(r.doc_id, r.begin, r.n_words, r.source_begin) for r in substring_dedup.repeated_passages(df).collect()} == want


def test_exact_repeats_are_covered(spark, documents):
    texts = {d: t.encode().lower().split() for d, t in documents}
    covered = defaultdict(set)
    for r in substring_dedup.repeated_passages(spark.createDataFrame(documents, "doc_id bigint, text string")).collect():
        covered[r.doc_id].update(range(r.begin, r.begin + r.n_words))
    seen = {}
    for d in sorted(texts):
        runs = {i: tuple(texts[d][i : i + 50]) for i in range(len(texts[d]) - 49)}
        for i, run in runs.items():
            if run in seen and len(set(run)) > 10:
                assert set(range(i, i + 50)) <= covered[d], (d, i)
        for run in runs.values():
            seen.setdefault(run, d)


def test_passages_odd(spark, odd, none):
    got = substring_dedup.cut_passages(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 10 and by[1].text is None and by[7].text == "" and by[6].words_removed == 0 and by[5].text == "one"
    assert substring_dedup.cut_passages(none).count() == 0
