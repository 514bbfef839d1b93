"""What is sent through the driver, and steps that take many pairs at once."""

import hashlib

import numpy as np

from glossmill.llm import common, line_dedup, minhash, substring_dedup


def test_components_send_nothing_through_the_driver(spark, monkeypatch):
    def refuse(df):
        raise AssertionError("a table of nodes is sent through the driver")

    monkeypatch.setattr(common.F, "broadcast", refuse)
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(x, x + 1) for x in range(1_000, 1_200)]
    small = {x: x for e in edges for x in e}
    for _ in range(len(small)):
        new = dict(small)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == small:
            break
        small = new
    linked = {x for a, b in edges if a != b for x in (a, b)}
    for few in (common.FEW_EDGES, 0):
        monkeypatch.setattr(common, "FEW_EDGES", few)
        scratch = common.Scratch(spark, "test")
        got = common.components(scratch, spark.createDataFrame(edges, "a bigint, b bigint"))
        assert {r["node"]: r["root"] for r in got.collect()} == {x: small[x] for x in linked}
        # of few edges no table but the distinct ones and their union is written
        assert scratch.n == 2 or not few


def test_tables_of_many_mb_are_not_sent(spark):
    assert common.small_enough(spark.range(100_000), 64)
    assert not common.small_enough(spark.range(400_000), 64)


def test_pairs_are_verified_as_one_by_one():
    rng = np.random.default_rng(5)
    block = minhash.Block()
    for n in [1, 3, 40, 40, 40, 200, 0, 90]:
        block.sets.append(np.unique(rng.integers(0, 120, n).astype(np.uint64)))
    i, j = np.triu_indices(len(block.sets), 1)
    for percent in (1, 20, 80):
        want = [100 * len(a) >= percent * len(b) for a, b in ((np.intersect1d(block.sets[x], block.sets[y]), np.union1d(block.sets[x], block.sets[y])) for x, y in zip(i, j))]
        got = block.verified(i, j, lambda c, a, b: 100 * c >= percent * (a + b - c))
        assert got.tolist() == want


def test_each_holder_of_a_seed_has_a_partner_before(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOLDERS", 3)
    at = substring_dedup.POS_BITS
    rows = [(doc << at | 5, 7) for doc in range(10, 50)] + [(60 << at, 8)]
    got = substring_dedup.before(common.Scratch(spark, "test"), spark.createDataFrame(rows, "place bigint, source bigint")).collect()
    assert sorted(r["place"] >> at for r in got) == list(range(11, 50))
    assert all(10 <= r["source"] >> at < r["place"] >> at for r in got)


def test_marks_of_lines_are_sent_for_neighbouring_ids_together(spark, monkeypatch):
    """2,000 documents lose a line: with 64 bytes for each the texts would be shuffled."""
    rows = [(i, f"{hashlib.md5(str(i).encode()).hexdigest()}\nA line that all of them have." + "\nNo line of theirs." * (i % 3 == 0)) for i in [*range(-900, 1_100), 1 << 40, -(1 << 62)]]
    rows += [(None, "A line that all of them have."), (5_000, None), (5_001, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    first = min(r[0] for r in rows if r[0] is not None)
    marked = {i: [x == 1 and i != first or x == 2 and i != -900 for x in range(t.count("\n") + 1)] for i, t in rows if i is not None and t}
    want = {(i, t, 0) if i not in marked else (i, "\n".join(x for x, gone in zip(t.split("\n"), marked[i], strict=True) if not gone), sum(marked[i])) for i, t in rows}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, sent in ((80_000, True), (0, False)):
            monkeypatch.setattr(common, "SENT_BYTES", most)
            out = line_dedup.dedup_lines(docs)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan, "SortMergeJoin" in plan) == (sent, not sent)
            assert {(r.doc_id, r.text, r.lines_removed) for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
