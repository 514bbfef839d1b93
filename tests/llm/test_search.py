"""Nearest neighbours: recall against brute force, ties, and vectors that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.llm import neighbours, queries


def test_stopping():
    assert neighbours.chi_square_tail(np.array([15.507]), 8)[0] == pytest.approx(0.05, abs=1e-4)
    assert neighbours.stop_ratio(8, 0.05) == pytest.approx(15.507, abs=1e-2)


def test_recall(spark, sf_dir):
    import duckdb

    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf_dir}/embeddings.parquet'").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = queries.op8_neighbours(spark, sf_dir).collect()
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        want = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        hits += len(set(want) & {r.vec_id for r in own})
        total += 20
    assert hits / total >= 0.9


def test_many_blocks_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 6)).round(1)
    x[100:200] = x[7]  # a very common vector
    rows = [(i, v.tolist(), "?") for i, v in enumerate(x)]
    rows += [(1000, None, "?"), (1020, [0.0] * 6, "?"), (1040, [1.0, None, 1.0, 1.0, 1.0, 1.0], "?"), (1060, [float("nan")] * 6, "?"), (1080, [float("inf")] * 6, "?"), (1100, [], "?")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank string")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=20, block_rows=64, query_rows=8).collect()
    s = np.zeros((300, 300))
    for d in range(6):
        s += x[:, None, d] * x[None, :, d]
    for q in range(0, 300, 20):
        want = [(i, s[q, i]) for i in np.lexsort((np.arange(300), -s[q])) if i != q][:20]
        own = [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert len({i for i, _ in want} & {i for i, _ in own}) >= 18
        if own[-1][1] == want[-1][1]:
            assert own == want
    assert {r.query_id for r in got} == set(range(0, 300, 20))
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_many_points_of_one_score(spark):
    """Of more different vectors of one score than are kept, those of the smallest ids stay."""
    x = np.zeros((200, 40))
    order = np.random.default_rng(3).permutation(200)
    x[order, np.arange(200) % 40] = 1 + np.arange(200) // 40
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect()
    s = x @ x.T
    for q in range(0, 200, 20):
        want = [i for i in np.lexsort((np.arange(200), -s[q])) if i != q][:20]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def recall(spark, x, **how):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, **how).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21)) and [v for _, v, _ in own] == [v for _, v, _ in sorted(own, key=lambda r: (-r[2], r[1]))]
        hits += len(set(np.argpartition(-s, 20)[:20].tolist()) & {v for _, v, _ in own})
    return hits / len(range(0, len(x), 20)) / 20


@pytest.mark.parametrize("kind, n, block_rows", [("plain", 2_000, 16_384), ("plain", 2_000, 300), ("groups", 20_000, 1_500), ("plain", 20_000, 16_384), ("long", 4_000, 700)])
def test_recall_of_more_vectors(spark, kind, n, block_rows):
    """Over one unit and many, for vectors without structure, in groups, and of unlike lengths."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 32))
    if kind == "groups":
        x = rng.standard_normal((200, 32))[rng.integers(0, 200, n)] + 0.25 * x
    if kind != "long":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    else:
        x *= rng.lognormal(0, 0.6, (n, 1))
    assert recall(spark, x, block_rows=block_rows, query_rows=200) >= 0.9


def test_far_cells_get_no_queries(spark, monkeypatch):
    """Of vectors in groups most cells are ruled out by the test, so what is sent grows with n."""
    sent = []
    plain = neighbours.Scratch.save

    def counted(self, df, *a):
        out = plain(self, df, *a)
        if "floor" in df.columns:
            sent[-1] += out.count()
        return out

    monkeypatch.setattr(neighbours.Scratch, "save", counted)
    rng = np.random.default_rng(8)
    per = {}
    for n in (2_000, 16_000):
        x = rng.standard_normal((n // 50, 16))[rng.integers(0, n // 50, n)] + 0.02 * rng.standard_normal((n, 16))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        sent.append(0)
        assert recall(spark, x, block_rows=250) >= 0.9
        per[n] = sent[-1] / (n / 20)
    assert per[16_000] < 3 * per[2_000] and per[16_000] < 0.5 * 64


def test_shared_ids(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])], "vec_id bigint, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") == 0, k=2).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(0, 1), (0, 2)} and len(got) <= 4
