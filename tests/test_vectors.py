"""Vectors in blocks and tiles against all pairs at once."""

import numpy as np
import pytest

from glossmill.operators import dedup


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 6)).round(2)
    v[40:50] = v[3]  # a group of equal ones
    return v, spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")


def test_conflicts_and_ids_of_blocks(vectors):
    v, df = vectors
    scores = dedup._exact(v, v, *(x.reshape(-1) for x in np.indices((90, 90)))).reshape(90, 90)
    want = sorted((int(a), int(b), float(scores[a, b])) for a, b in zip(*np.nonzero(scores >= 3), strict=True) if a < b)
    assert sorted(map(tuple, dedup.conflicts_of(df, 3, block_rows=20).collect())) == want
    other = df.where("id >= 60")
    near = sorted(int(x) for x in np.flatnonzero((scores[:60, 60:] >= 3).any(1)))
    assert sorted(r.id for r in dedup.similar_ids(df.where("id < 60"), other, 3, block_rows=20).collect()) == near


def test_products_are_made_in_tiles():
    seen = []

    def pairs(p, q, a, b):
        seen.append(len(p) * len(q))
        return a, a, np.zeros(len(a))

    p = np.zeros((8_192, 2))
    a, *_ = dedup._tiled(pairs)(p, p, np.arange(8_192), np.arange(8_192))
    assert max(seen) <= dedup.TILE and (a == np.arange(8_192)).all()
