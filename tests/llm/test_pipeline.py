"""The pipeline's stages against brute force on the smallest tables."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tests.llm.test_dedup import brute_lines, components, similar, word_set
from tests.llm.test_tokens import check_packed

from glossmill.llm import line_dedup
from glossmill.llm.common import Scratch, table


def test_stages(spark, sf_dir):
    scratch, docs = Scratch(spark, "test"), table(spark, sf_dir, "documents")
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "substring dedup", "packing"]
    out = {}
    for name, stage in pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == pipeline.COLUMNS
            assert all(r.n_chars == len(r.text) for r in out[name])
    text = {n: {r.doc_id: r.text for r in rows} for n, rows in out.items() if n != "packing"}
    assert text["line dedup"] == {d: t for d, t in brute_lines(list(text["quality rules"].items()), line_dedup.SHINGLE).items() if t.strip()}
    sets = {d: word_set(t, 5) for d, t in text["line dedup"].items()}
    root = components(sets, lambda a, b: similar(sets[a], sets[b]))
    assert text["near dedup"] == {d: t for d, t in text["line dedup"].items() if root[d] == d}
    seen = defaultdict(set)
    for d, t in sorted(text["substring dedup"].items()):
        w = t.encode().lower().split()
        runs = {tuple(w[i : i + 60]) for i in range(len(w) - 59)}
        assert not [r for r in runs if r in seen and len(set(r)) > 10]
        for r in runs:
            seen[r].add(d)
    check_packed(out["packing"], list(text["substring dedup"].items()))


def test_run(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir).collect()
    assert rows and all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


def prose(rng, n):
    return " ".join(f"word{rng.randrange(10**6)}" for _ in range(n)) + "."


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_on_odd_and_no_rows(spark, sf_dir, rows):
    """Nulls in all columns, empty and long texts, repeated rows and shared ids pass every stage."""
    rng = random.Random(4)
    a, b, long = prose(rng, 80), prose(rng, 90), prose(rng, 30_000)
    made = [(1, a), (1, b), (1, a), (None, prose(rng, 60)), (2, None), (3, ""), (4, " \n "), (5, a + " Its end."), (6, long), (7, prose(rng, 70))]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, line int"
    docs = spark.createDataFrame([(i, t, None, None, None, None, 1) for i, t in made] if rows == "odd" else [], schema)
    scratch, out = Scratch(spark, "test"), {}
    for name, stage in pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
        out[name] = docs.collect()
        assert name == "packing" or docs.columns == pipeline.COLUMNS
    if rows == "none":
        assert not any(out.values())
        return
    assert sorted((r.doc_id or 0) for r in out["quality rules"]) == [0, 1, 1, 1, 5, 6, 7]
    left = sorted(((r.doc_id or 0), r.text) for r in out["near dedup"])
    assert [i for i, _ in left] == [0, 1, 1, 6, 7] and {t for i, t in left if i == 1} == {a, b}
    assert {r.doc_id for r in out["packing"]} == {None, 1, 6, 7}
    check = {(r.doc_id, r.piece, r.ids_crc32) for r in out["packing"]}
    assert len(check) == len(out["packing"])
