"""The batch operator, greedy dedup with a memory, the indexed memory search, and requests."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.functions.scores import memory_score, rounded
from glossmill.operators import curate, dedup, memory
from glossmill.sources import sinks


def test_greedy_items_is_the_sequential_rule(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 8))
    rows, existing = [], []
    for i in range(150):
        v = centres[rng.integers(12)] + 0.3 * rng.standard_normal(8)
        rows.append((i // 3, i, (v / np.linalg.norm(v)).tolist()))
    for i in range(3):
        existing.append((1000 + i, (centres[i] / np.linalg.norm(centres[i])).tolist()))
    held, want = [np.array(v) for _, v in existing], {}
    for item in range(50):
        own = [np.array(v) for i, _, v in rows if i == item]
        want[item] = not any(float(a @ b) >= 0.85 for a in own for b in held)
        if want[item]:
            held += own
    items = spark.createDataFrame(rows, "item_id bigint, id bigint, v array<double>")
    before = spark.createDataFrame(existing, "id bigint, v array<double>")
    got = dedup.greedy_items(items, before, 0.85, sinks.Staging(spark), block_rows=40)
    assert {r.item_id: r.kept for r in got.collect()} == want and 0 < sum(want.values()) < 50
    assert dedup.memory_growth(before, items, got).count() == 3 + 3 * sum(want.values())


def test_greedy_keep_on_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(25)], "a bigint, b bigint")
    got = dedup.greedy_keep(spark.range(30), edges, sinks.Staging(spark))
    assert {r.id: r.kept for r in got.collect()} == {i: i % 2 == 0 or i > 25 for i in range(30)}


def test_nearest_of_long_and_opposite_vectors(spark):
    """The nearest stays the nearest, however negative its inner product."""
    rows = [(1, [10.0, 0.0]), (2, [-10.0, 0.0]), (3, [-20.0, 0.0]), (4, None), (5, [-10.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {r.a: (r.b, r.score) for r in dedup.nearest(df, df, block_rows=2).collect()}
    assert got == {1: (2, -100.0), 2: (3, 200.0), 3: (2, 200.0), 5: (3, 200.0)}


def test_memory_index_is_the_plain_score(spark):
    """The index gives what scoring each pair gives, with frequent tokens, ties and blank texts."""
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(2500)] + ["", "  ", "Zürich Straße", "zürich straße ", None]
    asked = [" ".join(rng.choices(words, k=rng.randrange(1, 6))) for _ in range(40)] + ["", " w1", "STRASSE", "zürich", "zzz"]
    entries = spark.createDataFrame([(i, t, "en-ar" if i % 9 else "de-ar") for i, t in enumerate(texts)], "ord bigint, source string, language_pair string")
    queries = spark.createDataFrame([(i, t, "en-ar") for i, t in enumerate(asked)], "query_id bigint, query string, language_pair string")
    pairs = queries.crossJoin(entries.where("language_pair = 'en-ar'").drop("language_pair")).withColumn("score", rounded(memory_score(F.col("query"), F.col("source")))).where("score > 0")
    want = {}
    for r in sorted(pairs.collect(), key=lambda r: (r.query_id, -r.score, r.ord)):
        own = want.setdefault(r.query_id, [])
        if len(own) < 10:
            own.append((r.ord, r.score))
    for rows in (10**6, 300):
        got = {}
        for r in sorted(memory.search_all(entries, queries, block_rows=rows, query_rows=rows // 10).collect(), key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append((r.ord, r.score))
        assert got == want
    one = memory.search(entries.withColumn("target", F.lit("t")), " w1").collect()
    assert [(r.ord, r.score) for r in one] == want[41]


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, source string, llm_outputs map<string,string>, human_edit string, meaning double, quality double")


def test_batch(spark):
    """Each item has its outcome; a faulty one stops no other."""
    out = {"model1": "صباح الخير", "model2": "نهار سعيد"}
    edit = "في الصباح الباكر نلتقي كلنا عند الباب الكبير"
    rows = [
        (1, "Good morning", out, "صباح الخير", 1.0, 1.0),  # what a model said
        (2, "We meet early", out, edit, 1.0, 1.0),
        (3, "We meet early", out, edit + "!", 1.0, 1.0),  # a copy of 2
        (4, None, out, edit, 1.0, 1.0),
        (5, "Nothing", out, "😀 ", 1.0, 1.0),
        (6, "No outputs", {}, "نص جديد تماما عن البحر", 1.0, 1.0),
        (7, "Wrong", out, "نص بمعنى آخر عن الجبال", 0.0, 1.0),
        (8, "Known", out, "جملة معروفة من قبل في الذاكرة", 1.0, 1.0),
    ]
    staging = sinks.Staging(spark)
    known = curate.embedded(spark.createDataFrame([(99, "جملة معروفة من قبل في الذاكرة")], "id bigint, t string"), "t").select("id", "v")
    got = curate.process_batch(items_of(spark, rows), known, staging, now=F.lit("2024-01-01"), t=curate.Thresholds(accept=0.1))
    by = {r.item_id: r for r in got.outcomes.collect()}
    assert {k: r.decision for k, r in by.items()} == {1: "reject", 2: "accept", 3: "reject", 4: "error", 5: "error", 6: "error", 7: "reject", 8: "reject"}
    assert by[3].reason == by[8].reason == curate.COPY and by[4].message == "Missing source in item 4" and by[5].message == curate.NOTHING_LEFT
    assert by[6].message == "no model outputs" and by[7].reason == curate.MEANING and by[2].message is None
    assert [r.item_id for r in got.accepted.collect()] == [2] and {r.item_id for r in got.vectors.collect()} == {2}
    assert curate.process_batch(items_of(spark, []), known, staging).outcomes.count() == 0


def test_judges_are_columns(spark):
    rows = items_of(spark, [(1, "a", {}, "b", None, None)]).drop("meaning", "quality")
    r = curate.with_judges(rows, quality=F.when(F.length("human_edit") > 3, 1.0).otherwise(0.25)).first()
    assert r.meaning == 1.0 and r.quality == 0.25


def test_tables_come_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.replace_table(spark.range(3), path, "parquet")
    sinks.replace_table(spark.range(5), path, "parquet")
    assert spark.read.parquet(path).count() == 5 and sinks.restore_table(spark, path)
    (tmp_path / "t").rename(tmp_path / "t.x.new")  # as a crash between the two names would leave it
    assert sinks.restore_table(spark, path) and spark.read.parquet(path).count() == 5
    vectors, state = f"file://{tmp_path}/v", f"file://{tmp_path}/s"
    spark.createDataFrame([(1, 2, "x", [1.0])], sinks.VECTORS).write.parquet(vectors)
    sinks.archive_and_reset(spark, path, f"file://{tmp_path}/old", "20240101_000000", vectors, state, F.lit("2024-01-01").cast("timestamp"))
    assert sinks.load_vectors(spark, vectors).count() == 0 and sinks.load_vectors(spark, vectors + "none").count() == 0
    assert spark.read.parquet(f"file://{tmp_path}/old/master_20240101_000000").count() == 5 and spark.read.parquet(state).count() == 1


def test_export_request(spark):
    stored = spark.createDataFrame([("d", 1, "stored", {"model1": "m"}), ("e", 1, "else", {})], "doc_id string, index int, human_edit string, llm_outputs map<string,string>")
    fmt, rows = sinks.export_request({}, stored, "d")
    assert fmt == "docx" and [r.human_edit for r in rows.collect()] == ["stored"]
    fmt, rows = sinks.export_request({"format": "DOCX", "segments": [{"index": 2, "human_edit": "own"}]}, stored, "d")
    assert [r.text for r in sinks.export_lines(rows, []).collect()] == ["own"]
    with pytest.raises(ValueError):
        sinks.export_request({"format": "odt"}, stored, "d")


def test_segments_by_document(spark, tmp_path):
    rows = spark.createDataFrame([(d, i, "x") for d in range(4) for i in range(d)], "doc_id int, index int, source string")
    sinks.write_segments(rows, f"{tmp_path}/s")
    assert sinks.load_segments(spark, f"{tmp_path}/s", 3).count() == 3 and sinks.load_segments(spark, f"{tmp_path}/s", 9) is None
    plan = sinks.load_segments(spark, f"{tmp_path}/s", 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(doc_id" in plan


def test_upload_and_draft(spark, tmp_path):
    path = sinks.store_upload(spark, f"file://{tmp_path}", "d1", "../My File.DOCX", b"\x00\xffdata")
    assert path.endswith("/documents/d1/original.docx") and (tmp_path / "documents/d1/original.docx").read_bytes() == b"\x00\xffdata"
    with pytest.raises(ValueError):
        sinks.store_upload(spark, f"file://{tmp_path}", "d1", "x.exe", b"")
    segments = spark.createDataFrame([("a", 1, "", None), ("b", 2, "", "accept")], "id string, index int, human_edit string, status string")
    drafts = spark.createDataFrame([("b", "new")], "id string, human_edit string")
    got = {r.id: r for r in memory.save_drafts(segments, drafts, F.lit("2024-01-01 00:00:00"), ["index"]).collect()}
    assert got["a"].status == "pending" and got["a"].last_saved_at is None and got["b"].human_edit == "new" and got["b"].status == "accept" and got["b"].last_saved_at.year == 2024


def test_typed_rows_modes_and_errors(spark):
    good = '{"source_text": "a", "language_pair": "en-ar", "llm_outputs": {"m": "x"}, "human_translation": "b", "score": 0.5, "timestamp": "t"}'
    lines = [good, good.replace('"a"', "7"), good.replace("0.5", '"high"'), good.replace('"score": 0.5, ', ""), "{", ""]
    got = curate.typed_rows(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert len(got) == 1 and got[0].llm_outputs == {"m": "x"}
    assert curate.by_mode(None) is curate.fallback_rules and curate.by_mode("REAL ", curate.stub_rules) is curate.stub_rules
    assert spark.range(1).select(curate.error("not_found", "no such path").alias("e")).first().e.asDict() == {"code": "not_found", "message": "no such path"}


def test_judge_prompts_and_warm_memory(spark):
    out = {"b": "second", "a": "first"}
    rows = items_of(spark, [(1, "src", out, "first", None, None), (2, "src", out, "wholly other words", None, None), (3, None, {}, None, None, None)])
    by = {r.item_id: r for r in curate.judge_prompts(rows).collect()}
    assert by[1].quality_prompt.index("a: first") < by[1].quality_prompt.index("b: second") and "mend a plain fault" in by[1].quality_prompt
    assert "mend a plain fault" not in by[2].quality_prompt and "src" in by[2].meaning_prompt and by[3].quality_prompt is not None
    empty = sinks.load_vectors(spark, "file:///nowhere/at/all")
    accepted = spark.createDataFrame([(1, "One. Two!"), (2, "  "), (3, None)], "item_id bigint, human_translation string")
    first = curate.warm_memory(empty, accepted)
    assert sorted(r.text for r in first.collect()) == ["One", "Two"] and curate.warm_memory(first, accepted).count() == 2
