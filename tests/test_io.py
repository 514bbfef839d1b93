"""Sources, sinks, greedy dedup and the stream."""

import random
import zipfile
from io import BytesIO

from pyspark.sql import functions as F

from glossmill.operators import curate, dedup, memory
from glossmill.sources import files, sinks
from glossmill.streaming.ingest import curate_stream


def test_json_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "bad.json").write_text("{[")
    (tmp_path / "l.jsonl").write_text('{"x": 1}\n\n{"x":\n{"x": 3}\n')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("x", T.LongType())])
    assert sorted(r.x for r in files.read_json(spark, str(tmp_path / "a.json"), schema).collect()) == [1, 2]
    assert files.read_json(spark, str(tmp_path / "bad.json"), schema).count() == 0
    assert files.read_json(spark, str(tmp_path / "none.json"), schema).count() == 0
    assert sorted(r.x for r in files.read_json_lines(spark, str(tmp_path / "l.jsonl"), "x bigint").collect()) == [1, 3]
    assert files.line_count(spark, str(tmp_path / "l.jsonl")).first().n == 4


def test_docx_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(2, "second & last", None), (1, " ", {"model1": " first "}), (3, "", None)], "index int, human_edit string, llm_outputs map<string,string>")
    data = sinks.export_docx(rows, "Title", "2024")
    assert zipfile.ZipFile(BytesIO(data)).testzip() is None
    assert files.docx_paragraphs(data) == ["Title", "2024", "first", "second & last"]
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "x.DOCX").write_bytes(data)
    (tmp_path / "u" / "y.txt").write_bytes(b"no")
    got = files.read_uploads(spark, str(tmp_path / "u")).collect()
    assert len(got) == 1 and got[0].paragraphs[-1] == "second & last"


def test_tables(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), p)
    sinks.append(spark.range(3, 5), p)
    assert spark.read.json(p).count() == 5
    sinks.snapshot(spark, p, str(tmp_path / "snap"))
    assert spark.read.json(str(tmp_path / "snap")).count() == 5
    target = sinks.archive_and_reset(spark, p, str(tmp_path / "archive"), "20240101_000000")
    assert spark.read.json(target).count() == 5
    sinks.write_state(spark, str(tmp_path / "s"), F.to_timestamp(F.lit("2024-01-01")))
    assert str(files.last_reset(spark.read.parquet(str(tmp_path / "s")), spark).first()[0]).startswith("2024-01-01")
    assert files.last_reset(None, spark).first()[0] is not None


def test_names(spark):
    row = spark.createDataFrame([("../a b/ç.PDF",)], "x string").select(files.secure_name(F.col("x")), files.supported(F.col("x"))).first()
    assert row[0] == "a_b_.PDF" and row[1]


def test_greedy_matches_loop(spark):
    rng = random.Random(2)
    for n, m in ((40, 80), (1, 0), (30, 400)):
        edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} if n > 1 else set()
        kept = []
        for i in range(n):
            if not any((j, i) in edges for j in kept):
                kept.append(i)
        got = dedup.greedy_keep(spark.range(n), spark.createDataFrame(list(edges), "a bigint, b bigint") if edges else spark.createDataFrame([], "a bigint, b bigint"), sinks.Staging(spark))
        assert sorted(r.id for r in got.where("kept").collect()) == kept


def test_update_first_only(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x")], "id string, n int, v string")
    new = spark.createDataFrame([("a", "y"), ("zz", "y")], "id string, v string")
    assert sorted(map(tuple, memory.update(rows, new, "id", ["v"], ["n"]).collect())) == [("a", 1, "y"), ("a", 2, "x"), ("b", 1, "x")]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("s", "long enough edit"), ("s", "no")], "source string, human_edit string").write.json(src)
    items = spark.readStream.schema("source string, human_edit string").json(src)
    args = (str(tmp_path / "ok"), str(tmp_path / "no"), str(tmp_path / "ck"), str(tmp_path / "ds"))
    curate_stream(items, curate.fallback_rules, *args, rows=1).awaitTermination()
    assert spark.read.parquet(args[0]).count() == 1 and spark.read.parquet(args[1]).count() == 1
    assert spark.read.parquet(args[3]).count() == 1
