"""Segments and chunks on texts that the test tables don't have."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glossmill.functions import text
from glossmill.operators import segment
from glossmill.plans import registry

LONG = " ".join(f"Sentence number {i} of a text." for i in range(90))
TEXTS = ["plain", " led by a space", "ends with one \n", "", " \t\n ", None, f"\n{LONG}", f"{LONG} open \n", "word " * 400, f" {'x' * 1500} {LONG}"]


@pytest.fixture(scope="module")
def odd_docs(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en", "made", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["segments_by_doc", "char_limit_split", "segment_document"])
def test_white_space_at_the_ends(spark, odd_docs, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd_docs}/documents.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in want.description]
    got = registry.queries()[name](spark, odd_docs)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("made", ["split_by_limit", "split_paragraphs", "nfc"])
def test_python_gets_few_texts_at_once(spark, made):
    @F.pandas_udf("long")
    def batch(x: pd.Series) -> pd.Series:
        return pd.Series([len(x)] * len(x))

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, "10000")
    try:
        docs = spark.range(0, 3000, 1, 1).select(F.col("id").cast("string").alias("text"))
        out = (text.nfc if made == "nfc" else getattr(segment, made))(F.col("text"))
        seen = docs.select(batch(out.cast("string")).alias("n")).agg(F.max("n"), F.count("*")).first()
        assert seen[0] <= 256 and seen[1] == 3000
    finally:
        spark.conf.set(key, before)
