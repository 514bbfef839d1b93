import duckdb
import pytest


@pytest.fixture(scope="session")
def documents(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and clashing columns."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000)) + "."
    rows = [(1, None), (2, ""), (None, "a text without an id, one two three."), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, long), (7, long), (8, "é 日本 😀\x00 \x0b x<|im_end|>")]
    return spark.createDataFrame([(i, t, "c", 1.0, True) for i, t in rows], "doc_id bigint, text string, key string, score double, kept boolean")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, n_words string")
