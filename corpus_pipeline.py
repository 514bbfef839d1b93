"""From raw documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept, and what it decides takes effect: lines and
passages are cut from the texts, n_chars follows, and documents that are rejected, are copies,
or have no word left go. The last stage returns each piece of tokens with its ids and its place in
a sequence, so sequences can be written from it.

Defined results, for each stage: null and empty texts, and texts without a word, are rejected by
the first stage and would go in the others; rows with a null doc_id are kept as documents that
repeat nothing; rows that share a doc_id are documents of their own, and of rows equal in id and
text one stays in near dedup; an empty table gives an empty one; columns beyond those of documents
are dropped in the first stage, and a missing n_chars is no matter, as it is counted anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm import line_dedup, near_dedup, packing, quality_rules, substring_dedup
from glossmill.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

def _documents(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = quality_rules.kept_documents(docs.select(COLUMNS))
    return _documents(rows.withColumn("text", F.col("cleaned_text")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(line_dedup.dedup_lines(docs.select(COLUMNS)).where(substring_dedup.has_words(F.col("text"))))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id. Sets are of
    five-word shingles."""
    return near_dedup.one_of_each(docs.select(COLUMNS), k=5)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(substring_dedup.cut_passages(docs.select(COLUMNS)).where(substring_dedup.has_words(F.col("text"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, with_ids=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("substring dedup", passages), ("packing", pack)]
#: Several stages link by similarity, which SQL can't do over whole tables; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. A stage's table is dropped when the next one is written."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.keep(docs)
    out = STAGES[-1][1](spark, docs, sf_dir)  # reads its own written pieces
    scratch.keep()
    return out
