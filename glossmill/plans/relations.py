"""The library's relations over the star-schema and text tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.functions.text import sentences
from glossmill.sources.files import table

#: Conversation turns as items: a user's turn is the source, the reply the human edit, and three
#: derived texts stand for model outputs. Labels stand for judges.
PAYLOAD = """
t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
payload AS (SELECT conv_id * 1000 + turn AS item_id, conv_id, turn, text AS source, next_text AS human_edit,
  left(next_text, CAST(floor(length(next_text) * 0.9) AS INTEGER)) AS model1, text AS model2, replace(next_text, 'th', 't') AS model3
  FROM t WHERE role = 'user' AND next_role = 'assistant')
"""
MEMORY = """
m AS (SELECT doc_id AS ord, lower(lang) || '-ar' AS language_pair, text AS source, 'ar: ' || text AS target FROM documents)
"""


def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "human_edit": F.lead("text").over(w)})
    outputs = F.create_map(F.lit("model1"), F.left("human_edit", F.floor(F.length("human_edit") * 0.9).cast("int")), F.lit("model2"), F.col("source"), F.lit("model3"), F.replace("human_edit", F.lit("th"), F.lit("t")))
    return rows.where("role = 'user' AND next_role = 'assistant'").withColumnRenamed("text", "source").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "conv_id", "turn", "source", "human_edit", outputs.alias("llm_outputs"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), (F.lit(1.0) - F.col("toxic")).alias("meaning"), F.col("quality").cast("double").alias("quality"))
    rows = payload(spark, sf_dir).join(labels, "conv_id", "left")
    return rows.withColumns({"meaning": F.coalesce("meaning", F.lit(1.0)), "quality": F.coalesce("quality", F.lit(1.0))})


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lower("lang"), F.lit("-ar")).alias("language_pair"), F.col("text").alias("source"), F.concat(F.lit("ar: "), "text").alias("target"))


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


#: One table of made lines a document, as a page's layout: every text line gets a box.
LINES = """
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
pages_ AS (SELECT doc_id, line, text, line * 14.0::DOUBLE + (line % 3) * 3.0::DOUBLE AS top, line * 14.0::DOUBLE + (line % 3) * 3.0::DOUBLE + 10.0::DOUBLE AS bottom,
  (line % 4) * 8.0::DOUBLE AS x0, 500.0::DOUBLE AS x1, 10.0::DOUBLE + (line % 5 = 0)::INTEGER * 2 AS size_med FROM ln)
"""


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    top = F.col("line") * 14.0 + (F.col("line") % 3) * 3.0
    return rows.select("doc_id", "line", "text", top.alias("top"), (top + 10.0).alias("bottom"), ((F.col("line") % 4) * 8.0).alias("x0"), F.lit(500.0).alias("x1"), (F.lit(10.0) + F.when(F.col("line") % 5 == 0, 2).otherwise(0)).alias("size_med"))
