"""Sources: tables, JSON and JSON lines, uploads and their parsers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.functions.text import strip

EXTENSIONS = (".pdf", ".docx")
Parser = Callable[[bytes], list[str]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array; what is missing, empty or malformed gives no rows, and stays as it is."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], schema)
    rows = F.from_json("value", T.ArrayType(schema), {"mode": "PERMISSIVE"})
    return spark.read.text(path, wholetext=True).select(F.explode(rows).alias("r")).where("r IS NOT NULL").select("r.*")


def parse_json_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of JSON lines without blank and malformed ones."""
    parsed = lines.where(strip(F.col(column)) != "").select("*", F.from_json(column, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r IS NOT NULL AND r._bad IS NULL").withColumn("r", F.col("r").dropFields("_bad"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parse_json_lines(spark.read.text(path), schema).select("r.*")


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """All lines, blank and malformed ones too."""
    return spark.read.text(path).agg(F.count("*").alias("n"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def supported(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def secure_name(name: Column) -> Column:
    """A file name without folders or characters that mean something to a shell or a file system."""
    base = F.regexp_replace(F.regexp_replace(name, r"[/\\]+", " "), r"\s+", "_")
    return F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9_.-]", ""), r"^[._]+|[._]+$", "")


def docx_paragraphs(data: bytes) -> list[str]:
    """Trimmed paragraphs of a .docx body that have text; tables and headers are left out."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    found = ("".join(t.text or "" for t in p.iter(f"{w}t")).strip() for p in root.findall(f"{w}body/{w}p"))
    return [x for x in found if x]


#: Parsers by extension. No PDF library is at hand: register one to read PDF files.
PARSERS: dict[str, Parser] = {".docx": docx_paragraphs}


def register_parser(ext: str, parser: Parser) -> None:
    PARSERS[ext.lower()] = parser


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, paragraphs) of the files under a path that a parser is registered for."""
    parsers = dict(PARSERS)

    @F.pandas_udf("array<string>")
    def parse(ext: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([parsers[e](c) if e in parsers else [] for e, c in zip(ext, content, strict=True)])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = extension(F.col("path"))
    return files.where(ext.isin(*parsers)).select("path", parse(ext, "content").alias("paragraphs"))


def last_reset(state: DataFrame | None, spark: SparkSession) -> DataFrame:
    """(last_reset_ts), now if no state is kept."""
    one = spark.range(1)
    if state is None:
        return one.select(F.current_timestamp().alias("last_reset_ts"))
    return one.join(state.select("last_reset_ts").limit(1), how="left").select(F.coalesce("last_reset_ts", F.current_timestamp()).alias("last_reset_ts"))
