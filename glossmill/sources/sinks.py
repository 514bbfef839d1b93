"""Sinks: staged tables, appends, snapshots, archives, and the document export."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.text import strip
from glossmill.sources.files import EXTENSIONS


class Staging:
    """Written tables in the folder of spark.checkpoint.dir, which all executors share. Only in
    local mode, where it may be unset, a temporary folder stands in; a cluster uses its warehouse."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not base:
            local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
            base = "file://" + tempfile.mkdtemp(prefix="glossmill-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_staging"
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.base, self.n = spark, f"{base.rstrip('/')}/staging-{uuid.uuid4().hex[:12]}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def replace_table(df: DataFrame, path: str, fmt: str = "json") -> None:
    """All of a table at once. It is written beside the old one, which steps aside under a name of
    its own and goes only when the new one has its place; so what a crash leaves is either table
    whole, and ``restore_table`` puts it back where the name is missing."""
    spark, mark = df.sparkSession, uuid.uuid4().hex[:8]
    new, old = f"{path}.{mark}.new", f"{path}.{mark}.old"
    df.write.format(fmt).save(new)
    fs, p = _fs(spark, path)
    if fs.exists(p):
        fs.rename(p, _fs(spark, old)[1])
    if not fs.rename(_fs(spark, new)[1], p):
        raise OSError(f"{new} can't take the place of {path}")
    fs.delete(_fs(spark, old)[1], True)


def restore_table(spark: SparkSession, path: str) -> bool:
    """After a crash in ``replace_table``: where the table's name is missing, the new table takes it,
    which was whole by then. Says whether the table is there."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        for found in fs.globStatus(_fs(spark, f"{path}.*.new")[1]) or []:
            if fs.exists(_fs(spark, f"{found.getPath()}/_SUCCESS")[1]) and fs.rename(found.getPath(), p):
                break
    return fs.exists(p)


def append(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("append").format(fmt).save(path)


def append_batch(df: DataFrame, path: str, batch_id: int, fmt: str = "parquet") -> None:
    """A micro-batch under its own number: writing it again replaces it, so a retry adds nothing."""
    df.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")


def snapshot(spark: SparkSession, source: str, target: str, fmt: str = "json") -> str:
    """The accepted table as a dataset of a fixed name, replaced each time."""
    replace_table(spark.read.format(fmt).load(source), target, fmt)
    return target


def archive_and_reset(spark: SparkSession, path: str, archive_dir: str, stamp: str, vectors: str | None = None, state: str | None = None, now: Column | None = None) -> str:
    """Move the table to the archive under its time (``yyyyMMdd_HHmmss``) and leave an empty one;
    empty the memory of vectors and set the time of the last reset, where they are given."""
    fs, p = _fs(spark, path)
    target = f"{archive_dir.rstrip('/')}/master_{stamp}"
    fs.mkdirs(_fs(spark, archive_dir)[1])
    fs.rename(p, _fs(spark, target)[1])
    fs.mkdirs(p)
    if vectors is not None:
        reset_vectors(spark, vectors)
    if state is not None:
        write_state(spark, state, F.current_timestamp() if now is None else now)
    return target


VECTORS = "id bigint, item_id bigint, text string, v array<double>"


def reset_vectors(spark: SparkSession, path: str) -> None:
    """An empty memory of vectors."""
    replace_table(spark.createDataFrame([], VECTORS), path, "parquet")


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The memory of vectors; an empty one where nothing is stored."""
    fs, p = _fs(spark, path)
    return spark.read.schema(VECTORS).parquet(path) if fs.exists(p) else spark.createDataFrame([], VECTORS)


def write_state(spark: SparkSession, path: str, last_reset: Column) -> None:
    replace_table(spark.range(1).select(last_reset.alias("last_reset_ts")), path, "parquet")


def layout(spark: SparkSession, root: str, names: tuple[str, ...] = ("documents", "segments", "memory", "exports", "uploads")) -> None:
    for n in names:
        fs, p = _fs(spark, f"{root.rstrip('/')}/{n}")
        fs.mkdirs(p)


def export_text(human_edit: Column, outputs: Column) -> Column:
    """The edit if it isn't blank, else the first model's trimmed output."""
    return F.coalesce(F.nullif(strip(human_edit), F.lit("")), strip(F.element_at(outputs, "model1")), F.lit(""))


def export_lines(segments: DataFrame, by: list[str]) -> DataFrame:
    """(by, index, text): lines of an export in order, without blank ones; no index counts as 0."""
    return segments.select(*by, F.coalesce("index", F.lit(0)).alias("index"), export_text(F.col("human_edit"), F.col("llm_outputs")).alias("text")).where("text <> ''")


def write_segments(segments: DataFrame, path: str) -> None:
    """Segments in a folder for each document, so a scan of one document reads its folder only."""
    segments.repartition("doc_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def load_segments(spark: SparkSession, path: str, doc_id) -> DataFrame | None:
    """The segments of one document, or None if there are none: partitions prune to its folder."""
    rows = spark.read.parquet(path).where(F.col("doc_id") == F.lit(doc_id))
    return None if rows.isEmpty() else rows


def store_upload(spark: SparkSession, root: str, doc_id: str, name: str, data: bytes) -> str:
    """Keeps an upload as ``original{ext}`` in its document's folder; its own name decides the
    extension alone, which has to be one that is read."""
    ext = os.path.splitext(name)[1].lower()
    if ext not in EXTENSIONS:
        raise ValueError(f"unsupported file type {ext!r}")
    fs, p = _fs(spark, f"{root.rstrip('/')}/documents/{doc_id}/original{ext}")
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return str(p)


FORMATS = ("docx",)


def export_request(body: dict, stored: DataFrame, document: str) -> tuple[str, DataFrame]:
    """The format and segments of an export: ``format`` is docx by default and else refused; the
    body's own ``segments`` come before the stored ones. ``stored`` is filtered by doc_id."""
    fmt = str(body.get("format") or FORMATS[0]).strip().lower()
    if fmt not in FORMATS:
        raise ValueError(f"unsupported export format {fmt!r}")
    given = body.get("segments")
    if not given:
        return fmt, stored.where(F.col("doc_id") == document).select("index", "human_edit", "llm_outputs")
    rows = [(int(x.get("index") or 0), x.get("human_edit"), dict(x.get("llm_outputs") or {})) for x in given]
    return fmt, stored.sparkSession.createDataFrame(rows, "index int, human_edit string, llm_outputs map<string,string>")


def export_docx(segments: DataFrame, title: str, stamp: str) -> bytes:
    """One document's export as a .docx file, on the driver: a document is a file of a few pages.
    Rows stream from the executors one partition at a time."""
    rows = export_lines(segments, []).orderBy("index").toLocalIterator()
    p = lambda t, style="": f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    body = p(title, '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>') + p(stamp) + p("") + "".join(p(r["text"]) for r in rows)
    ns = "http://schemas.openxmlformats.org/"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{ns}package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{ns}package/2006/relationships"><Relationship Id="r1" Type="{ns}officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{ns}wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()
