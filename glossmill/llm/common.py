"""Shared pieces: tables, cut lineage, byte-exact words and their hashes, union-find."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: the separators between words, space and \t \n \v \f \r.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = 256
#: Bytes of text that the vectorised parts take at once.
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most, for operators that hold whole texts and whose plan
    runs after they return; so it holds for the session. Where an operator runs its own plans, it
    uses ``batch_rows``, which puts the setting back."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` rows for what is run, not only planned, inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary folder in local mode,
    and on a cluster the warehouse, which all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            found = "file://" + tempfile.mkdtemp(prefix="glossmill-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables in the shared folder that cut the lineage of a job; a lost executor reads them again."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.saved: list[DataFrame] = []

    def save(self, df: DataFrame, *partition_by: str) -> DataFrame:
        path = f"{self.base}/t{self.n}"
        self.n += 1
        w = df.write.option("compression", "zstd")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.saved.append(out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)
        self.saved = [df for df in self.saved if not any(df is x for x in frames)]

    def free_shuffles(self) -> None:
        """Let go of the shuffle files of what has been written. Spark deletes them once the driver's
        collector finds their plans unused, which on a roomy heap may be after the job."""
        self.spark._jvm.java.lang.System.gc()

    def keep(self, *frames: DataFrame) -> None:
        """Delete all tables but these."""
        self.drop(*[df for df in self.saved if not any(df is x for x in frames)])


class RowIds:
    """Ids of which each stands for one text, for operators that tell documents apart by id.

    ``docs`` has (doc_id, text) of the rows with an id. Where no id has two texts, as is usual,
    ids stay what they are, which one aggregate of a hash a row tells. Else, or where an id isn't
    in 0 .. ``below`` - 1, each distinct (id, text) gets a number of its own, from 0 on in the
    order of ids, and ``docs`` is written with these. Rows that are equal in both are one document
    in either case; null texts are as empty ones."""

    def __init__(self, scratch: Scratch, docs: DataFrame, below: int | None = None):
        some = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
        tag = F.xxhash64(F.coalesce("text", F.lit("")))
        self.scratch, self.docs, self.ids = scratch, some, None
        outside = F.lit(False) if below is None else ~F.col("doc_id").between(0, below - 1)
        if some.groupBy("doc_id").agg(F.min(tag).alias("lo"), F.max(tag).alias("hi")).where((F.col("lo") != F.col("hi")) | outside).isEmpty():
            return
        keyed = some.withColumn("tag", self.tag(F.col("text")))
        place = F.monotonically_increasing_id()  # ascends with the sorted rows; fixed once written
        ordered = scratch.save(keyed.select("doc_id", "tag").distinct().orderBy("doc_id", "tag").select(F.col("doc_id").alias("id"), "tag", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
        sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a partition
        starts = np.cumsum([0, *(n for _, n in sizes)]).tolist()
        offsets = scratch.spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts, strict=False)], "part bigint, start bigint")
        self.ids = scratch.save(ordered.join(F.broadcast(offsets), "part").select("id", "tag", (F.col("start") + F.col("at")).alias("row_id")))
        self.docs = scratch.save(keyed.join(self.ids, (keyed["doc_id"] == self.ids["id"]) & (keyed["tag"] == self.ids["tag"])).select(F.col("row_id").alias("doc_id"), "text"))

    @staticmethod
    def tag(text: Column) -> Column:
        return F.md5(F.coalesce(text, F.lit("")).cast("binary"))

    def named(self, found: DataFrame, *columns: str) -> DataFrame:
        """found with the ids of the input in ``columns``, which hold ids of ``docs``."""
        if self.ids is None:
            return found
        for c in columns:
            found = found.join(self.ids.select(F.col("row_id").alias(c), F.col("id").alias("__id")), c).withColumn(c, F.col("__id")).drop("__id")
        return found

    def join(self, rows: DataFrame, doc_id: str, text: str, found: DataFrame, key: str, broadcast: bool) -> DataFrame:
        """rows, which have all columns of the input, with those of found beside the document that
        ``key`` names, or nulls."""
        if self.ids is None:
            return rows.join(F.broadcast(found) if broadcast else found, F.col(doc_id).cast("bigint") == F.col(key), "left").drop(key)
        ids = found.join(self.ids, F.col(key) == F.col("row_id")).drop(key, "row_id").withColumnsRenamed({"id": "__gm_of", "tag": "__gm_tag"})
        return rows.join(ids, (F.col(doc_id).cast("bigint") == F.col("__gm_of")) & (self.tag(F.col(text)) == F.col("__gm_tag")), "left").drop("__gm_of", "__gm_tag")


#: Bytes of a table that may be sent to all executors. On its way through the driver a table is there
#: as rows, as a hash table of twice the bytes and more, and packed; and several are sent in a job.
SENT_BYTES = 8 << 20


def small_enough(written: DataFrame, row_bytes: int, own: str = "") -> bool:
    """Whether a table has at most SENT_BYTES: ``row_bytes`` a row and the sum of the column ``own``."""
    size = F.count("*") * row_bytes
    if own:
        size = size + F.coalesce(F.sum(own), F.lit(0))
    return written.agg(size.alias("n")).first()["n"] <= SENT_BYTES


# ---------------------------------------------------------------- words of a batch of texts

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    got = _POWERS.get(str(base))
    if got is None or len(got) < n:
        size = max(n, 2 * CHUNK_BYTES)
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(got, out=got)
        _POWERS[str(base)] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input moves each bit of the output."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and where each begins; one more offset at the end."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(at: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts [i, j) of about ``most`` bytes; a longer text is a run of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, j
        i = j


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words ``[^\\x20\\x09-\\x0D]+`` of texts: first byte, byte after the last, and for
    each text (and one more) the number of words before it. A word never spans two texts."""
    if not len(raw):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(at), np.int64)
    solid = ~_SPACE[raw]
    first = np.empty(len(raw), bool)
    first[0] = True
    first[1:] = ~solid[:-1]
    first[at[:-1][at[:-1] < len(raw)]] = True
    first &= solid
    last = np.empty(len(raw), bool)
    last[-1] = True
    last[:-1] = ~solid[1:]
    inner = at[1:-1]
    last[inner[inner > 0] - 1] = True
    last &= solid
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(begin, at)


def span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of each run values[begin:end], equal for equal runs wherever they stand:
    a polynomial in an odd base modulo 2**64 over random byte values, shifted home by the
    inverse power, then finalised with the length."""
    n = len(values)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power(base, n), out=total[1:])
        home = _power(pow(base, -1, 1 << 64), n + 1)
        size = (end - begin).astype(np.uint64)
        return mix((total[end] - total[begin]) * home[begin] + size * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    return span_hashes(_BYTE[_LOWER[raw] if lower else raw], begin, end)


def shingles(words: np.ndarray, per_text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of each text, ordered, and where each text's begin.
    A text of fewer than k words but one at least has its whole sequence as its only shingle."""
    out, sizes = [], np.zeros(len(per_text), np.int64)
    with np.errstate(over="ignore"):
        multipliers = [np.uint64(pow(_BASE, 3 * i + 1, 1 << 64)) for i in range(k)]
        n = len(words)
        if n >= k:
            acc = np.zeros(n - k + 1, np.uint64)
            for i, m in enumerate(multipliers):
                acc += words[i : n - k + 1 + i] * m
            acc = mix(acc)
        for t in range(len(per_text) - 1):
            i, j = per_text[t], per_text[t + 1]
            if j - i >= k:
                got = np.unique(acc[i : j - k + 1])
            elif j > i:
                whole = int(j - i) + sum(int(words[i + x]) * int(multipliers[x]) for x in range(j - i))
                got = mix(np.array([whole & (2**64 - 1)], np.uint64))
            else:
                got = np.zeros(0, np.uint64)
            out.append(got)
            sizes[t + 1] = sizes[t] + len(got)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------- connected components


#: Edges up to which one task unites them all.
FEW_EDGES = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of edges that aren't the smallest of their component: roots are
    hooked to smaller ones and paths halved until no edge joins two roots."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, parent = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        p, q = parent[x], parent[y]
        apart = p != q
        if not apart.any():
            break
        np.minimum.at(parent, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    own = parent != np.arange(len(nodes))
    return nodes[own], nodes[parent[own]]


def contracted(edges: DataFrame, held: int = 1_000_000) -> DataFrame:
    """Edges (a, b) of the same components, with those of each task, or of each ``held`` that it has,
    as stars around smallest nodes: what can be united without a shuffle is, and paths are short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0

        def out():
            found = stars(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

        for batch in batches:
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += len(batch)
            if n >= held:
                yield out()
                parts, n = [], 0
        if n:
            yield out()

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a, b): root is the smallest node that it reaches.

    Distributed union-find by alternating large-star and small-star steps (Kiveris et al. 2014):
    each step is a grouping over the edges, whose number doesn't grow, and the rounds grow with
    the logarithm of the longest path. The minimum of a hot node is pre-aggregated; its edges
    aren't gathered; each task first unites what it holds. No step sends nodes through the driver,
    only a count and a checksum. Up to FEW_EDGES edges one task unites them all, and that is it;
    beyond that minima are joined by a shuffle.
    """
    state = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = state.count()
    few = n <= FEW_EDGES

    def with_least(e: DataFrame) -> DataFrame:
        return e.join(e.groupBy("a").agg(F.min("b").alias("m")), "a")

    def large(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b")

    def small(e: DataFrame) -> DataFrame:
        e = with_least(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        return e.select(F.explode(pairs).alias("s")).select("s.*").where("a <> b").distinct()

    def print_of(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    first = scratch.save(contracted(state.coalesce(1), n + 1) if few else contracted(state))
    scratch.drop(state)
    state, seen = first, None if few else print_of(first)
    while not few:  # ends: each round but the last lowers the sum of the ends of edges
        new = scratch.save(small(large(state)))
        scratch.drop(state)
        state = new
        now = print_of(state)
        if now == seen or not now[0]:
            break
        seen = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
