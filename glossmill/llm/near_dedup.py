"""MinHash near-dedup of documents with sequential Bayesian verification.

Words are runs of other bytes than space and \\t \\n \\v \\f \\r, with A-Z lower-cased; a text's set
holds its distinct k-word shingles (fewer words: the whole sequence as one; none: empty, linked
with nothing). Texts whose Jaccard similarity is at least ``percent`` / 100 are linked; the
answer is the connected component of each document.

Documents of equal sets (by a 128-bit key) are one item from the start, so groups of copies cost
a row each; an item has a number of its own, whatever the ids of its documents. Of an item only
its band keys are shuffled; texts are read again, and moved, only for items that share a band
with another. See ``minhash`` for how families of candidates are resolved exactly. A pair at the
threshold shares no band with a probability of (1 - 0.8**4)**32, 5e-8, for ideal hashes.

Defined results: a null doc_id links with nothing and is kept; rows that share a doc_id are
compared by their own texts, and as an id is its own, all of them are kept if none of their
components reaches a smaller id; null texts are empty; an empty table gives no rows; columns
other than the two are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import BATCH_ROWS, RowIds, Scratch, batch_rows, chunks, components, shingles, signed, small_enough, text_bytes, word_bounds, word_hashes
from glossmill.llm.minhash import PART, band_edges, band_keys, families, resolve, signatures

BANDS, ROWS, MISS = 32, 4, 1e-6
ITEMS = "doc_id bigint, n_shingles bigint, key1 bigint, key2 bigint, bands array<bigint>"


def word_sets(k: int):
    def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, at = text_bytes(texts)
        parts, sizes = [], [0]
        for i, j in chunks(at):
            begin, end, per = word_bounds(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            hashes, begins = shingles(word_hashes(raw[at[i] : at[j]], begin, end), per, k)
            parts.append(hashes)
            sizes += (begins[1:] + sizes[-1]).tolist()
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(sizes, np.int64)

    return sets


def items(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    sets = word_sets(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(1))
            for i, j in chunks(at):
                part = batch.slice(i, j - i)
                hashes, begins = sets(part.column(1))
                keys = [blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(begins[:-1], begins[1:], strict=True)]
                pair = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                found = signed(band_keys(signatures(hashes, begins, bands * rows), rows)).reshape(-1)
                ends = pa.array(np.arange(j - i + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(begins)), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.ListArray.from_arrays(ends, pa.array(found))], names=["doc_id", "n_shingles", "key1", "key2", "bands"])

    return docs.mapInArrow(run, ITEMS)


def _classes(docs: DataFrame, k: int, percent: int, miss: float) -> tuple[DataFrame, DataFrame, RowIds, Scratch]:
    """A row for each row of docs(doc_id, text), with its set's size and key, and (key1, key2, root,
    component) of the sets, where component is the smallest doc_id that links reach."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    rows = RowIds(scratch, docs)
    with batch_rows(spark, BATCH_ROWS):
        found = scratch.save(items(rows.docs, k))
        some = found.where("n_shingles > 0").groupBy("key1", "key2").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"))
        classes = scratch.save(some.withColumn("node", F.monotonically_increasing_id()))
        ties = scratch.save(band_edges(classes, -(-classes.count() * BANDS // PART) or 1))
        family = scratch.save(families(scratch, ties).join(classes.select("node", "first"), "node"))
        scratch.drop(ties)
        # the texts of one id are equal, so which of them comes makes no difference
        texts = rows.docs.join(F.broadcast(family) if small_enough(family, 48) else family, F.col("doc_id") == F.col("first"))
        members = scratch.save(texts.groupBy("family", "node").agg(F.first("text").alias("text")))
        links = resolve(scratch, members, word_sets(k), BANDS * ROWS, ROWS, percent, miss)
        roots = scratch.save(components(scratch, links))
    named = rows.named(classes.select("key1", "key2", "node", "first"), "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    of = scratch.save(named.join(least, "root").select("key1", "key2", "root", "component"))
    scratch.keep(found, of, *([] if rows.ids is None else [rows.ids]))
    return found, of, rows, scratch


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: component_id is the smallest doc_id
    that links reach, and kept says whether it is the row's own."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found, of, rows, scratch = _classes(docs, k, percent, miss)
    own = rows.named(found.drop("bands"), "doc_id")
    without = docs.where("doc_id IS NULL")
    if not without.isEmpty():
        with batch_rows(docs.sparkSession, BATCH_ROWS):
            own = own.unionByName(scratch.save(items(without, k)).drop("bands"))
    out = own.join(of, ["key1", "key2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", miss: float = MISS) -> DataFrame:
    """docs with one row of each component: of the smallest doc_id, and of its rows, should it
    have several, the first by its text's hash. Rows without an id or a word stay."""
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found, of, rows, scratch = _classes(own, k, percent, miss)
    linked = found.where("n_shingles > 0").select("doc_id", "key1", "key2").join(of, ["key1", "key2"])
    stays = linked.groupBy("root").agg(F.min("doc_id").alias("stays"))
    gone = scratch.save(linked.join(stays, "root").where("doc_id <> stays").select(F.col("doc_id").alias("__gm_gone")).distinct().withColumn("__gm_copy", F.lit(True)))
    out = rows.join(docs, doc_id, text, gone, "__gm_gone", small_enough(gone, 24)).where("__gm_copy IS NULL").drop("__gm_copy")
    # rows that are equal in id and text: those of ids that occur once pass by
    again = scratch.save(own.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__gm_again")))
    if again.isEmpty():
        return out
    first = out.join(again, F.col(doc_id).cast("bigint") == F.col("__gm_again"), "left_semi").dropDuplicates([doc_id, text])
    return out.join(again, F.col(doc_id).cast("bigint") == F.col("__gm_again"), "left_anti").unionByName(first)
