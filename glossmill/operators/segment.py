"""Segmentation: documents to length-bounded segments, page words to lines to paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions.text import by_slices, ends_sentence, is_heading, join_lines, looks_like_list_item, segment_whitespace, small_batches, strip

MAX_CHARS, BLOCK_CHARS, LINE_TOLERANCE = 1200, 850, 2.5
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+"


#: White space as Java's Unicode classes have it, which Python's differ from.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BREAK, _WORDS = re.compile(f"(?<=[.!?])[{_SPACE}]+"), re.compile(f"[{_SPACE}]+")


def _pack(units: list[str], most: int) -> list[str]:
    """Greedy packing with one space between; a longer unit stands alone. Linear in the text."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for u in units:
        if held and size + 1 + len(u) <= most:
            held.append(u)
            size += 1 + len(u)
        else:
            if held:
                out.append(" ".join(held))
            held, size = [u], len(u)
    return out + ([" ".join(held)] if held else [])


def _split(text: str, most: int) -> list[str]:
    if len(text) <= most:
        return [text]
    out: list[str] = []
    run: list[str] = []
    for s in filter(None, _BREAK.split(text)):
        if len(s) <= most:
            run.append(s)
            continue
        out += _pack(run, most) + _pack([w for w in _WORDS.split(s) if w], most)
        run = []
    return out + _pack(run, most)


def pack_units(units: Column, max_chars: int) -> Column:
    """Greedy packing of an array of strings with one space between; a longer unit stands alone.
    What fits depends on all before, so an array is folded, in one pass in batches."""

    @F.arrow_udf("array<string>")
    def packed(arrays: pa.Array) -> pa.Array:
        return by_slices(arrays, lambda a: _pack(a, max_chars), pa.list_(pa.string()))

    small_batches()
    return packed(units)


def split_all(texts: Column, max_chars: int = MAX_CHARS) -> Column:
    """The chunks of all texts of an array, each as ``split_by_limit`` gives them."""

    @F.arrow_udf("array<string>")
    def chunks(arrays: pa.Array) -> pa.Array:
        return by_slices(arrays, lambda a: [c for t in a if t is not None for c in _split(t, max_chars)], pa.list_(pa.string()))

    small_batches()
    return chunks(texts)


def split_by_limit(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """Chunks of at most ``max_chars``: the text as it is if it fits, else sentences packed; a
    longer sentence is packed by words and joins neither neighbour; a longer word stands alone."""
    return split_all(F.when(text.isNotNull(), F.array(text)), max_chars)


def segment_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_chars: int = MAX_CHARS, paragraphs: Column | None = None) -> DataFrame:
    """(doc_id, index from 1, segment_type, source, llm_outputs, human_edit, status, reason): the
    segments of each document, numbered through. ``paragraphs`` is an array; by default the text
    is one paragraph."""
    given = paragraphs if paragraphs is not None else F.array(F.col(text))
    solid = F.filter(F.transform(given, strip), lambda x: x.isNotNull() & (x != ""))
    cut = docs.select(F.col(doc_id).alias("doc_id"), split_all(solid, max_chars).alias("chunks"))
    trimmed = F.filter(F.transform("chunks", strip), lambda x: x != "")
    return cut.select("doc_id", F.posexplode(trimmed).alias("i", "source")).select(
        "doc_id", (F.col("i") + 1).alias("index"), F.lit("paragraph").alias("segment_type"), "source",
        F.create_map().cast("map<string,string>").alias("llm_outputs"), F.lit("").alias("human_edit"), F.lit("pending").alias("status"), F.lit("").alias("reason"),
    )


def split_paragraphs(text: Column, block_chars: int = BLOCK_CHARS) -> Column:
    """By blank lines if there are any, else sentences packed to ``block_chars``; blank: none."""
    t = F.regexp_replace(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), r"[ \t]+", " ")
    solid = lambda a: F.filter(F.transform(a, strip), lambda x: x != "")
    by_blank = solid(F.split(t, r"\n\s*\n+"))
    packed = pack_units(F.array_remove(F.split(strip(t), SENTENCE_BREAK), ""), block_chars)
    return F.when(text.isNull() | (strip(text) == ""), F.array().cast("array<string>")).when(t.rlike(r"\n\s*\n"), by_blank).otherwise(packed)


#: Words that a task folds at once; it goes on with the last line, which may not be whole yet.
HELD_WORDS = 32_768
_BOX = ["x0", "x1", "top", "bottom", "size"]


def _new_keys(table: pa.Table, names: list[str]) -> np.ndarray:
    """Which rows have other keys than the row before; the first has."""
    new = np.ones(table.num_rows, bool)
    if len(new):
        codes = [table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for k in names]
        new[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
    return new


def _fold(table: pa.Table, names: list[str], first: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines of sorted words begin, and their numbers; the first line's is given."""
    tops, pages = table.column("top").to_numpy().tolist(), _new_keys(table, names).tolist()
    begins, numbers, line, anchor = [], [], first - 1, None
    for at, (top, page) in enumerate(zip(tops, pages, strict=True)):
        if page or abs(top - anchor) > tolerance:
            line, anchor = (0 if page and at else line + 1), top
            begins.append(at)
            numbers.append(line)
    return np.array(begins, np.int64), np.array(numbers, np.int64)


def _lines(table: pa.Table, names: list[str], begins: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    """A row for each line: its words from left to right, its box and its usual size."""
    box = {c: table.column(c).to_numpy() for c in _BOX}
    line = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, table.num_rows)))
    texts = pc.fill_null(table.column("text").combine_chunks(), "").take(pa.array(np.lexsort((box["x0"], line))))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(begins, len(line)), pa.int32()), texts), " ")
    size = box["size"][np.lexsort((box["size"], line))]  # unknown ones last in a line
    known = np.add.reduceat(~np.isnan(size), begins, dtype=np.int64)
    low, high = (size[begins + np.maximum(x, 0)] for x in ((known - 1) // 2, known // 2))
    found = {"line": numbers, "text": joined, "top": np.fmin.reduceat(box["top"], begins), "bottom": np.fmax.reduceat(box["bottom"], begins), "x0": np.fmin.reduceat(box["x0"], begins), "x1": np.fmax.reduceat(box["x1"], begins), "size_med": (low + high) / 2}
    keys = [table.column(k).combine_chunks().take(pa.array(begins)) for k in names]
    return pa.RecordBatch.from_arrays([*keys, *(x if isinstance(x, pa.Array) else pa.array(x, from_pandas=True) for x in found.values())], names=[*names, *found])


def words_to_lines(words: DataFrame, keys: list[str], tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """Page words(keys, text, x0, x1, top, bottom, size) as lines (keys, line, text, top, bottom,
    x0, x1, size_med). A line takes words until one stands more than ``tolerance`` below the
    line's first, an anchor that moves by what came before, so a page is folded in order: words
    are sorted in Spark and stream through a task, which holds a line's words or HELD_WORDS."""
    names = [f.name for f in words.schema if f.name in keys]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema if f.name in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, most, first = 0, HELD_WORDS, 0

        def closed(last: bool):
            nonlocal held, n, most, first
            table = pa.Table.from_batches(held).combine_chunks()
            begins, numbers = _fold(table, names, first, tolerance)
            whole = len(begins) if last else len(begins) - 1
            end = table.num_rows if last else int(begins[-1])
            if whole:
                yield _lines(table.slice(0, end), names, begins[:whole], numbers[:whole])
            held, n, first = table.slice(end).to_batches(), table.num_rows - end, int(numbers[-1])
            most = max(HELD_WORDS, 2 * n)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
                if n >= most:
                    yield from closed(False)
        if n:
            yield from closed(True)

    row = F.rint(F.col("top") * 10) / 10
    order = [*names, row.asc_nulls_last(), F.col("x0").asc_nulls_last(), "x1", "text"]
    own = words.select(*names, "text", *[F.col(c).cast("double").alias(c) for c in _BOX])
    return own.repartition(*names).sortWithinPartitions(*order).mapInArrow(run, f"{kinds}, line bigint, text string, top double, bottom double, x0 double, x1 double, size_med double")


def drop_headers_footers(lines: DataFrame, page: list[str]) -> DataFrame:
    """Without lines in the outer 7 % of a page of six lines or more that are short and look
    like a page number, a preprint mark, a copyright or next to no letters."""
    w = Window.partitionBy(*page)
    t = strip(F.col("text"))
    n = F.length(t)
    height = F.max("bottom").over(w) - F.min("top").over(w)
    outer = (F.col("top") <= F.min("top").over(w) + 0.07 * height) | (F.col("bottom") >= F.max("bottom").over(w) - 0.07 * height)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    odd = t.rlike(r"^\d{1,4}$") | t.rlike(r"arXiv:\s*\d") | t.rlike(r"^\(?[Cc]opyright\)?") | (letters <= F.greatest(F.lit(3), F.floor(n * 0.25)))
    return lines.withColumn("__drop", (F.count("*").over(w) >= 6) & ((t == "") | ((n < 45) & outer & odd))).where("NOT __drop").drop("__drop")


def lines_to_paragraphs(lines: DataFrame, page: list[str], order: str = "line") -> DataFrame:
    """(page keys, paragraph from 1, text): breaks depend on a line and the one before it, so
    they are a window's running sum."""
    w, whole = Window.partitionBy(*page).orderBy(order), Window.partitionBy(*page)
    gap = F.col("top") - F.lag("bottom").over(w)
    lines = lines.withColumns({"__gap": gap, "__before": F.lag("text").over(w), "__x": F.lag("x0").over(w)})
    usual = F.median(F.when(F.col("__gap").between(0, 40), F.col("__gap"))).over(whole)
    lines = lines.withColumns({"__wide": F.greatest(F.lit(6.0), 2.2 * F.coalesce(usual, F.lit(3.0))), "__size": F.median("size_med").over(whole)})
    lines = lines.withColumn("__head", is_heading(F.col("text"), F.col("size_med"), F.col("__size")))
    apart = ((F.col("__gap") > F.col("__wide")) | (F.col("x0") - F.col("__x") > 12)) & ends_sentence(F.col("__before"))
    breaks = F.col("__before").isNull() | F.col("__head") | F.coalesce(F.lag("__head").over(w), F.lit(False)) | looks_like_list_item(F.col("text")) | F.coalesce(apart, F.lit(False))
    numbered = lines.withColumn("paragraph", F.sum(F.when(breaks, 1).otherwise(0)).over(w))
    held = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), strip(F.col("text")).alias("t")))), lambda x: x["t"])
    return numbered.groupBy(*page, "paragraph").agg(join_lines(F.array_remove(held, "")).alias("text")).where("text <> ''")


def merge_fragments(paragraphs: Column, short: int = 40) -> Column:
    """Pairs a short open paragraph with a lower-case one after it, once, from the front. Who may
    pair is known of each paragraph and the one before; of a run of such, every other pair is
    joined, so the array is read once."""
    solid = F.filter(F.transform(paragraphs, strip), lambda x: x != "")
    before = lambda i: F.get(solid, i - 1)
    may = F.transform(solid, lambda x, i: F.coalesce((i > 0) & (F.length(before(i)) < short) & ~ends_sentence(before(i)) & x.rlike(r"^\p{Ll}"), F.lit(False)))
    pairs = F.arrays_zip(solid.alias("text"), may.alias("may"))

    @F.pandas_udf("array<boolean>")
    def joins(flags: pd.Series) -> pd.Series:
        out = []
        for own in flags:
            done: list[bool] = []
            for x in [] if own is None else own:
                done.append(bool(x) and not (done and done[-1]))
            out.append(None if own is None else done)
        return pd.Series(out, dtype=object)

    joined = joins(F.transform(pairs, lambda p: p["may"]))
    return F.struct(solid.alias("text"), joined.alias("joins"))


def merged(parts: Column) -> Column:
    """The paragraphs of ``merge_fragments``, which has to be a column of its own by then."""
    text, joins = parts["text"], parts["joins"]
    whole = F.transform(text, lambda x, i: F.when(F.coalesce(F.get(joins, i + 1), F.lit(False)), segment_whitespace(F.concat_ws(" ", x, F.get(text, i + 1)))).otherwise(x))
    return F.filter(whole, lambda _, i: ~F.get(joins, i))


def page_paragraphs(words: DataFrame, doc_id: str = "doc_id", page: str = "page") -> DataFrame:
    """Words of pages to the paragraphs of each document: lines, without headers and footers, then
    paragraphs with fragments merged page by page, spaces put right, and pages one after another."""
    rows = lines_to_paragraphs(drop_headers_footers(words_to_lines(words, [doc_id, page]), [doc_id, page]), [doc_id, page])
    held = F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda x: x["text"])
    pages = rows.groupBy(doc_id, page).agg(held.alias("held")).select(doc_id, page, merge_fragments(F.col("held")).alias("parts"))
    spread = pages.select(doc_id, page, F.posexplode(merged(F.col("parts"))).alias("at", "text")).withColumn("text", segment_whitespace(F.col("text"))).where("text <> ''")
    order = Window.partitionBy(doc_id).orderBy(page, "at")
    return spread.select(doc_id, page, (F.row_number().over(order)).alias("paragraph"), "text")
