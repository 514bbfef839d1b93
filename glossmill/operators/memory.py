"""Translation memory: add, fuzzy search, lookups and keyed updates."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions.scores import memory_score, rounded
from glossmill.functions.text import strip

LIMIT = 10
#: Entries of a block at most, and of one of FEW blocks at least.
BLOCK_ROWS, LEAST_ROWS, FEW = 32_768, 8_192, 64
#: Queries that are Python objects at once.
QUERY_ROWS = 4_096
#: White space between tokens, as Java's \s has it.
SPACES = "[ \\t\\n\\x0b\\f\\r]+"
FOUND = "query_id bigint, ord bigint, score double"


def add_entries(memory: DataFrame, entries: DataFrame) -> DataFrame:
    return memory.unionByName(entries)


def search(memory: DataFrame, query: str, language_pair: str = "en-ar", limit: int = LIMIT) -> DataFrame:
    """The ``limit`` best entries for one query: the pair's filter reaches the scan, and the rest
    is a top-k without a full sort. Scores are rounded to four digits before they are compared;
    ties go to the earlier entry (``ord``)."""
    pair = language_pair.strip().lower()
    scored = memory.where(F.col("language_pair") == pair).withColumn("score", rounded(memory_score(F.lit(query), F.col("source"))))
    return scored.where("score > 0").orderBy(F.col("score").desc(), "ord").limit(limit).select("source", "target", "score", "ord")


class Postings:
    """Entries of a block by token, for queries of the same pair."""

    def __init__(self, ords: np.ndarray, texts: pa.Array):
        order = np.argsort(ords, kind="stable")
        self.ords, texts = ords[order], texts.take(pa.array(order))
        self.lengths, self.texts = pc.utf8_length(texts).to_numpy(), texts.to_pylist()
        lists = pc.split_pattern_regex(texts, SPACES)
        at = lists.offsets.to_numpy()
        coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        names = coded.dictionary.to_pylist()
        pairs = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(len(order), 1) + np.repeat(np.arange(len(order)), np.diff(at)))
        codes, self.entry = np.divmod(pairs, max(len(order), 1))
        if "" in names:
            some = codes != names.index("")
            codes, self.entry = codes[some], self.entry[some]
        self.begins = np.searchsorted(codes, np.arange(len(names) + 1))
        self.code = {t: c for c, t in enumerate(names) if t}
        self.sizes = np.bincount(self.entry, minlength=len(order))
        # tokens parted by a character that none holds
        self.starts = np.cumsum([0, *(len(t) + 1 for t in names)])
        self.words = "\n" + "\n".join(names) + "\n"

    def of(self, code: int) -> np.ndarray:
        return self.entry[self.begins[code] : self.begins[code + 1]]

    def with_word(self, part: str, inside: int) -> np.ndarray:
        """The entries with a token that holds ``part``, from its place ``inside`` on."""
        codes, x = [], self.words.find(part)
        while x >= 0:
            codes.append(int(np.searchsorted(self.starts, x + inside - 2, side="right")) - 1)
            x = self.words.find(part, int(self.starts[codes[-1] + 1]))
        return np.unique(np.concatenate([self.of(c) for c in codes])) if codes else np.zeros(0, np.int64)

    def holding(self, query: str) -> np.ndarray:
        """The entries whose text holds the query. All tokens of the query but the first and the last
        are tokens of such a text, the first ends one and the last begins one; texts are looked
        through only where this is so."""
        parts = re.split(SPACES, query)
        if len(parts) == 1:
            found = self.with_word(query, 1)
        elif len(parts) == 2:
            found = np.intersect1d(self.with_word(f"{parts[0]}\n", 1), self.with_word(f"\n{parts[1]}", 2), assume_unique=True)
        else:
            codes = [self.code.get(t) for t in dict.fromkeys(parts[1:-1])]
            if None in codes:
                return np.zeros(0, np.int64)
            found, *more = sorted(map(self.of, codes), key=len)
            for own in more:
                if len(found) < 64:
                    break
                found = np.intersect1d(found, own, assume_unique=True)
        return np.array([e for e in found.tolist() if query in self.texts[e]], np.int64)

    def best(self, query: str, length: int, tokens: list[str], limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, rounded scores) of the ``limit`` best entries. Tokens come from the rarest on, and
        no new entries are taken up once those not seen yet can't come among the best."""
        score = np.zeros(len(self.ords))
        inside = self.holding(query)
        lists = sorted((self.entry[self.begins[c] : self.begins[c + 1]] for c in map(self.code.get, tokens) if c is not None), key=len)
        common = np.zeros(len(self.ords), np.int32)
        n, seen = len(tokens), np.zeros(0, np.int64)
        for x, own in enumerate(lists):
            common[own] += 1
            if len(own) > 1_000 or x == len(lists) - 1:
                seen = np.flatnonzero(common)
                now = 0.25 * common[seen] / (n + self.sizes[seen] - common[seen])
                worst = 0.25 * (len(lists) - x - 1) / n  # of entries that share later tokens only
                if x < len(lists) - 1 and len(now) >= limit and np.partition(now, -limit)[-limit] > worst + 1e-4:
                    for later in lists[x + 1 :]:
                        common[seen[np.isin(seen, later, assume_unique=True)]] += 1
                    break
        if len(seen):
            score[seen] = 0.25 * common[seen] / (n + self.sizes[seen] - common[seen])
        if len(inside):
            score[inside] = np.minimum(0.95, 0.6 + 0.35 * length / self.lengths[inside])
            score[inside[[self.texts[e] == query for e in inside.tolist()]]] = 1.0
        score = np.rint(score * 1e4) / 1e4
        some = np.flatnonzero(score > 0)
        if len(some) > limit:
            some = some[score[some] >= np.partition(score[some], -limit)[-limit]]
        some = some[np.argsort(-score[some], kind="stable")][:limit]  # places are in the order of ord
        return some, score[some]


def search_all(memory: DataFrame, queries: DataFrame, limit: int = LIMIT, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``limit`` best entries for each row of queries(query_id, query, language_pair), as
    ``search`` finds them: (query_id, rank, ord, score).

    Texts are trimmed and lower-cased once a row. Entries of a pair that is asked for are dealt into
    blocks, so a frequent pair isn't one group; each entry is sent to its block only, and queries,
    which are short, to all. A task indexes its block by token and answers the queries from the
    index, sending ``limit`` rows a query at most."""
    clean = lambda c: F.lower(strip(F.col(c)))
    right = queries.select(F.col("language_pair").alias("qp"), F.col("query_id").cast("bigint").alias("query_id"), clean("query").alias("query")).where("query <> ''")
    left = memory.select(F.col("language_pair").alias("mp"), F.col("ord").cast("bigint").alias("ord"), clean("source").alias("text")).where("text <> ''")
    left = left.join(right.select(F.col("qp").alias("mp")).distinct(), "mp", "left_semi")
    rows = memory.count()
    blocks = max(1, -(-rows // block_rows), min(FEW, -(-rows // LEAST_ROWS)))

    def meet(entries: pa.Table, asked: pa.Table) -> pa.Table:
        rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if entries.num_rows and asked.num_rows:
            index = Postings(entries.column("ord").to_numpy(), pa.concat_arrays(entries.column("text").chunks))
            for batch in asked.to_batches(max_chunksize=query_rows):
                for q, text in zip(batch.column("query_id").to_pylist(), batch.column("query").to_pylist(), strict=True):
                    where, score = index.best(text, len(text), [t for t in dict.fromkeys(re.split(SPACES, text)) if t], limit)
                    rows.append((np.full(len(where), q), index.ords[where], score))
        return pa.table({c: np.concatenate(x) for c, x in zip(("query_id", "ord", "score"), zip(*rows, strict=True), strict=True)})

    one = left.select("mp", F.pmod(F.xxhash64("ord"), F.lit(blocks)).cast("int").alias("mb"), "ord", "text")
    two = right.select("qp", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qb"), "query_id", "query")
    found = one.groupBy("mp", "mb").cogroup(two.groupBy("qp", "qb")).applyInArrow(meet, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ord")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("query_id", "rank", "ord", "score")


def find_first(segments: DataFrame, segment_id: Column | str, order: list[str]) -> DataFrame:
    """The first row with an id, in a stated order."""
    return segments.where(F.col("id") == segment_id).orderBy(*order).limit(1)


def update(segments: DataFrame, changes: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """segments with ``columns`` taken from changes(key, columns) where the key matches; a key that
    is absent changes nothing, and only the first of rows that share one changes."""
    new = changes.select(key, *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__hit"))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    out = segments.withColumn("__first", first).join(new, key, "left")
    hit = F.coalesce(F.col("__hit") & F.col("__first"), F.lit(False))
    return out.withColumns({c: F.when(hit, F.col(f"__new_{c}")).otherwise(F.col(c)) for c in columns}).select(segments.columns)


def save_drafts(segments: DataFrame, drafts: DataFrame, now: Column, order: list[str], key: str = "id") -> DataFrame:
    """segments with the edits of drafts(key, human_edit) and the time they were saved; a status stays,
    and is pending where there was none."""
    kept = segments if "last_saved_at" in segments.columns else segments.withColumn("last_saved_at", F.lit(None).cast("timestamp"))
    kept = kept.withColumn("status", F.coalesce("status", F.lit("pending")))
    return update(kept, drafts.select(key, "human_edit", now.cast("timestamp").alias("last_saved_at")), key, ["human_edit", "last_saved_at"], order)
