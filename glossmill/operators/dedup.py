"""Near neighbours over vectors and greedy dedup against an accumulating memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.sources.sinks import Staging

BLOCK_ROWS = 8_192
#: Inner products that a task has at once, and pairs whose vectors it copies at once.
TILE, COPIED = 1 << 20, 1 << 15


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    """Vectors as rows, from their buffers; shorter ones count as filled up with zeros."""
    lists = pa.concat_arrays(t.column(column).chunks)
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(at)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat[at[0] : at[-1]].reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    for i, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)):
        out[i, : y - x] = flat[x:y]
    return out


def _same_width(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(p.shape[1], q.shape[1])
    return np.pad(p, ((0, 0), (0, n - p.shape[1]))), np.pad(q, ((0, 0), (0, n - q.shape[1])))


def _exact(p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows i of p and j of q, summed from the first component to the last."""
    score = np.zeros(len(i))
    for x in range(0, len(i), COPIED):
        u, v = p[i[x : x + COPIED]], q[j[x : x + COPIED]]
        for d in range(p.shape[1]):
            score[x : x + COPIED] += u[:, d] * v[:, d]
    return score


def _tiled(pairs):
    """``pairs`` for some rows of the left vectors at a time, so that a block's products are never
    all there at once."""

    def run(p, q, a, b):
        step = max(1, TILE // max(len(q), 1))
        parts = [pairs(p[x : x + step], q, a[x : x + step], b) for x in range(0, len(p), step)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    return run


def _meet(left: DataFrame, right: DataFrame, pairs, block_rows: int, once: bool = False) -> DataFrame:
    """(a, b, score) that ``pairs(vectors, vectors, ids, ids)`` gives for each block of left(id, v)
    beside each of right(id, v); with ``once``, where both are one table, two blocks meet one way
    round. Rows without a vector take no part."""

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.table(dict(zip(("a", "b", "score"), _tiled(pairs)(*_same_width(_matrix(x, "v"), _matrix(y, "w")), x.column("id").to_numpy(), y.column("other").to_numpy()), strict=True)))

    blocks = lambda df: max(1, -(-df.count() // block_rows))
    m, n = blocks(left), blocks(right)

    def dealt(key: str, k: int):
        return F.pmod(F.xxhash64(key), F.lit(k)).cast("int")

    def all_of(k: int):
        return F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    # own names for the right side: both may stem from one table
    sound = lambda df: df.where("id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL)")
    other = sound(right).select(F.col("id").alias("other"), F.col("v").alias("w"))
    one = sound(left).select(dealt("id", m).alias("bl"), all_of(n).alias("br"), "id", "v")
    two = other.select(all_of(m).alias("rl"), dealt("other", n).alias("rr"), "other", "w")
    if once:
        one, two = one.where("bl <= br"), two.where("rl <= rr")
    return one.groupBy("bl", "br").cogroup(two.groupBy("rl", "rr")).applyInArrow(meet, "a bigint, b bigint, score double")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, score): ids of left(id, v) and right(id, v) whose inner product is ``threshold`` or
    more. Both are dealt into blocks, and each pair of blocks is one matrix product, so memory
    is bounded and only similar pairs leave a task."""

    def pairs(p, q, a, b):
        i, j = np.nonzero(p @ q.T >= threshold - 1e-9)
        score = _exact(p, q, i, j)
        keep = score >= threshold
        return a[i[keep]], b[j[keep]], score[keep]

    return _meet(left, right, pairs, block_rows)


def conflicts_of(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, score), a < b: the pairs of ``similar_pairs`` of a table of unique ids with itself, each
    found once."""

    def pairs(p, q, a, b):
        i, j = np.nonzero(p @ q.T >= threshold - 1e-9)
        if len(a) and len(b) and np.isin(a[:1], b)[0]:  # a block beside itself has both ways round
            i, j = i[a[i] < b[j]], j[a[i] < b[j]]
        score = _exact(p, q, i, j)
        keep = score >= threshold
        a, b = a[i[keep]], b[j[keep]]
        return np.minimum(a, b), np.maximum(a, b), score[keep]

    return _meet(vectors, vectors, pairs, block_rows, once=True)


def similar_ids(left: DataFrame, right: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id) of left(id, v) with a vector of right(id, v) whose inner product is ``threshold`` or more.
    Of a block only ids leave a task, however many vectors are similar."""

    def pairs(p, q, a, b):
        near = p @ q.T
        j = near.argmax(1)
        i = np.flatnonzero(near[np.arange(len(p)), j] >= threshold - 1e-9)
        hit = np.zeros(len(p), bool)
        hit[i] = _exact(p, q, i, j[i]) >= threshold
        x, y = np.nonzero(near[i[~hit[i]]] >= threshold - 1e-9)  # rounding: another may be the one
        x = i[~hit[i]][x]
        hit[x[_exact(p, q, x, y) >= threshold]] = True
        return a[hit], a[hit], np.zeros(int(hit.sum()))

    return _meet(left, right, pairs, block_rows).select(F.col("a").alias("id")).distinct()


def nearest(left: DataFrame, right: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, score): the nearest of right for each of left, other than itself; ties to the smaller id.
    Of a block only the nearest leaves a task, whatever its score."""

    def pairs(p, q, a, b):
        near = p @ q.T
        near[a[:, None] == b[None, :]] = -np.inf
        top = near.max(1)
        # all that rounding could have kept from being the first; the exact score decides
        i, j = np.nonzero(near >= (top - 1e-9 * (1 + np.abs(top)))[:, None])
        some = np.isfinite(near[i, j])
        i, j = i[some], j[some]
        score = _exact(p, q, i, j)
        order = np.lexsort((b[j], -score, i))
        first = order[np.r_[True, i[order][1:] != i[order][:-1]]] if len(order) else order
        return a[i[first]], b[j[first]], score[first]

    best = F.max_by(F.struct("b", "score"), F.struct("score", -F.col("b"))).alias("s")
    return _meet(left, right, pairs, block_rows).groupBy("a").agg(best).select("a", "s.b", "s.score")


def is_duplicate(items: DataFrame, memory: DataFrame, threshold: float = 0.85) -> DataFrame:
    """items(item_id, id, v): whether any sentence of an item is similar to one of the memory."""
    hits = similar_ids(items.select("id", "v"), memory, threshold).withColumn("hit", F.lit(True))
    return items.join(hits, "id", "left").groupBy("item_id").agg(F.coalesce(F.bool_or(F.coalesce("hit", F.lit(False))), F.lit(False)).alias("duplicate"))


def greedy_keep(nodes: DataFrame, conflicts: DataFrame, staging: Staging) -> DataFrame:
    """(id, kept) of the sequential rule on nodes(id): an item is kept if no kept earlier one
    conflicts. conflicts(a, b) has a < b. In each round, items whose earlier neighbours are all
    decided are: kept if none is left, and dropped beside a kept one. Only the edges between
    undecided items are carried on, in written tables, so a round costs what is open; the first
    undecided item of each chain is decided in every round. Only counts reach the driver."""
    edges = staging.save(conflicts.select("a", "b").distinct())
    dropped: list[DataFrame] = []
    while not edges.isEmpty():
        # open items that no open earlier one conflicts with are kept
        later = edges.select("b").distinct()
        keep = edges.select("a").distinct().join(later, F.col("a") == F.col("b"), "left_anti")
        gone = staging.save(edges.join(keep, "a", "left_semi").select(F.col("b").alias("id")).distinct())
        dropped.append(gone)
        # what a dropped item would have kept out is free of it; edges of kept ones are settled
        rest = edges.join(keep, "a", "left_anti").join(gone, F.col("a") == F.col("id"), "left_anti").join(gone, F.col("b") == F.col("id"), "left_anti")
        edges = staging.save(rest)
    if not dropped:
        return nodes.select("id", F.lit(True).alias("kept"))
    out = dropped[0]
    for more in dropped[1:]:
        out = out.union(more)
    return nodes.select("id").join(out.withColumn("gone", F.lit(True)), "id", "left").select("id", F.col("gone").isNull().alias("kept"))


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Greedy dedup when similarity is equality: the first row of each key. First rows are found by
    a minimum, which tasks aggregate before the shuffle, so a frequent key is no hot group."""
    first = rows.groupBy(*[F.col(c).alias(f"__key_{c}") for c in key]).agg(F.min(F.struct(*order)).alias("__first"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    names = [c for c in rows.columns if c != "kept"]
    return rows.join(first, same).select(*names, (F.struct(*order) == F.col("__first")).alias("kept"))


def greedy_items(items: DataFrame, existing: DataFrame, threshold: float, staging: Staging, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(item_id, kept) of items(item_id, id, v), a row for each sentence, in the order of item_id: an
    item is kept if none of its sentences is close to one of the memory ``existing`` (id, v) or of
    an item that was kept before, and what is kept joins the memory. Sentence ids are unique.

    The order-dependent rule is found over conflicts of items, as in ``greedy_keep``; the memory
    itself is an item before all others that is always kept."""
    own = items.select("item_id", "id", "v")
    beside = similar_ids(own.select("id", "v"), existing, threshold, block_rows)
    known = staging.save(own.join(beside, "id", "left_semi").select("item_id").distinct())
    open_ = staging.save(own.join(known, "item_id", "left_anti"))
    pairs = conflicts_of(open_.select("id", "v"), threshold, block_rows)
    of = open_.select("id", "item_id")
    conflicts = pairs.join(of.select(F.col("id").alias("a"), F.col("item_id").alias("ia")), "a").join(of.select(F.col("id").alias("b"), F.col("item_id").alias("ib")), "b").where("ia <> ib").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    kept = greedy_keep(open_.select(F.col("item_id").alias("id")).distinct(), conflicts, staging)
    return kept.select(F.col("id").alias("item_id"), "kept").union(known.select("item_id", F.lit(False).alias("kept")))


def memory_growth(existing: DataFrame, items: DataFrame, kept: DataFrame) -> DataFrame:
    """The memory (id, v) with the sentences of kept items appended."""
    return existing.select("id", "v").union(items.join(kept.where("kept"), "item_id", "left_semi").select("id", "v"))
