"""Approximate nearest neighbours: stable projections in a kd-tree with a chi-square stopping test.

Nearness is the inner product. One more coordinate, sqrt(M^2 - |x|^2) with M the largest norm,
makes it a Euclidean distance: the order of both is the same. Gaussian projections to ``m``
dimensions are stable: a point at distance r has a projected distance of r times the root of a
chi-square variable of m degrees. The vectors of a block are projected and indexed by a kd-tree;
a query visits its leaves in the order of projected distance and verifies each point on the
original vectors, until the test holds: a point as near as the worst of the current k would
have been seen by now with a probability of 1 - ``miss`` at least.

The tree has two levels. Its upper one is fitted on the projections of at most ``SAMPLE`` rows
and deals every row to a cell; cells of more than ``block_rows`` vectors part by a hash, so each
unit is of bounded size whatever the data. A cell's box is taken over all its rows. Queries go
through cells in the order of projected distance, in waves: the nearest cell, then ``WAVE`` more,
then what the test still leaves; each wave carries the k-th best found so far to the next, and a
cell that the test rules out is never sent a query. In a unit the lower level, a kd-tree over its
own projections, is visited leaf by leaf in the same way. Equal vectors of a unit are one point
of the tree that carries its ids, so a very common vector costs no more than another.

Where vectors have no structure, as where all directions are equally likely, the k-th neighbour is
hardly nearer than any other point, the test rules out next to nothing, and the work is that of
comparing all queries with all vectors, in blocks.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part; shorter vectors count as filled up with zeros; ties go to the smaller vec_id; a query
never finds itself by its id, so rows that share a vec_id don't find each other, and as queries
they are one, with the nearest of either; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.common import Scratch

K, M_DIMS, MISS, LEAF, BLOCK_ROWS, QUERY_ROWS, SEED = 20, 8, 0.02, 256, 16_384, 4_096, 20260102
#: Rows that the upper level of the tree is fitted on at most, how many of them a cell has at least,
#: and cells of the second wave.
SAMPLE, CELL_SAMPLE, WAVE = 20_000, 64, 4
FOUND = "query_id bigint, vec_id bigint, score double"


def chi_square_tail(x: np.ndarray, m: int) -> np.ndarray:
    """P(chi-square of m degrees > x), for even m."""
    h = np.minimum(x / 2, 700)
    return np.exp(-h) * sum(h**i / factorial(i) for i in range(m // 2))


def stop_ratio(m: int, miss: float) -> float:
    """The smallest x with P(chi-square > x) <= miss."""
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        tail = exp(-mid / 2) * sum((mid / 2) ** i / factorial(i) for i in range(m // 2))
        lo, hi = (mid, hi) if tail > miss else (lo, mid)
    return hi


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Median splits along the widest dimension, down to leaves of ``leaf`` points."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            out.append(own)
            continue
        p = points[own]
        axis = int(np.argmax(p.max(0) - p.min(0)))
        half = len(own) // 2
        order = np.argpartition(p[:, axis], half)
        todo += [own[order[:half]], own[order[half:]]]
    return out


class Cells:
    """The upper level: median splits of a sample's projections, as (axis, border) of the inner nodes
    of a complete tree."""

    def __init__(self, projected: np.ndarray, cells: int):
        self.depth = max(0, int(np.ceil(np.log2(max(cells, 1)))))
        self.axis, self.border = np.zeros(2**self.depth, np.int64), np.zeros(2**self.depth)
        level = {1: np.arange(len(projected))}
        for _ in range(self.depth):
            below = {}
            for node, own in level.items():
                p = projected[own]
                if len(own):
                    self.axis[node] = int(np.argmax(p.max(0) - p.min(0)))
                    self.border[node] = np.median(p[:, self.axis[node]])
                right = p[:, self.axis[node]] > self.border[node]
                below[2 * node], below[2 * node + 1] = own[~right], own[right]
            level = below

    def of(self, projected: np.ndarray) -> np.ndarray:
        node = np.ones(len(projected), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (projected[np.arange(len(node)), self.axis[node]] > self.border[node])
        return node - 2**self.depth


def apart(projected: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points from boxes: (points, boxes)."""
    out = np.zeros((len(projected), len(low)))
    for j in range(projected.shape[1]):
        y = projected[:, j : j + 1]
        out += np.maximum(np.maximum(low[:, j] - y, y - high[:, j]), 0) ** 2
    return out


def in_order(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def projection(dims: int, m: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims + 1, m))


def project(vectors: np.ndarray, top_norm: float, gauss: np.ndarray) -> np.ndarray:
    """Projections of vectors with the coordinate that brings all to one norm."""
    wide = np.sqrt(np.maximum(top_norm**2 - (vectors**2).sum(1), 0))
    return np.column_stack([vectors, wide]) @ gauss


def search_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, top_norm: float, k: int = K, m: int = M_DIMS, miss: float = MISS, leaf: int = LEAF, seed: int = SEED, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_ids, ids, scores): the k nearest found in the unit for each query, not ordered. What is
    under a query's ``floor``, its k-th best so far, isn't looked for."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    points, inverse = np.unique(vectors, axis=0, return_inverse=True)
    by_point = np.argsort(inverse, kind="stable")  # ids ascend within a point
    ends = np.cumsum(np.bincount(inverse, minlength=len(points)))
    gauss = projection(vectors.shape[1], m, seed)
    projected, q_projected = project(points, top_norm, gauss), queries @ gauss[:-1]
    leaves = kd_leaves(projected, leaf)
    gaps = apart(q_projected, np.array([projected[x].min(0) for x in leaves]), np.array([projected[x].max(0) for x in leaves]))
    visits = np.argsort(gaps, axis=1, kind="stable")
    least = by_point[ends - np.bincount(inverse, minlength=len(points))]  # in the order of ids
    keep = k + 1  # with the query's own point
    best, who = np.full((len(queries), keep), -np.inf), np.full((len(queries), keep), -1)
    bar = np.full(len(queries), -np.inf) if floor is None else floor
    base, ratio = (queries**2).sum(1) + top_norm**2, stop_ratio(m, miss)
    active = np.arange(len(queries))
    for t in range(len(leaves)):
        here = visits[active, t]
        kth = np.maximum(best[active].min(1), bar[active])
        far = np.maximum(base[active] - 2 * np.where(np.isfinite(kth), kth, 0), 0)
        going = ~np.isfinite(kth) | (gaps[active, here] < ratio * far)
        active, here, kth = active[going], here[going], kth[going]
        if not len(active):
            break
        by_leaf = np.argsort(here, kind="stable")
        cut = np.flatnonzero(np.r_[True, here[by_leaf][1:] != here[by_leaf][:-1]])
        for own in np.split(by_leaf, cut[1:]):
            asking, points_here = active[own], leaves[here[own[0]]]
            # what rounding could have kept from the best is looked at too; the exact score decides
            q, p = np.nonzero(queries[asking] @ points[points_here].T >= (kth[own] - 1e-9 * (1 + np.abs(np.where(np.isfinite(kth[own]), kth[own], 0))))[:, None])
            if not len(q):
                continue
            got = np.full((len(asking), len(points_here)), -np.inf)
            got[q, p] = in_order(queries[asking[q]], points[points_here[p]])
            some = np.unique(q)
            all_best = np.hstack([best[asking[some]], got[some]])
            all_who = np.hstack([who[asking[some]], np.broadcast_to(points_here, (len(some), len(points_here)))])
            top = np.lexsort((least[all_who], -all_best), axis=1)[:, :keep]
            best[asking[some]], who[asking[some]] = np.take_along_axis(all_best, top, 1), np.take_along_axis(all_who, top, 1)
    who[~np.isfinite(best)] = -1
    qs, xs = np.nonzero(who >= 0)
    found = who[qs, xs]
    scores = in_order(queries[qs], points[found])
    # spread each point to its ids, the k + 1 smallest of them
    begins = np.concatenate([[0], ends[:-1]])[found]
    sizes = np.minimum(ends[found] - begins, k + 1)
    row = np.repeat(np.arange(len(found)), sizes)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out_q, out_i, out_s = query_ids[qs[row]], ids[by_point[begins[row] + nth]], scores[row]
    other = out_q != out_i
    out_q, out_i, out_s = out_q[other], out_i[other], out_s[other]
    order = np.lexsort((out_i, -out_s, out_q))
    out_q, out_i, out_s = out_q[order], out_i[order], out_s[order]
    first = np.searchsorted(out_q, out_q, side="left")
    few = np.arange(len(out_q)) - first < k
    return out_q[few], out_i[few], out_s[few]


def usable(v: Column) -> Column:
    inf = float("inf")
    sound = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (x.cast("double") > -inf) & (x.cast("double") < inf), F.lit(False)))
    return v.isNotNull() & sound & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(at)
    if len(sizes) and (sizes == dims).all():
        return flat[at[0] : at[-1]].reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def nearest(table: DataFrame, is_query: Column, k: int = K, miss: float = MISS, vec_id: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, m: int = M_DIMS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``table`` for which ``is_query`` holds."""
    scratch = Scratch(table.sparkSession, "neighbours")
    sound = table.where(usable(F.col(vector))).select(F.col(vec_id).cast("bigint").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), is_query.alias("asks"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, top, dims = sound.agg(F.count("*"), F.sqrt(F.max(square)), F.max(F.size("v"))).first()
    if not n:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    gauss, ratio = projection(dims, m), stop_ratio(m, miss)
    # the upper level: fitted on the rows of the smallest hashes, a bounded sample
    cells = min(-(-n // block_rows), max(1, min(n, sample) // CELL_SAMPLE))
    held = np.zeros((0, m))
    if cells > 1:
        share = sound.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < 2_000_000 * sample // n) if n > sample else sound
        held = project(_matrix(share.select("v").limit(sample).toArrow().column("v"), dims), top, gauss)
    tree = Cells(held, cells if len(held) else 1)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = project(_matrix(batch.column("v"), dims), top, gauss)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.of(p).astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(p.reshape(-1)), m).cast(pa.list_(pa.float64()))], names=["id", "v", "asks", "cell", "p"])

    rows = scratch.save(sound.mapInArrow(dealt, "id bigint, v array<double>, asks boolean, cell int, p array<double>"))
    box = [f(F.get("p", j)).alias(f"{name}{j}") for name, f in (("low", F.min), ("high", F.max)) for j in range(m)]
    boxes = rows.groupBy("cell").agg(F.count("*").alias("n"), *box).orderBy("cell").collect()  # a row a cell, at most sample / CELL_SAMPLE
    low, high = (np.array([[r[f"{name}{j}"] for j in range(m)] for r in boxes]) for name in ("low", "high"))
    numbers = np.array([r["cell"] for r in boxes], np.int32)
    units = table.sparkSession.createDataFrame([(r["cell"], -(-r["n"] // block_rows)) for r in boxes], "cell int, units int")
    rows = rows.join(F.broadcast(units), "cell").withColumn("unit", F.pmod(F.xxhash64("id"), F.col("units")).cast("int"))
    queries = rows.where("asks").select("id", "v")

    def route(first: int, last: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = _matrix(batch.column("v"), dims)
                floor = batch.column("floor").to_numpy(zero_copy_only=False)
                gaps = apart(q @ gauss[:-1], low, high)
                turn = np.argsort(gaps, axis=1, kind="stable")[:, first:last]
                far = np.maximum((q**2).sum(1) + top**2 - 2 * np.where(np.isfinite(floor), floor, 0), 0)
                goes = ~np.isfinite(floor)[:, None] | (np.take_along_axis(gaps, turn, 1) < ratio * far[:, None])
                i, j = np.nonzero(goes)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(i)), batch.column("v").take(pa.array(i)), pa.array(floor[i]), pa.array(numbers[turn[i, j]])], names=["id", "v", "floor", "cell"])

        return run

    def search(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        got = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if vectors.num_rows and asked.num_rows:
            got = search_block(_matrix(vectors.column("v"), dims), vectors.column("id").to_numpy(), _matrix(asked.column("v"), dims), asked.column("id").to_numpy(), top, k, m, miss, floor=asked.column("floor").to_numpy())
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, got), strict=True)))

    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    found, first = None, 0
    while first < len(numbers):
        last = 1 if not first else first + WAVE if first == 1 else None
        floors = F.lit(float("-inf"))
        asking = queries
        if found is not None:
            worst = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
            asking = queries.join(worst, F.col("id") == F.col("query_id"), "left")
            floors = F.coalesce("kth", F.lit(float("-inf")))
        sent = scratch.save(asking.select("id", "v", floors.alias("floor")).mapInArrow(route(first, last), "id bigint, v array<double>, floor double, cell int"))
        per = sent.groupBy("cell").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("groups"))
        left = rows.join(F.broadcast(per), "cell").withColumn("group", every("groups")).select("cell", "unit", "group", "id", "v")
        right = sent.join(F.broadcast(per), "cell").join(F.broadcast(units), "cell").withColumn("group", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int")).withColumn("unit", every("units"))
        right = right.select(F.col("cell").alias("c"), F.col("unit").alias("u"), F.col("group").alias("g"), "id", "v", "floor")
        more = left.groupBy("cell", "unit", "group").cogroup(right.groupBy("c", "u", "g")).applyInArrow(search, FOUND)
        found = scratch.save(best(more if found is None else found.drop("rank").union(more)))
        first = last or len(numbers)
    return found.select("query_id", "rank", "vec_id", "score")
