"""Sharding: minimax contiguous partition of atomic groups under the law of equal bytes.

Native: DataFrame functions only; the driver computes on bounded summaries.

Equal texts are one atomic group. Groups are ordered by the 64-bit hash of their text
(a null text counts as an empty one) and cut into ``n_shards`` contiguous runs whose
largest size is as small as any such cut allows. The smallest feasible capacity is found
by binary search with a greedy check, over summaries rather than groups: the order is
summed in 65,536 ranges of the key, an optimistic check (ranges can be split) and a
pessimistic one (they can't) bound the capacity, and only ranges in which a boundary may
lie are looked at again 1,024 times finer, until each of those holds one group. So the
answer is exact while the driver sees at most 65,536 rows at first and then as many as
the few ranges around 40 boundaries yield. Under the capacity the cuts then stay as near
to equal sizes as they can, so that one huge group doesn't leave other shards empty.

Slots number each shard's rows from 0: rows are dealt to salts by their id and text, counted by
(shard, salt), and numbered within those, so that no task holds a whole shard, also where ids are
null or repeat.

Defined results: null text is 16 bytes with crc32 0; repeated rows get a slot each; with
fewer groups than shards the rest of the shards stay empty; an empty table gives no rows; other
columns take no part, whatever their names.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.common import Scratch

N_SHARDS, ROW_BYTES, ROWS_A_SLOT_GROUP = 40, 16, 20_000
FIRST_BITS, MORE_BITS = 16, 10


def _reach(ends: np.ndarray, splits: np.ndarray | None, start: int, capacity: int) -> int:
    """How far a shard that begins at byte ``start`` gets: a byte offset in the order."""
    i = int(np.searchsorted(ends, start + capacity, side="right"))
    if i == len(ends):
        return int(ends[-1])
    if splits is not None and splits[i]:
        return start + capacity
    return int(ends[i - 1]) if i else 0


def greedy(ends: np.ndarray, splits: np.ndarray | None, capacity: int, shards: int) -> list[int]:
    at = [0]
    for _ in range(shards):
        at.append(max(at[-1], _reach(ends, splits, at[-1], capacity)))
    return at


def smallest_capacity(ends: np.ndarray, splits: np.ndarray | None, least: int, shards: int) -> int:
    lo, hi = least, int(ends[-1])
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy(ends, splits, mid, shards)[-1] >= ends[-1]:
            hi = mid
        else:
            lo = mid + 1
    return lo


def balanced_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Ends (indices into the order, exclusive) of the shards: no shard over capacity, each as
    near to an equal share of what is left as the shards after it allow."""
    total, n = int(ends[-1]), len(ends)
    begin = np.concatenate([[0], ends[:-1]])
    must = [n]  # must[-1-k]: the first index from which the last k shards can take all
    for _ in range(shards):
        left = int(ends[must[-1] - 1]) - capacity if must[-1] else 0
        must.append(int(np.searchsorted(begin, left, side="left")))
    cuts, at = [], 0
    for k in range(shards):
        rest = shards - k
        done = int(ends[at - 1]) if at else 0
        most = int(np.searchsorted(ends, done + capacity, side="right"))
        want = done + (total - done) / rest
        j = int(np.searchsorted(ends, want, side="left"))
        if j < n and j > at and abs(int(ends[j - 1]) - want) <= abs(int(ends[j]) - want):
            j -= 1
        at = max(at, min(max(j + 1, must[rest - 1]), most))
        cuts.append(at)
    return cuts


def plan_cuts(groups: DataFrame, n_shards: int = N_SHARDS, first_bits: int = FIRST_BITS, more_bits: int = MORE_BITS) -> tuple[list[int], int, int]:
    """From groups(key, bytes, rows): the first keys of shards 1.., the capacity, and all rows."""

    def summed(part: DataFrame, bits: int) -> list:
        low = F.shiftleft(F.shiftright("key", 64 - bits), 64 - bits) if bits < 64 else F.col("key")
        return part.groupBy(low.alias("low")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("bytes").alias("top"), F.sum("rows").alias("rows")).collect()

    bits = first_bits
    # low key -> bytes, groups, bits of the range
    parts = {r["low"]: (r["bytes"], r["n"], bits, r["top"], r["rows"]) for r in summed(groups, bits)}
    if not parts:
        return [], 0, 0
    total, rows, top = sum(p[0] for p in parts.values()), sum(p[4] for p in parts.values()), max(p[3] for p in parts.values())
    least = max(top, -(-total // n_shards))
    while True:
        keys = sorted(parts)
        ends = np.cumsum([parts[k][0] for k in keys])
        many = np.array([parts[k][1] > 1 for k in keys])
        hi = smallest_capacity(ends, None, least, n_shards)
        lo = smallest_capacity(ends, many, least, n_shards)
        first, last = greedy(ends, None, lo, n_shards), greedy(ends, many, hi, n_shards)
        wide = set()
        for p, o in zip(first, last, strict=True):
            i, j = np.searchsorted(ends, p, side="right"), np.searchsorted(ends, o, side="right")
            wide.update(k for k in range(i, min(j, len(keys) - 1) + 1) if many[k])
        if not wide or lo == hi and hi == least:
            break
        finest = min(parts[keys[k]][2] for k in wide)
        wide = [keys[k] for k in wide if parts[keys[k]][2] == finest]
        bits = min(64, finest + more_bits)
        inside = F.shiftleft(F.shiftright("key", 64 - finest), 64 - finest).isin(wide)
        for k in wide:
            del parts[k]
        parts |= {r["low"]: (r["bytes"], r["n"] if bits < 64 else 1, bits, r["top"], r["rows"]) for r in summed(groups.where(inside), bits)}
    cuts = balanced_cuts(ends, hi, n_shards)
    return [keys[i] if i < len(keys) else None for i in cuts[:-1]], hi, rows


def _shard_of(key: Column, cuts: list[int | None]) -> Column:
    found = [F.when(key >= F.lit(c).cast("long"), F.lit(1)).otherwise(F.lit(0)) for c in cuts if c is not None]
    out = F.lit(0)
    for f in found:
        out = out + f
    return out


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, doc_id: str = "doc_id", text: str = "text", rows_a_slot_group: int = ROWS_A_SLOT_GROUP) -> DataFrame:
    """(doc_id, size, text_crc32, key, shard, slot) for each row of docs; other columns take no part."""
    scratch = Scratch(docs.sparkSession, "shard")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = scratch.save(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + ROW_BYTES).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("key")))
    groups = scratch.save(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    cuts, _, n = plan_cuts(groups, n_shards)
    scratch.drop(groups)
    salts = max(8, -(-n // (n_shards * rows_a_slot_group)))
    placed = rows.withColumns({"shard": _shard_of(F.col("key"), cuts), "__salt": F.pmod(F.xxhash64("doc_id", "key"), F.lit(salts)).cast("int")})
    # n_shards * salts rows: a number that the plan sets, so this side is small enough to send to all
    counts = placed.groupBy("shard", "__salt").agg(F.count("*").alias("__n"))
    before = counts.select("shard", "__salt", (F.sum("__n").over(Window.partitionBy("shard").orderBy("__salt")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("shard", "__salt").orderBy("doc_id", "text_crc32", "size"))
    numbered = placed.withColumn("__at", within - 1)
    return numbered.join(F.broadcast(before) if n_shards * salts <= 100_000 else before, ["shard", "__salt"]).select("doc_id", "size", "text_crc32", "key", "shard", (F.col("__before") + F.col("__at")).cast("long").alias("slot"))
