"""MinHash signatures, bands, posterior bounds, and the exact resolution of candidate families.

Used by near-duplicate documents (word shingles) and lines (character shingles). The items are
distinct sets; what equals is collapsed before. The steps:

1. ``band_edges``: items that share a band are tied to the least item of that bucket, so a
   bucket of n items gives n - 1 rows and never its pairs;
2. ``families``: connected components of these ties. Every pair of items that shares a band is
   in one family; a family holds no more than candidates;
3. ``resolve``: families are dealt to blocks of bounded size. In a block, candidate pairs are
   compared on batches of their signatures, dropped once the posterior probability of being
   similar is under ``miss``, and verified exactly on their full sets, the likeliest first; a
   pair whose items are known to be connected needs no test. Families of more than one block go
   on: each block names the item that is likest to the others, these hubs meet in blocks again
   until a family's are one block, and then all items of the family, block by block, so that a
   group of copies becomes one component. Where few are left outside a family's largest
   component, they meet its blocks. Where many are, as in a family that mere candidates hold
   together, only band buckets that hold items of two components matter, and pairs that share
   one: each such bucket is a group of its own, in which the items outside its largest component
   meet the others in blocks. A pair is tested in the first bucket that it shares.

So no candidate pair of different components stays untested. What is sent is at most a row for
each band of an item, and in a bucket of more than one block its outsiders once a block.

Only links that connect something new are given out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import Scratch, components, mix

BATCH, BLOCK = 32, 64
#: Items from which on a group names a hub; smaller ones are families of their own nearly always.
HUB_ITEMS = 8
#: Items that are held before their groups are compared, and pairs compared at once.
HELD, PAIRS = 1024, 1 << 15
#: Candidate pairs verified in one step: at first, as the likeliest connect most; and at most.
VERIFIED = 128, 1024
#: Items of a group where outsiders meet a family or bucket; and the rows an item that a family's
#: outsiders may cost when they meet all of it, about what the bands of an item cost at least.
WIDE, ROWS_AN_ITEM = 8 * BLOCK, 32
#: Band keys that a task holds at once, and those of a part.
MERGE, PART = 3_000_000, 1_000_000
EDGES = "a bigint, b bigint"
#: From texts to (concatenated sorted shingle hashes, begins).
Sets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def multipliers(n: int) -> np.ndarray:
    return (np.random.default_rng(20260103).integers(0, 2**31, n, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def signatures(hashes: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    """(sets, n) minimum hashes; an empty set has the largest value throughout."""
    sizes = np.diff(begins)
    some = np.flatnonzero(sizes)
    out = np.full((len(sizes), n), 2**32 - 1, np.uint32)
    if len(some):
        low, at = (hashes >> np.uint64(32)).astype(np.uint32), begins[:-1][some]
        buffer = np.empty_like(low)
        with np.errstate(over="ignore"):
            for k, m in enumerate(multipliers(n)):
                np.multiply(low, m, out=buffer)
                out[some, k] = np.minimum.reduceat(buffer, at)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) 64-bit keys, different between bands."""
    bands = signature.shape[1] // rows
    out = np.zeros((len(signature), bands), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + signature[:, r : bands * rows : rows].astype(np.uint64) + np.uint64(1))
        return mix(out + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def least_matches(n: int, threshold: float, miss: float) -> list[int]:
    """For 0..n hashes compared: the fewest matches for which P(similarity >= threshold) is
    ``miss`` or more, with a uniform prior; that posterior is a binomial tail."""
    out = []
    for seen in range(n + 1):
        total, k = 0.0, -1
        while k < seen and total < miss:
            k += 1
            total += comb(seen + 1, k) * threshold**k * (1 - threshold) ** (seen + 1 - k)
        out.append(max(k, 0))
    return out


def _least_of_buckets(bands: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets with the least node of each, and ties (node, least) of the others as rows."""
    if not len(bands):
        return bands, nodes, np.zeros((0, 2), np.int64)
    order = np.argsort(bands)
    bands, nodes = bands[order], nodes[order]
    first = np.flatnonzero(np.r_[True, bands[1:] != bands[:-1]])
    least = np.minimum.reduceat(nodes, first)
    of_each = np.repeat(least, np.diff(np.append(first, len(nodes))))
    other = nodes != of_each
    return bands[first], least, np.column_stack([nodes[other], of_each[other]])


def band_edges(items: DataFrame, parts: int) -> DataFrame:
    """From items(node, bands): a distinct tie (a, b) of each node to the least of each bucket.

    A task ties what meets in it and sends on the least node of each of its buckets only, so a
    bucket that a third of all items share arrives as a row from each task. Keys are dealt into
    ``parts`` by their value and travel as packed pairs of numbers, 16 bytes each."""

    def rows(part: np.ndarray, is_tie: bool, pairs: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(part, kind="stable")
        part, pairs = part[order], np.ascontiguousarray(pairs[order])
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ends = np.append(cut, len(part)).astype(np.int32) * 16
        return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array(np.full(len(cut), is_tie)), pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends), pa.py_buffer(pairs)])], names=["part", "tie", "pairs"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, nodes, held = [], [], 0

        def flush():
            keys, least, ties = _least_of_buckets(np.concatenate(bands), np.concatenate(nodes))
            if len(keys):
                yield rows((keys.view(np.uint64) % np.uint64(parts)).astype(np.int64), False, np.column_stack([keys, least]))
            if len(ties):
                ties = ties[np.lexsort((ties[:, 1], ties[:, 0]))]
                ties = ties[np.r_[True, (ties[1:] != ties[:-1]).any(1)]]
                yield rows((ties[:, 0].view(np.uint64) % np.uint64(parts)).astype(np.int64), True, ties)

        for batch in batches:
            column = batch.column(1)
            at, flat = column.offsets.to_numpy(), column.values.to_numpy()
            nodes.append(np.repeat(batch.column(0).to_numpy(), np.diff(at)))
            bands.append(flat[at[0] : at[-1]])
            held += len(nodes[-1])
            if held >= MERGE:
                yield from flush()
                bands, nodes, held = [], [], 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out(ties: np.ndarray):
            return pa.RecordBatch.from_arrays([pa.array(ties[:, 0]), pa.array(ties[:, 1])], names=["a", "b"])

        def closed():
            pairs = np.concatenate(held)
            return out(_least_of_buckets(pairs[:, 0], pairs[:, 1])[2])

        for batch in batches:
            for part, tie, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                got = np.frombuffer(pairs.as_buffer(), np.int64).reshape(-1, 2)
                if tie:
                    yield out(got)
                    continue
                if part != now:
                    if held:
                        yield closed()
                    now, held = part, []
                held.append(got)
        if held:
            yield closed()

    sent = items.select("node", "bands").mapInArrow(send, "part int, tie boolean, pairs binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(meet, EDGES).distinct()


class Block:
    """Items in memory, group after group: their sets and signatures."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.labels: list[int] = []
        self.sides: list[int] = []
        self.sets: list[np.ndarray] = []
        self.signs: list[np.ndarray] = []
        self.bands: list[np.ndarray] = []
        self.begins: list[int] = []
        self.ids: np.ndarray | None = None

    def pairs(self, band: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places in one group, some at a time. Items of side 1 meet those of side 0; where no
        item of a group is of side 1, all meet. Groups of a size are paired in one step."""
        begins, side = np.array(self.begins), np.array(self.sides)
        sizes = np.diff(np.append(begins, len(side)))
        two = np.add.reduceat(side, begins) > 0
        for b, n in zip(begins[two].tolist(), sizes[two].tolist(), strict=True):
            own = side[b : b + n]
            left, right = b + np.flatnonzero(own == 1), b + np.flatnonzero(own == 0)
            yield np.repeat(left, len(right)), np.tile(right, len(left))
        for n in np.unique(sizes[~two & (sizes > 1)]).tolist():
            i, j = np.triu_indices(n, 1)
            of = begins[~two & (sizes == n)]
            step = max(1, PAIRS // len(i))
            for x in range(0, len(of), step):
                yield (of[x : x + step, None] + i).reshape(-1), (of[x : x + step, None] + j).reshape(-1)

    def candidates(self, band: int) -> tuple[np.ndarray, np.ndarray]:
        """Those that share a band, or share ``band`` as their first, and aren't known to be connected."""
        bands, labels = np.array(self.bands), np.array(self.labels)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i, j in self.pairs(band):
            apart = labels[i] != labels[j]
            i, j = i[apart], j[apart]
            if band < 0:
                stay = (bands[i] == bands[j]).any(1)
            else:
                stay = (bands[i, band] == bands[j, band]) & ~(bands[i, :band] == bands[j, :band]).any(1)
            out.append((i[stay], j[stay]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def verified(self, i: np.ndarray, j: np.ndarray, similar: Callable) -> np.ndarray:
        """Which pairs are similar, by their full sets: what a pair's sets have in common is counted
        in one merge of all pairs' numbered hashes."""
        if self.ids is None:
            self.sizes = np.array([len(x) for x in self.sets])
            self.at = np.cumsum(self.sizes) - self.sizes
            values, ids = np.unique(np.concatenate(self.sets), return_inverse=True)
            self.ids, self.kinds = ids, len(values)
        out = similar(np.minimum(self.sizes[i], self.sizes[j]), self.sizes[i], self.sizes[j])
        pair = np.flatnonzero(out)

        if not len(pair):
            return out
        n, m = self.sizes[i[pair]], self.sizes[j[pair]]
        kind = np.int32 if len(pair) * self.kinds < 2**31 else np.int64

        def keys(side: np.ndarray, n: np.ndarray) -> np.ndarray:
            ends = np.cumsum(n)
            here = np.arange(ends[-1]) + np.repeat(self.at[side] - ends + n, n)
            return self.ids[here].astype(kind) + np.repeat(np.arange(len(n), dtype=kind) * kind(self.kinds), n)

        both = np.concatenate([keys(i[pair], n), keys(j[pair], m)])  # two ordered runs, which a merge sort finds
        both.sort(kind="stable")
        common = np.add.reduceat(np.r_[both[1:] == both[:-1], False], np.cumsum(n + m) - n - m, dtype=np.int64)
        out[pair] = similar(common, n, m)
        return out

    def links(self, band: int, least: list[int], similar: Callable) -> list[tuple[int, int]]:
        """Verified links between items not known to be connected; and, of a group of HUB_ITEMS or
        more, the item that agrees most with its candidates, as a link to itself."""
        i, j = self.candidates(band)
        sign = np.array(self.signs)
        same = np.zeros(len(i), np.int64)
        for t in range(0, sign.shape[1], BATCH):
            same += (sign[i, t : t + BATCH] == sign[j, t : t + BATCH]).sum(1)
            stay = same >= least[min(t + BATCH, sign.shape[1])]
            i, j, same = i[stay], j[stay], same[stay]
        agreed = np.bincount(np.r_[i, j], np.r_[same, same], len(self.nodes))
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out, done, step = [], 0, VERIFIED[0]
        order = np.argsort(-same, kind="stable")
        while done < len(order):
            some, done = order[done : done + step], done + step
            step = min(2 * step, VERIFIED[1])
            apart = [find(self.labels[x]) != find(self.labels[y]) for x, y in zip(i[some].tolist(), j[some].tolist(), strict=True)]
            some = some[apart]
            some = some[self.verified(i[some], j[some], similar)]
            for x, y in zip(i[some].tolist(), j[some].tolist(), strict=True):
                p, q = find(self.labels[x]), find(self.labels[y])
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((self.nodes[x], self.nodes[y]))
        for b, e in zip(self.begins, [*self.begins[1:], len(self.nodes)], strict=True):
            if e - b >= HUB_ITEMS and agreed[b:e].any():
                out.append((self.nodes[b + int(agreed[b:e].argmax())],) * 2)
        return out


GROUP = ["group", "rest", "block"]


def _blocks(rows: DataFrame, sets: Sets, n_hashes: int, band_rows: int, least: list[int], similar) -> DataFrame:
    """Links within each group of rows(GROUP, band, node, label, side, text); groups are bounded.
    ``band`` is that of a bucket, or -1 for a group of any candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of, block = None, -1, Block()  # groups of one band, or of none, are taken together

        def out(links):
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            hashes, begins = sets(batch.column("text"))
            signs = signatures(hashes, begins, n_hashes)
            bands = band_keys(signs, band_rows)
            group = list(zip(*(batch.column(k).to_pylist() for k in GROUP), strict=True))
            columns = [batch.column(c).to_pylist() for c in ("band", "node", "label", "side")]
            for x, (key, band, node, label, side) in enumerate(zip(group, *columns, strict=True)):
                if key != now:
                    if len(block.nodes) >= HELD or band != of and block.nodes:
                        yield out(block.links(of, least, similar))
                        block = Block()
                    now, of = key, band
                    block.begins.append(len(block.nodes))
                block.nodes.append(node)
                block.labels.append(label)
                block.sides.append(side)
                block.sets.append(hashes[begins[x] : begins[x + 1]])
                block.signs.append(signs[x])
                block.bands.append(bands[x])
        if block.nodes:
            yield out(block.links(of, least, similar))

    return rows.select(*GROUP, "band", "node", "label", "side", "text").repartition(*GROUP).sortWithinPartitions(*GROUP, "node").mapInArrow(run, EDGES)


def _buckets(items: DataFrame, sets: Sets, n_hashes: int, band_rows: int) -> DataFrame:
    """(key, band, node, label): a row for each band of items(node, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(signatures(*sets(batch.column("text")), n_hashes), band_rows)
            n = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(keys))), *(pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in ("node", "label"))], names=["key", "band", "node", "label"])

    return items.select("node", "label", "text").mapInArrow(run, "key bigint, band int, node bigint, label bigint")


def resolve(scratch: Scratch, members: DataFrame, sets: Sets, n_hashes: int, band_rows: int, threshold_percent: int, miss: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all that is similar, from members(family, node, text), a written
    table with a row for each item of each family."""
    least = least_matches(n_hashes, threshold_percent / 100, miss)

    def similar(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * common >= threshold_percent * (a + b - common)

    def verified(rows: DataFrame) -> DataFrame:
        return scratch.save(_blocks(rows, sets, n_hashes, band_rows, least, similar))

    def dealt(m: Column, seed: int = 0) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(seed)), m).cast("int")

    wide = WIDE * block // BLOCK

    def parts(n: Column, size: int = block) -> Column:
        return F.greatest(F.lit(1), F.ceil(n / size)).cast("int")

    plain = {"group": F.col("family"), "rest": F.lit(0), "band": F.lit(-1), "side": F.lit(0)}
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [*GROUP, "band", "node", "label", "side"]
    sizes = members.groupBy("family").agg(F.count("*").alias("n"))
    one = members.join(sizes, "family").withColumn("blocks", parts(F.col("n"))).withColumn("block", dealt(F.col("blocks")))
    found = verified(one.withColumns(plain | {"label": F.col("node")}))
    large = scratch.save(sizes.where(F.col("n") > block))
    if large.isEmpty():
        return found.where("a <> b")
    own = scratch.save(one.join(large.select("family"), "family", "left_semi"))

    def labelled(links: DataFrame) -> DataFrame:
        roots = components(scratch, links).withColumnRenamed("root", "label")
        return own.join(roots, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def hubs_of(items: DataFrame, links: DataFrame) -> DataFrame:
        return scratch.save(items.join(links.where("a = b").select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("family", "node", "blocks", "text"))

    # hubs meet in blocks until a family's are one block, which then meets the whole family
    hubs = hubs_of(own, found)
    while True:
        per = hubs.groupBy("family").agg(F.count("*").alias("n"))
        most = per.agg(F.max("n")).first()[0] or 0
        if not most:
            break
        met = hubs.join(per, "family").withColumn("block", dealt(parts(F.col("n")), 1))
        more = verified(met.withColumns(plain | {"label": F.col("node")}))
        found = found.union(more)
        if most <= block:
            break
        hubs = hubs_of(met, more)
    if most:
        now = labelled(found)
        roots = now.select("node", "label")
        asked = hubs.withColumn("block", every("blocks")).withColumns(plain | {"side": F.lit(1)}).join(roots, "node")
        found = found.union(verified(now.withColumns(plain).select(*columns, "text").union(asked.select(*columns, "text"))))
    own = scratch.save(labelled(found).select("family", "node", "label", "text"))
    main = own.groupBy("family", "label").agg(F.count("*").alias("k")).groupBy("family").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("n"), F.max("k").alias("k"))
    main = main.where("n > k").withColumns({"rests": parts(F.col("n") - F.col("k"), wide), "blocks": parts(F.col("n"), wide)})
    main = scratch.save(main.withColumn("few", F.col("n") * F.col("rests") + (F.col("n") - F.col("k")) * F.col("blocks") <= ROWS_AN_ITEM * F.col("n")).drop("n", "k"))
    # few outside the bulk of a family: they meet all of it
    bulk = own.join(main.where("few"), "family").withColumns(plain)
    sent = bulk.where("label <> main").withColumns({"rest": dealt(F.col("rests"), 2), "side": F.lit(1), "block": every("blocks")})
    stay = bulk.withColumns({"block": dealt(F.col("blocks")), "rest": every("rests")})
    found = found.union(verified(sent.select(*columns, "text").union(stay.select(*columns, "text"))))
    if main.where("NOT few").isEmpty():
        return found.where("a <> b")
    # many: buckets of more than one component
    own = scratch.save(own.join(main.where("NOT few").select("family"), "family", "left_semi").select("node", "label", "text"))
    buckets = scratch.save(_buckets(own, sets, n_hashes, band_rows))
    mixed = scratch.save(buckets.groupBy("key", "label").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("n"), F.count("*").alias("labels"), F.max_by("label", F.struct("k", "label")).alias("main")).where("labels > 1").drop("labels"))
    if mixed.isEmpty():
        return found.where("a <> b")
    entries = buckets.join(mixed, "key")
    small = entries.where(F.col("n") <= wide).select(F.col("key").alias("group"), F.lit(0).alias("rest"), F.lit(0).alias("block"), "band", "node", "label", F.lit(0).alias("side"))
    hot = scratch.save(entries.where(F.col("n") > wide))
    outside = hot.where("label <> main")
    counts = outside.groupBy("key").agg(parts(F.count("*"), wide).alias("rests"))
    dealt_out = hot.join(counts, "key").withColumn("blocks", parts(F.col("n"), wide))
    sent = dealt_out.where("label <> main").withColumns({"rest": dealt(F.col("rests"), 2), "side": F.lit(1)}).withColumn("block", every("blocks"))
    stay = dealt_out.withColumns({"block": dealt(F.col("blocks")), "side": F.lit(0)}).withColumn("rest", every("rests"))
    keyed = [F.col("key").alias("group"), *columns[1:]]
    rows = small.union(sent.select(keyed)).union(stay.select(keyed))
    return found.union(verified(rows.join(own.select("node", "text"), "node"))).where("a <> b")


def families(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, family) of each node that shares a bucket with another."""
    return components(scratch, edges).withColumnRenamed("root", "family")
