"""Best-fit packing: documents into sequences of at most ``capacity`` tokens.

The pieces to pack are known to the plan only by the histogram of their lengths, 1,024 numbers
whatever the size of the corpus. On it the configuration linear program (a configuration is a
multiset of lengths that fit one sequence; use as few sequences as cover every length's count)
is solved by multiplicative weights. A length's price is its tokens times a weight that falls
exponentially with the share of its pieces that is covered (that is, weights that start in
proportion to the tokens of a length, over its count). Each round prices lengths, finds the best
filling of every capacity for these prices and some perturbed ones by knapsack dynamic
programming, and raises the use of the best configurations that hold the lengths that lag. It
ends when all pieces are covered; the prices are a dual solution as well, so each round gives a
lower bound, and the gap between the use and the best bound is known (``GAP`` is aimed at, with
smaller steps where it is missed; the smallest tables have less to choose from). The uses of
configurations that fill a sequence are rounded down, then raised by one in the order of what was
cut off while pieces last; the rest of the pieces goes by best fit, by falling length.

Pieces are then given their place without moving texts or ids: each is numbered within its
length (numbered within a salt, plus the counts of the salts before, so that a length that a
third of all pieces have is no hot key), and number and length decide sequence and offset.

A longer document is cut into pieces of ``capacity`` from its end on; the first may be shorter.

Defined results: null text is empty and is packed as its end mark alone; repeated rows are
packed each; an empty table gives no rows; columns other than the id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.common import BATCH_ROWS, SENT_BYTES, Scratch, batch_rows
from glossmill.llm.tokens import encode_json, vocabulary_path

CAPACITY, END_ID, ROWS_A_SALT = 1024, 2, 20_000
#: Of the linear program: how far above the bound its use may be, the shares of a length that a round
#: covers at most, the fall of weights with the covered share, the spread of perturbed prices, how
#: many of these a round has, and how many lagging lengths each serves.
GAP, STEPS, FALL, SPREAD, PRICES, LAGGING, SEED = 0.01, (0.25, 0.1, 0.05), 4.0, 0.02, 8, 64, 20260104
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenize_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, ranks: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32 (and ids, if asked for)."""
    path, rank_path = vocabulary or vocabulary_path("byte_bpe_50k.json"), ranks or vocabulary_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held: list[np.ndarray] = []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode_json(path, rank_path, content or ""), end_id], "<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k in range(len(cuts) - 1):
                    own = ids[cuts[k] : cuts[k + 1]]
                    out.append((doc, k, cuts[k], len(own), zlib.crc32(own.tobytes())))
                    if with_ids:
                        held.append(own.view("<i4"))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(held, pa.list_(pa.int32()))] if with_ids else [])], names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


# ---------------------------------------------------------------- the plan, from the histogram


def fillings(worth: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack for each row of ``worth``: (capacity + 1, rows) the largest worth within a
    capacity, and the length taken last, or -1 where a token is left free."""
    rows = np.arange(len(worth))
    best, pick = np.zeros((capacity + 1, len(worth))), np.full((capacity + 1, len(worth)), -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    worth = np.ascontiguousarray(worth.T)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = fits[c]
        if k:
            got = best[c - lengths[:k]] + worth[:k]
            j = got.argmax(0)
            more = got[j, rows] > best[c]
            best[c] = np.where(more, got[j, rows], best[c])
            pick[c] = np.where(more, j, -1)
    return best, pick


def filling(pick: np.ndarray, lengths: list[int], capacity: int) -> dict[int, int]:
    """The configuration (index of length -> copies) behind one row's best worth."""
    out: dict[int, int] = {}
    while capacity > 0:
        j = int(pick[capacity])
        if j < 0:
            capacity -= 1
        else:
            out[j] = out.get(j, 0) + 1
            capacity -= lengths[j]
    return out


Uses = dict[tuple[tuple[int, int], ...], float]


def cover(lengths: np.ndarray, counts: np.ndarray, capacity: int, step: float) -> tuple[Uses, float]:
    """A fractional cover of all pieces, configurations (index of length, copies) with their use; and
    a lower bound on the use of any cover."""
    rng = np.random.default_rng(SEED)
    n, sizes, done = counts.astype(float), [int(x) for x in lengths], 1 - 1e-6
    covered, use, bound = np.zeros(len(n)), {}, 0.0
    while covered.min() < done:
        price = np.where(covered < done, lengths * np.exp(-FALL * (covered - covered.min())), 0.0)
        worth = price * np.exp(SPREAD * rng.standard_normal((PRICES, len(n))))
        worth[0] = price
        best, pick = fillings(worth, lengths, capacity)
        bound = max(bound, float(n @ price) / best[capacity, 0])  # prices over the best worth are feasible in the dual
        grown = np.zeros(len(n))
        lag = np.flatnonzero(covered < done)
        for x, j in enumerate(lag[np.argsort(covered[lag] - step * rng.random(len(lag)))][: PRICES * LAGGING].tolist()):
            config = filling(pick[:, x % PRICES], sizes, capacity - sizes[j])
            config[j] = config.get(j, 0) + 1
            raised = min((min(step, 1 - covered[k]) - grown[k]) * n[k] / a for k, a in config.items())
            if raised > 0:
                key = tuple(sorted(config.items()))
                use[key] = use.get(key, 0.0) + raised
                for k, a in config.items():
                    grown[k] += a * raised / n[k]
        covered += grown
    least = float(covered.min())
    return {key: x / least for key, x in use.items()}, bound


def better_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int, step: float = 0.02, rounds: int = 300) -> float:
    """The best bound of prices that follow the best configuration alone, with no length left out."""
    covered, bound = np.zeros(len(lengths)), 0.0
    for _ in range(rounds):
        price = lengths * np.exp(-FALL * (covered - covered.min()))
        best, pick = fillings(price[None], lengths, capacity)
        bound = max(bound, float(counts @ price) / best[capacity, 0])
        config = filling(pick[:, 0], lengths.tolist(), capacity)
        raised = step * min(counts[k] / a for k, a in config.items())
        for k, a in config.items():
            covered[k] += a * raised / counts[k]
    return bound


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP) -> tuple[Uses, float]:
    """The best cover of several step sizes, until one is within ``gap`` of the bound; and the bound."""
    found, bound = None, 0.0
    for step in STEPS:
        use, least = cover(lengths, counts, capacity, step)
        bound = max(bound, least)
        if found is None or sum(use.values()) < sum(found.values()):
            found = use
        if sum(found.values()) > (1 + gap) * bound and step == STEPS[0]:
            bound = max(bound, better_bound(lengths, counts, capacity))
        if sum(found.values()) <= (1 + gap) * bound:
            break
    return found, bound


Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Plan:
    """Best fit by falling length on a histogram: each piece goes to the open sequence with the
    least room that takes it. Sequences alike are held as one entry with a count, so the work
    grows with the number of lengths, not of pieces."""
    room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}

    def put(left: int, config: tuple, times: int) -> None:
        if times:
            room.setdefault(left, []).append((config, times))

    for j in range(len(lengths) - 1, -1, -1):
        size, n = int(lengths[j]), int(counts[j])
        while n:
            left = min((r for r in room if r >= size), default=capacity)
            fit = left // size
            if left in room:
                config, have = room[left].pop()
                if not room[left]:
                    del room[left]
            else:
                config, have = (), -(-n // fit)
            full = min(have, n // fit)
            part = n - full * fit if full < have and n - full * fit < fit else 0
            put(left - fit * size, (*config, (size, fit)), full)
            if part:
                put(left - part * size, (*config, (size, part)), 1)
            put(left, config, have - full - (part > 0))
            n -= full * fit + part
    return [entry for entries in room.values() for entry in entries]


def rounded(use: Uses, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[Plan, np.ndarray]:
    """Whole uses of the configurations that fill a sequence, and the counts they leave."""
    full = [(key, x) for key, x in use.items() if sum(int(lengths[j]) * a for j, a in key) == capacity]
    out, left = [], counts.copy()

    def take(key: tuple, times: int) -> None:
        times = min(times, *(int(left[j] // a) for j, a in key))
        if times > 0:
            out.append((tuple((int(lengths[j]), a) for j, a in reversed(key)), times))
            for j, a in key:
                left[j] -= a * times

    for key, x in full:
        take(key, int(x))
    for key, _ in sorted(full, key=lambda f: -(f[1] % 1)):
        take(key, 1)
    return out, left


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """[(configuration as (length, copies) pairs, sequences)] that hold exactly the histogram: the
    rounded solution of the linear program, and best fit for what rounding leaves."""
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    whole: Plan = []
    if len(lengths) and lengths[-1] == capacity:  # such pieces fill a sequence each
        whole = [(((capacity, 1),), int(counts[-1]))]
        lengths, counts = lengths[:-1], counts[:-1]
    if not len(lengths):
        return whole
    use, _ = solve(lengths, counts, capacity)
    out, left = rounded(use, lengths, counts, capacity)
    some = left > 0
    return whole + out + best_fit(lengths[some], left[some], capacity)


PLACED = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_a_salt: int = ROWS_A_SALT) -> DataFrame:
    """Adds sequence_id and offset to pieces(doc_id, piece, start, length, ids_crc32, and maybe ids),
    which should be a written table: it is read twice."""
    names = PLACED + ["ids"] * ("ids" in pieces.columns)
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    entries: dict[int, list[tuple[int, int, int, int]]] = {}
    at, base = dict.fromkeys(histogram, 0), 0
    for config, times in plan(histogram, capacity):
        offset = 0
        for length, copies in config:
            entries.setdefault(length, []).append((at[length], copies, base, offset))
            at[length] += copies * times
            offset += length * copies
        base += times
    tables = {k: np.array(v, np.int64) for k, v in entries.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                t = tables[int(k)]
                e = t[np.searchsorted(t[:, 0], rank[own], side="right") - 1]
                r = rank[own] - e[:, 0]
                seq[own], off[own] = e[:, 2] + r // e[:, 1], e[:, 3] + r % e[:, 1] * k
            columns = dict(zip(names, map(batch.column, names), strict=True))
            own = columns.pop("ids", None)
            columns |= {"sequence_id": pa.array(seq), "offset": pa.array(off)} | ({} if own is None else {"ids": own})
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    salts = max(16, -(-max(histogram.values(), default=0) // rows_a_salt))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = counts.select("length", "__salt", (F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    # at most a row for each length and salt, so known in size; the pieces are shuffled once
    small = len(histogram) * salts * 32 <= SENT_BYTES
    ranked = salted.withColumn("__within", within).join(F.broadcast(before) if small else before, ["length", "__salt"])
    return ranked.select(*names, (F.col("__within") + F.col("__before")).cast("bigint").alias("__rank")).mapInArrow(place, PIECES + ", sequence_id bigint, offset bigint" + ", ids array<int>" * ("ids" in names))


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """A place in a sequence for each piece of docs; with its ids, if asked for."""
    scratch = Scratch(docs.sparkSession, "pack")
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        pieces = scratch.save(tokenize_pieces(docs, doc_id, text, vocabulary, capacity=capacity, with_ids=with_ids))
    return pack(pieces, capacity)
