"""Substring dedup: passages that repeat across documents, found by collinear chaining.

Seeds are ``k``-word shingles, sampled by minimizers (of each ``w`` neighbouring shingles the one
of the smallest hash), so every shared run of k + w - 1 words shares a seed. Each seed of a
document is joined to the seed's first occurrence, in the document of the smallest id that has
it: one match a seed, never the pairs of a common passage. Where a run of ``min_words`` words may
be shared but its seeds were first seen in different places, the run itself is hashed and joined
to its own first occurrence in the same way; and where neighbouring seeds of a document have no
first document in common, each is joined to the document before that has it unsettled too, so an
edited passage is found whose parts stand in several smaller documents. The matches of two documents that
stand on one diagonal without a gap of ``max_gap`` words merge into segments; segments chain in
the order of both texts by the largest sum of lengths less gap costs, with prefix maxima from a
Fenwick tree, and chains part at wide gaps. Each chain is aligned on the words themselves: gaps
are closed word by word, both ends are extended while matches outweigh mismatches. What has
``min_words`` words and ``identity`` of equal words is a passage; it stays in the first document
and can go from the other. A chain of less identity is cut back to its longest parts that have it.

The first occurrence is pre-aggregated before the shuffle and the join back splits if skewed.
Of texts only those of documents with chains move, and of the first document only the stretch
that a chain lies in.

Defined results: null and empty texts and texts of fewer than k words have no passages; rows with
a null doc_id are left alone; rows that share a doc_id but not the text are documents of their
own, in the order of a hash of the text, and rows that are equal in both are one; repeats within
one document only are not removed, and a run of one word over and over is no passage (it has one
seed); documents whose ids aren't in 0 .. 2**36 - 1 are numbered first; an empty table gives no rows; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.common import SPACE_CLASS, RowIds, Scratch, batch_rows, chunks, mix, signed, small_enough, span_hashes, text_bytes, word_bounds, word_hashes

K, W, MIN_WORDS, IDENTITY, MAX_GAP, FLANK, DROP, GAP_COST, LEAST_SEED_WORDS = 6, 12, 50, 0.8, 32, 64, 8, 0.25, 8
#: A place is a document's number and, in the lower bits, a word's: of 2**36 documents and 2**27 words.
POS_BITS = 27
SEEDS = "seed bigint, doc_id bigint, pos int"
CHAINS = "doc_id bigint, source bigint, segments array<int>"
#: Holders of a seed among which a document before is looked for in one group.
HOLDERS = 1_000
PASSAGES = "doc_id bigint, begin int, n_words int, source_doc_id bigint, source_begin int, source_words int, matches int"
FINISHED = PASSAGES + ", seed bigint, goes_on array<int>"
#: Rows of a batch: of texts; of links, each with the text of a document; of numbers.
TEXTS, LINKS, ROWS = 256, 64, 10_000


def minimizers(words: np.ndarray, per: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, text, position) of the sampled shingles of texts, in order."""
    n = len(words)
    if n < k:
        e = np.zeros(0, np.int64)
        return e, e, e
    with np.errstate(over="ignore"):
        acc = np.zeros(n - k + 1, np.uint64)
        for x in range(k):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + words[x : n - k + 1 + x]
        acc = mix(acc)
    many = np.maximum(np.diff(per) - k + 1, 0)
    text = np.repeat(np.arange(len(many)), many)
    begins = np.concatenate([[0], np.cumsum(many)])
    pos = np.arange(len(text)) - begins[text]
    h = acc[per[text] + pos]
    chosen = np.zeros(len(h), bool)
    if len(h) >= w:
        at = np.lib.stride_tricks.sliding_window_view(h, w).argmin(1) + np.arange(len(h) - w + 1)
        chosen[at[text[: len(at)] == text[w - 1 :]]] = True
    for t in np.flatnonzero((many > 0) & (many < w)):
        chosen[begins[t] + int(h[begins[t] : begins[t + 1]].argmin())] = True
    own = np.flatnonzero(chosen)
    # in a run of one repeated shingle the first stands for all
    own = own[np.r_[True, (h[own][1:] != h[own][:-1]) | (text[own][1:] != text[own][:-1])]] if len(own) else own
    return signed(h[own]), text[own], pos[own]


def seeds(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in chunks(at):
                part = raw[at[i] : at[j]]
                begin, end, per = word_bounds(part, at[i : j + 1] - at[i])
                seed, text, pos = minimizers(word_hashes(part, begin, end), per, k, w)
                if len(seed):
                    yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(ids[i:j][text]), pa.array(pos.astype(np.int32))], names=["seed", "doc_id", "pos"])

    return docs.mapInArrow(run, SEEDS)


def document(place: str) -> Column:
    return F.shiftright(place, POS_BITS)


def placed(doc_id: str, pos: str) -> Column:
    return F.shiftleft(doc_id, POS_BITS).bitwiseOR(F.col(pos).cast("bigint"))


def parted(place: str, doc_id: str, pos: str) -> list[Column]:
    """A place as two columns, which take less room in a written table than the one number."""
    return [document(place).alias(doc_id), F.col(place).bitwiseAND(F.lit((1 << POS_BITS) - 1)).cast("int").alias(pos)]


def matches(found: DataFrame) -> DataFrame:
    """(place, source) of found(seed, place): each seed that several documents have and its first
    occurrence, which may be the document's own."""
    firsts = found.groupBy("seed").agg(F.min("place").alias("source"), F.max("place").alias("last")).where(document("last") > document("source")).drop("last")
    return found.join(firsts, "seed").select("place", "source")


# ---------------------------------------------------------------- chaining


def segments_of(pos: np.ndarray, source: np.ndarray, k: int, max_gap: int) -> list[tuple[int, int, int]]:
    """Matches merged along diagonals: (begin, source begin, length), ordered by begin."""
    diagonal = pos - source
    order = np.lexsort((pos, diagonal))
    p, d = pos[order], diagonal[order]
    cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] - p[:-1] - k > max_gap)])
    last = np.r_[cut[1:], len(p)] - 1
    return sorted(zip(p[cut].tolist(), (p[cut] - d[cut]).tolist(), (p[last] - p[cut] + k).tolist(), strict=True))


class PrefixMax:
    """A Fenwick tree of prefix maxima with their holders."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def get(self, i: int) -> tuple[float, int]:
        out = (-1e18, -1)
        while i:
            out = max(out, self.best[i])
            i &= i - 1
        return out


def chain(segments: list[tuple[int, int, int]], cost: float, max_gap: int) -> list[list[tuple[int, int, int]]]:
    """Chains of segments that follow each other in both texts. A chain's worth is the length of
    its segments less ``cost`` for each word of the gaps in either text, which splits into a part
    of the end of one segment and a part of the begin of the next, so that the best chain to
    follow is a prefix maximum. Chains are taken from the best on, without used segments, and
    parted where a gap is wider than ``max_gap``."""
    n = len(segments)
    if n == 1:
        return [segments]
    ends = sorted({j + m for _, j, m in segments})
    place = {e: x + 1 for x, e in enumerate(ends)}
    worth, before = [0.0] * n, [-1] * n
    tree = PrefixMax(len(ends))
    by_end = sorted(range(n), key=lambda x: segments[x][0] + segments[x][2])
    done = 0
    for x in range(n):
        i, j, m = segments[x]
        while done < n and segments[by_end[done]][0] + segments[by_end[done]][2] <= i:
            y = by_end[done]
            p, q, r = segments[y]
            tree.put(place[q + r], (worth[y] + cost * (p + r + q + r), y))
            done += 1
        lo, hi = 0, len(ends)
        while lo < hi:
            mid = (lo + hi) // 2
            if ends[mid] <= j:
                lo = mid + 1
            else:
                hi = mid
        got, y = tree.get(lo)
        worth[x] = float(m)
        if y >= 0 and got - cost * (i + j) > 0:
            worth[x] += got - cost * (i + j)
            before[x] = y
    used, out = [False] * n, []
    for x in sorted(range(n), key=lambda x: -worth[x]):
        path = []
        while x >= 0 and not used[x]:
            used[x] = True
            path.append(segments[x])
            x = before[x]
        run: list[tuple[int, int, int]] = []
        for s in reversed(path):
            if run and max(s[0] - run[-1][0] - run[-1][2], s[1] - run[-1][1] - run[-1][2]) > max_gap:
                out.append(run)
                run = []
            run.append(s)
        if run:
            out.append(run)
    return out


def unsettled(pos: np.ndarray, source: np.ndarray, at: np.ndarray, k: int, w: int, size: int) -> list[int]:
    """Which runs of ``size`` words of a document other documents may have though no first
    occurrence shows it: pairs of the first and last begin. ``pos`` are the document's repeated
    seeds, ordered. A run that is shared has one in each of its ``w`` neighbouring shingles; it is
    settled if they and seeds over both its ends stand on one diagonal of one document."""
    diagonal = pos - at
    apart = np.diff(pos) > w
    cut = np.flatnonzero(np.r_[True, apart]) if len(pos) else np.zeros(0, int)
    turn = np.flatnonzero(np.r_[True, apart | (source[1:] != source[:-1]) | (diagonal[1:] != diagonal[:-1])]) if len(pos) else cut
    last = np.r_[turn[1:], len(pos)] - 1
    out: list[int] = []
    for a, b in zip(cut.tolist(), np.r_[cut[1:], len(pos)].tolist(), strict=True):
        lo, hi = max(0, int(pos[a]) - w + 1), int(pos[b - 1]) + w - 1 - (size - k)
        if hi < lo:
            continue
        for x in range(int(np.searchsorted(turn, a)), int(np.searchsorted(turn, b))):
            begin, end = int(pos[turn[x]]), int(pos[last[x]]) + k - size
            if begin <= end:
                if lo < begin:
                    out += [lo, begin - 1]
                lo = max(lo, end + 1)
        if lo <= hi:
            out += [lo, hi]
    return out


def loose(pos: np.ndarray, source: np.ndarray, spans: list[tuple[int, int]], k: int, w: int, least: int, max_gap: int) -> np.ndarray:
    """Which of a document's repeated seeds, ordered by ``pos``, stand in clusters that could be a
    passage of ``least`` words, but of which no chain (of ``spans``), nor the document's own first
    seeds, takes all but the ends."""
    cut = np.flatnonzero(np.r_[True, np.diff(pos) > k + max_gap])
    out = np.zeros(len(pos), bool)
    spans = sorted(spans)
    for a, b in zip(cut.tolist(), np.r_[cut[1:], len(pos)].tolist(), strict=True):
        begin, end = int(pos[a]), int(pos[b - 1]) + k
        if end - begin >= least - 2 * w and not any(min(y, end) - max(x, begin) >= end - begin - 2 * w for x, y in spans):
            out[a:b] = True
    return out


def before(scratch: Scratch, seeds: DataFrame) -> DataFrame:
    """(place, source) from seeds(place, source), where the source names a seed: each with its place in
    a document before that has it: the last one, or of a seed with many holders the last one in a
    part of them, and the first of all for the first of a part, so that each but the first has one."""
    held = scratch.save(seeds.groupBy("source", document("place").alias("doc")).agg(F.min("place").alias("place")).drop("doc"))
    many = held.groupBy("source").agg(F.count("*").alias("n"), F.min("place").alias("least")).where("n > 1")
    salted = held.join(many, "source").withColumn("salt", F.pmod(F.xxhash64(document("place")), F.ceil(F.col("n") / HOLDERS)))
    last = F.lag("place").over(Window.partitionBy("source", "salt").orderBy("place"))
    with_one = salted.withColumn("b", F.coalesce(last, "least")).where(document("b") < document("place"))
    return with_one.where(document("b") != document("source")).select("place", F.col("b").alias("source"))


def chains(found: DataFrame, k: int = K, w: int = W, size: int = 0, max_gap: int = MAX_GAP, cost: float = GAP_COST, least: int = LEAST_SEED_WORDS) -> DataFrame:
    """Chains of each pair of documents whose segments hold ``least`` words; segments in threes.
    With a ``size``, rows without a source have the unsettled runs of a document, or its loose
    seeds: place and source in twos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out(doc, parts):
            source, pos, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            cut = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
            spans = []
            for i, j in zip(cut, np.r_[cut[1:], len(source)], strict=True):
                parts = chain(segments_of(pos[i:j], at[i:j], k, max_gap), cost, max_gap)
                spans += [(c[0][0], c[-1][0] + c[-1][2]) for c in parts]
                if source[i] == doc:
                    continue
                for c in parts:
                    if sum(m for _, _, m in c) >= least:
                        yield doc, int(source[i]), [x for s in c for x in s], None
            if size and len(pos) > 1:
                order = np.argsort(pos, kind="stable")
                pos, source, at = pos[order], source[order], at[order]
                left = unsettled(pos, source, at, k, w, size)
                if left:
                    yield doc, None, left, None
                own = loose(pos, source, spans, k, w, size, max_gap)
                if own.any():
                    yield doc, None, None, np.column_stack([(doc << POS_BITS) | pos, (source << POS_BITS) | at])[own].reshape(-1).tolist()

        def batch_of(rows):
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], t) for x, t in enumerate(kinds)], names=["doc_id", "source", "segments", "seeds"])

        for batch in batches:
            place, first = batch.column("place").to_numpy(), batch.column("source").to_numpy()
            doc, source, low = place >> POS_BITS, first >> POS_BITS, (1 << POS_BITS) - 1
            pos, at = place & low, first & low
            cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, int)
            rows = []
            for i, j in zip(cut, np.r_[cut[1:], len(doc)], strict=True):
                if int(doc[i]) != now:
                    if held:
                        rows += out(now, held)
                    now, held = int(doc[i]), []
                held.append((source[i:j], pos[i:j], at[i:j]))
            if rows:
                yield batch_of(rows)
        if held:
            yield batch_of(list(out(now, held)))

    return found.select("place", "source").repartition(document("place")).sortWithinPartitions(document("place"), "source").mapInArrow(run, CHAINS + ", seeds array<bigint>")


# ---------------------------------------------------------------- alignment


def _extend(a: np.ndarray, b: np.ndarray, drop: int) -> tuple[int, int, bool]:
    """How far two runs of words go together from their begins: (words, equal words), by the best
    sum of +1 for equal and -1 for other words before it falls by ``drop``; and whether it hasn't
    fallen by the end of the shorter run, so that more words could matter."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0, True
    same = a[:n] == b[:n]
    score = np.cumsum(np.where(same, 1, -1))
    top = np.maximum.accumulate(np.maximum(score, 0))
    fallen = np.flatnonzero(top - score >= drop)
    upto = int(fallen[0]) if len(fallen) else n
    if not upto:
        return 0, 0, False
    best = int(np.argmax(score[:upto]))
    return (*((best + 1, int(same[: best + 1].sum())) if score[best] > 0 else (0, 0)), not len(fallen))


def _between(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words of two short runs in order: the longest common subsequence."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, int)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return int(row[-1])


def align(a: np.ndarray, b: np.ndarray, segments: list[tuple[int, int, int]], drop: int = DROP) -> tuple[tuple[int, int, int, int, int], bool, bool]:
    """(begin, end, source begin, source end, equal words) of a chain's passage in words a and b, and
    whether it may go on before or after these words."""
    first, last = segments[0], segments[-1]
    back, n_back, before = _extend(a[: first[0]][::-1], b[: first[1]][::-1], drop)
    i, j = last[0] + last[2], last[1] + last[2]
    on, n_on, after = _extend(a[i:], b[j:], drop)
    equal = n_back + n_on
    for x, (p, q, m) in enumerate(segments):
        equal += int((a[p : p + m] == b[q : q + m]).sum())
        if x:
            o = segments[x - 1]
            equal += _between(a[o[0] + o[2] : p], b[o[1] + o[2] : q])
    return (first[0] - back, i + on, first[1] - back, j + on, equal), before, after


def _columns(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, bool]]:
    """Two short runs against each other by their longest common subsequence: (words of a, words
    of b, equal) a column; words between equal ones stand in pairs as far as they go."""
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for x in range(len(a)):
        t[x + 1, 1:] = np.maximum.accumulate(np.maximum(t[x, 1:], np.where(b == a[x], t[x, :-1] + 1, 0)))
    x, y, met = len(a), len(b), []
    while x and y:
        if t[x, y] == t[x - 1, y]:
            x -= 1
        elif t[x, y] == t[x, y - 1]:
            y -= 1
        else:
            x, y = x - 1, y - 1
            met.append((x, y))
    out, i, j = [], 0, 0
    for x, y in [*reversed(met), (len(a), len(b))]:
        both = min(x - i, y - j)
        out += [(1, 1, False)] * both + [(1, 0, False)] * (x - i - both) + [(0, 1, False)] * (y - j - both)
        if x < len(a) and y < len(b):
            out.append((1, 1, True))
        i, j = x + 1, y + 1
    return out


def _longest(same: np.ndarray, identity: float) -> tuple[int, int]:
    """The longest run of columns from an equal one to an equal one that has ``identity``."""
    total = np.r_[0, np.cumsum(np.where(same, 1 - identity, -identity))]
    where = np.flatnonzero(same)
    if not len(where):
        return 0, 0
    low, high = total[where], total[where + 1]
    begins = np.flatnonzero(np.r_[True, low[1:] < np.minimum.accumulate(low)[:-1]])
    top = np.maximum.accumulate(high[::-1])[::-1]
    # the last end whose sum is no less; suffix maxima fall, so it is found by bisection
    last = len(top) - np.searchsorted(top[::-1], low[begins] - 1e-9, side="left") - 1
    best = int(np.argmax(where[last] - where[begins]))
    return int(where[begins[best]]), int(where[last[best]]) + 1


def parts(a: np.ndarray, b: np.ndarray, segments: list[tuple[int, int, int]], span: tuple[int, int, int, int], min_words: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """The passages in the alignment ``span`` of a chain, as by align(), if the whole is none."""
    i, i1, j, j1 = span
    runs: list[np.ndarray] = []
    here = (i, j)
    for p, q, m in [*segments, (i1, j1, 0)]:
        (x, y), first, final = here, not runs, m == 0
        if first or final:
            runs.append(np.stack([np.ones(p - x, int), np.ones(p - x, int), a[x:p] == b[y:q]], 1))
        else:
            runs.append(np.array(_columns(a[x:p], b[y:q]), int).reshape(-1, 3))
        runs.append(np.stack([np.ones(m, int), np.ones(m, int), a[p : p + m] == b[q : q + m]], 1))
        here = (p + m, q + m)
    columns = np.concatenate(runs)
    at = np.vstack([[i, j], [i, j] + np.cumsum(columns[:, :2], 0)])
    same = columns[:, 2] > 0
    out, todo = [], [(0, len(columns))]
    while todo:
        x, y = todo.pop()
        if at[y, 0] - at[x, 0] < min_words:
            continue
        lo, hi = _longest(same[x:y], identity)
        lo, hi = x + lo, x + hi
        if hi - lo < min_words:
            continue
        if at[hi, 0] - at[lo, 0] >= min_words:
            out.append((int(at[lo, 0]), int(at[hi, 0]), int(at[lo, 1]), int(at[hi, 1]), int(same[lo:hi].sum())))
        todo += [(x, lo), (hi, y)]
    return sorted(out)


def _words(text: str) -> np.ndarray:
    raw, at = text_bytes(pa.array([text], pa.string()))
    begin, end, _ = word_bounds(raw, at)
    return (word_hashes(raw, begin, end) >> np.uint64(32)).astype(np.uint32)


def _bounds(segments: np.ndarray) -> tuple[np.ndarray, int, int]:
    s = segments.reshape(-1, 3)
    return s, int(s[0, 1]), int(s[-1, 1] + s[-1, 2])


def windows(words: np.ndarray, spans: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, hash) of the runs of ``size`` words that begin in spans."""
    begin = np.concatenate([np.arange(i, j + 1) for i, j in spans.reshape(-1, 2)])
    begin = begin[begin + size <= len(words)]
    return begin, signed(span_hashes(mix(words.astype(np.uint64) + np.uint64(1)), begin, begin + size))


def aligned(scratch: Scratch, docs: DataFrame, linked: DataFrame, size: int, min_words: int, identity: float, flank: int) -> DataFrame:
    """The passages of chains; and, with a seed, the runs of ``size`` words of rows without a source.
    Of the first document ``flank`` words beside a chain are sent; the few chains that go on there
    are aligned again with 256 times as many, until none does."""
    done: list[DataFrame] = []
    while True:
        found = _aligned(scratch, docs, linked, size if not done else 0, min_words, identity, flank)
        done.append(found.where("goes_on IS NULL").drop("goes_on"))
        linked = found.where("goes_on IS NOT NULL").select("doc_id", F.col("source_doc_id").alias("source"), F.col("goes_on").alias("segments"))
        if linked.isEmpty():
            break
        flank *= 256
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _aligned(scratch: Scratch, docs: DataFrame, linked: DataFrame, size: int, min_words: int, identity: float, flank: int) -> DataFrame:
    spark = scratch.spark
    ids = scratch.save(linked.select("doc_id").union(linked.where("source IS NOT NULL").select("source")).distinct())
    texts = docs.join(F.broadcast(ids) if small_enough(ids, 24) else ids, "doc_id", "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words = None, None
        for batch in batches:
            texts, sources = batch.column("text"), batch.column("source").to_pylist()
            froms, held, more = [], [], []
            for x, segments in enumerate(batch.column("segments")):
                if sources[x] != now:
                    now, words = sources[x], _words(texts[x].as_py())
                _, j0, j1 = _bounds(np.asarray(segments.values))
                froms.append(max(0, j0 - flank))
                held.append(words[froms[-1] : j1 + flank].tobytes())
                more.append(j1 + flank < len(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("segments"), pa.array(froms, pa.int32()), pa.array(more, pa.bool_()), pa.array(held, pa.binary())], names=["doc_id", "source", "segments", "from", "more", "words"])

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
    names = [c.split()[0] for c in FINISHED.split(", ")]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words = None, None
        for batch in batches:
            texts, docs_, sources, froms, mores = batch.column("text"), *(batch.column(c).to_pylist() for c in ("doc_id", "source", "from", "more"))
            out = []
            for x, (segments, theirs) in enumerate(zip(batch.column("segments"), batch.column("words"), strict=True)):
                if docs_[x] != now:
                    now, words = docs_[x], _words(texts[x].as_py())
                if sources[x] is None:
                    begin, key = windows(words, np.asarray(segments.values), size)
                    own = {"doc_id": np.full(len(begin), now), "begin": begin, "seed": key}
                    yield pa.RecordBatch.from_arrays([pa.array(own[c], t) if c in own else pa.nulls(len(begin), t) for c, t in zip(names, kinds, strict=True)], names=names)
                    continue
                s, _, _ = _bounds(np.asarray(segments.values))
                b = np.frombuffer(theirs.as_buffer(), np.uint32)
                lo = max(0, int(s[0, 0]) - flank)
                hi = int(s[-1, 0] + s[-1, 2]) + flank
                a = words[lo:hi]
                own = [(int(p) - lo, int(q) - froms[x], int(m)) for p, q, m in s]
                (i, i1, j, j1, equal), earlier, later = align(a, b, own)
                # an end of the words that isn't one of the text: more of both are needed
                if (earlier and own[0][0] > 0 and own[0][1] > 0 and (lo > 0 or own[0][0] > own[0][1]) and (froms[x] > 0 or own[0][1] > own[0][0])) or (
                    later and (hi < len(words) or len(a) - own[-1][0] > len(b) - own[-1][1]) and (mores[x] or len(b) - own[-1][1] > len(a) - own[-1][0])
                ):
                    out.append((docs_[x], None, None, sources[x], None, None, None, None, s.reshape(-1).tolist()))
                    continue
                if i1 - i < min_words:
                    continue
                good = [(i, i1, j, j1, equal)] if equal >= identity * max(i1 - i, j1 - j) else parts(a, b, own, (i, i1, j, j1), min_words, identity)
                for i, i1, j, j1, equal in good:
                    out.append((docs_[x], i + lo, i1 - i, sources[x], j + froms[x], j1 - j, equal, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=names)

    with batch_rows(spark, LINKS):
        stretches = linked.where("source IS NOT NULL").join(texts.withColumnRenamed("doc_id", "source"), "source").select("doc_id", "source", "segments", "text").mapInArrow(cut, CHAINS + ", from int, more boolean, words binary")
        if size:
            nothing = [F.lit(None).cast(t) for t in ("int", "boolean", "binary")]
            stretches = stretches.union(linked.where("source IS NULL").select("doc_id", "source", "segments", *nothing))
        # dealt anew in any case, so that no task runs both passes in Python at once
        result = scratch.save(stretches.repartition("doc_id").join(texts, "doc_id").select("doc_id", "source", "segments", "from", "more", "words", "text").mapInArrow(finish, FINISHED))
    scratch.drop(ids)
    return result


def passages(rows: RowIds, k: int = K, w: int = W, min_words: int = MIN_WORDS, identity: float = IDENTITY, flank: int = FLANK) -> DataFrame:
    """(doc_id, begin, n_words, source_doc_id, source_begin, source_words, matches), in words from
    0: what a document of ``rows`` repeats of documents with a smaller id."""
    scratch, docs = rows.scratch, rows.docs.where("text IS NOT NULL")
    spark = scratch.spark
    size = max(min_words, k + w - 1)
    with batch_rows(spark, TEXTS):
        found = scratch.save(seeds(docs, k, w))
    met = matches(found.select("seed", placed("doc_id", "pos").alias("place")))
    joined = scratch.save(met.select(*parted("place", "doc_id", "pos"), *parted("source", "source", "source_pos")))
    scratch.drop(found)
    scratch.free_shuffles()
    with batch_rows(spark, ROWS):
        linked = scratch.save(chains(joined.select(placed("doc_id", "pos").alias("place"), placed("source", "source_pos").alias("source")), k, w, size))
    scratch.drop(joined)
    scratch.free_shuffles()
    once = aligned(scratch, docs, linked.where("segments IS NOT NULL").drop("seeds"), size, min_words, identity, flank)
    # loose seeds meet the document before that has them
    two = F.transform(F.sequence(F.lit(0), F.size("seeds") - 1, F.lit(2)), lambda i: F.struct(F.get("seeds", i).alias("place"), F.get("seeds", i + 1).alias("source")))
    spread = linked.where("seeds IS NOT NULL").select(F.explode(two).alias("s")).select("s.*")
    with batch_rows(spark, ROWS):
        relinked = scratch.save(chains(before(scratch, spread), k, w).drop("seeds"))
    scratch.drop(linked)
    scratch.free_shuffles()
    # unsettled runs of words meet their own first occurrence
    runs = once.where("seed IS NOT NULL").select("seed", placed("doc_id", "begin").alias("place"))
    with batch_rows(spark, ROWS):
        linked = scratch.save(chains(matches(runs), size).drop("seeds").union(relinked))
    scratch.free_shuffles()
    again = aligned(scratch, docs, linked, 0, min_words, identity, flank)
    out = scratch.save(once.where("seed IS NULL").union(again).drop("seed").distinct())
    scratch.keep(out, *([] if rows.ids is None else [rows.ids]))
    return out


def _rows(docs: DataFrame, doc_id: str, text: str) -> RowIds:
    return RowIds(Scratch(docs.sparkSession, "substring"), docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), 1 << (63 - POS_BITS))


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    rows = _rows(docs, doc_id, text)
    found = rows.named(passages(rows, min_words=min_words), "doc_id", "source_doc_id")
    return found.select([c.split()[0] for c in PASSAGES.split(", ")])


def cut_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the passages that documents with smaller ids have too, and words_removed
    (long); an input column of that name is replaced. What is left keeps its white space."""
    rows = _rows(docs, doc_id, text)
    spans = passages(rows, min_words=min_words).groupBy(F.col("doc_id").alias("__gm_id")).agg(F.sort_array(F.collect_set(F.struct("begin", (F.col("begin") + F.col("n_words")).alias("end")))).alias("__gm_spans"))
    out = rows.join(docs, doc_id, text, spans, "__gm_id", False)

    @F.pandas_udf("struct<text string, removed bigint>")
    def cut(texts, spans_):
        import pandas as pd

        kept, removed = [], []
        for t, own in zip(texts, spans_, strict=True):
            if t is None or own is None or not len(own):
                kept.append(t)
                removed.append(0)
                continue
            raw, at = text_bytes(pa.array([t], pa.string()))
            begin, end, _ = word_bounds(raw, at)
            go = np.zeros(len(raw), bool)
            gone = np.zeros(len(begin), bool)
            for s in own:
                gone[s["begin"] : s["end"]] = True
                go[begin[s["begin"]] : end[s["end"] - 1]] = True
            kept.append(raw[~go].tobytes().decode())
            removed.append(int(gone.sum()))
        return pd.DataFrame({"text": kept, "removed": removed})

    cut = cut.asNondeterministic()  # or a filter on what is left would be run below it, with a cut of its own
    return out.withColumn("__gm_cut", cut(F.col(text), F.col("__gm_spans"))).withColumns({text: F.col("__gm_cut.text"), "words_removed": F.col("__gm_cut.removed")}).drop("__gm_spans", "__gm_cut")


def has_words(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, SPACE_CLASS, "") != "", F.lit(False))
