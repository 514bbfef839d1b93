"""LM scoring by a Brown class-based bigram model.

P(text) = product of P(class | class before) P(word | class), ends of texts included.

Classes come from exchange clustering, in three tiers by the rank of a word's count:

* the ``HEAD`` most frequent words are clustered on their bigram matrix: each word in turn moves
  to the class that raises the likelihood most, until a sweep moves few;
* the ``MIDDLE`` most frequent words, head included, are then exchanged in ``PASSES`` distributed
  sweeps: a pass over the corpus counts the classes before and after each of them, whatever task
  its occurrences are in, and each word goes to the class whose contexts explain its own best, with
  the classes of all of them as they are by then. Words move in halves, so that neighbours don't
  change places for ever;
* every other word takes one such step by the contexts of all its occurrences, into a twin of the
  class for rarer words.

An emission is an absolute discount of the word's count in its class; the discounted mass is that
of an unknown word. Transitions are smoothed towards the class unigram (Witten-Bell). So the
probabilities of all words and the unknown word sum to one in each context. All counts cover all
training texts.

The corpus is tokenised once, into blocks of BLOCK tokens with a dictionary each, a written
table. Passes over it work on ids and send what a block or task has counted, never tokens: the
counts of words, then of the contexts of words, then the dictionary itself, which comes back
with counts and classes. Rows of a frequent word are as many as blocks or tasks, so no word is
hot. The driver sees MIDDLE words with the counts of their contexts, the matrix of HEAD words and
that of classes: bounded, whatever the corpus.

Words are known by a 64-bit hash (about n**2 / 2**65 of n words share one).

Defined results: null text is empty and has its end alone; a null doc_id counts as the empty
text when it is dealt; rows repeat as they come; an empty table gives no rows; without any
training text each token has probability 1; columns other than the id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import Scratch, batch_rows, chunks, signed, text_bytes, word_bounds, word_hashes

HEAD, MIDDLE, PASSES, CLASSES, SWEEPS, DISCOUNT = 1024, 8192, 3, 64, 8, 0.5
BLOCK, MERGE, BLOCKS_A_BATCH, TEXTS_A_BATCH = 1_000_000, 6_000_000, 4, 256
# classes from 0 on: of the head and middle words; then other words while these are clustered, then
# the end of a text
OTHER, END, WIDTH = CLASSES, CLASSES + 1, CLASSES + 2
# in the model: classes and their twins, then the end and the unknown word
M_END, M_UNKNOWN = 2 * CLASSES, 2 * CLASSES + 1
N_MODEL = 2 * CLASSES + 2

CORPUS = "block bigint, doc_ids array<bigint>, ends array<int>, words binary, ids binary"
ENTRY = np.dtype([("code", "u1"), ("n", "<u4")])  # codes are below 2 * WIDTH
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, emitted double, classes binary"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def tokenize(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks: ids of documents, where their tokens end, the words' hashes in order, and the tokens
    as places in ``words``, one past the last for an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        docs: list = []
        sizes: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        held = 0

        def row():
            words, ids = np.unique(np.concatenate(tokens), return_inverse=True)
            each = np.concatenate(sizes)
            ends = np.cumsum(each + 1)
            out = np.empty(ends[-1], np.uint32)
            last = np.zeros(len(out), bool)
            last[ends - 1] = True
            out[last], out[~last] = len(words), ids
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([ends.astype(np.int32)], pa.list_(pa.int32())), pa.array([words.tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary())], names=["block", "doc_ids", "ends", "words", "ids"])

        for batch in batches:
            raw, at = text_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in chunks(at):
                begin, end, per = word_bounds(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                tokens.append(signed(word_hashes(raw[at[i] : at[j]], begin, end)))
                sizes.append(np.diff(per))
                docs += ids[i:j]
                held += len(begin) + j - i
                if held >= block:
                    yield row()
                    docs, sizes, tokens, held, number = [], [], [], 0, number + 1
        if docs:
            yield row()

    return docs.mapInArrow(run, CORPUS)


class Blocks:
    """The blocks of a batch: (words, ids, ends, doc_ids, learns: which tokens to learn from)."""

    def __init__(self, batch: pa.RecordBatch):
        self.columns = [batch.column(c) for c in ("doc_ids", "ends", "words", "ids")]

    def __iter__(self):
        for docs, ends, words, ids in zip(*self.columns, strict=True):
            docs, ends = docs.as_py(), np.asarray(ends.values)
            ids = np.frombuffer(ids.as_buffer(), np.uint32)
            out = np.array([held_out(d) for d in docs])
            yield np.frombuffer(words.as_buffer(), np.int64), ids, ends, docs, out, ~np.repeat(out, np.diff(ends, prepend=0))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def word_counts(corpus: DataFrame) -> DataFrame:
    """(word, n) of training tokens, with the end of text as a null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns, held, ends_seen = [], [], 0, 0
        for batch in batches:
            for words, ids, _, _, _, learns in Blocks(batch):
                n = np.bincount(ids[learns], minlength=len(words) + 1)
                ends_seen += int(n[-1])
                some = np.flatnonzero(n[:-1])
                keys.append(words[some])
                ns.append(n[:-1][some])
                held += len(some)
                if held > MERGE:
                    k, v = summed(np.concatenate(keys), np.concatenate(ns))
                    keys, ns, held = [k], [v], len(k)
                    if held > MERGE // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v)], names=["word", "n"])
                        keys, ns, held = [], [], 0
        if keys:
            k, v = summed(np.concatenate(keys), np.concatenate(ns))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v)], names=["word", "n"])
        if ends_seen:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([ends_seen])], names=["word", "n"])

    return corpus.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def lookup(sorted_keys: np.ndarray, keys: np.ndarray, missing: int) -> np.ndarray:
    if not len(sorted_keys):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, missing)


def head_bigrams(corpus: DataFrame, head: np.ndarray) -> np.ndarray:
    """Bigram counts of head words, other words (place len(head)) and ends (len(head) + 1)."""
    size = len(head) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for words, ids, _, _, _, learns in Blocks(batch):
                now = np.append(lookup(head, words, size - 2), size - 1)[ids]
                before = np.append(size - 1, now[:-1])
                codes, n = np.unique((before * size + now)[learns], return_counts=True)
                total[codes] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["code", "n"])

    rows = corpus.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(size, size)


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the words of a bigram matrix whose last two places are other words and ends,
    which keep classes of their own; and the counts of class bigrams."""
    b = bigrams.astype(float)
    n = len(b) - 2
    order = np.argsort(-(b.sum(0)[:n]), kind="stable")
    of = np.zeros(n + 2, int)
    of[order] = np.arange(n) % classes
    of[n], of[n + 1] = classes, classes + 1
    one = np.zeros((n + 2, classes + 2))
    one[np.arange(n + 2), of] = 1
    right, left = b @ one, b.T @ one  # word -> class after, word -> class before
    m = one.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, same = of[w], b[w, w]
            r, l = right[w].copy(), left[w].copy()  # noqa: E741
            r[a] -= same
            l[a] -= same
            m[a] -= r
            m[:, a] -= l
            m[a, a] -= same
            rows, cols = m.sum(1), m.sum(0)
            gain = (_h(m + r) - _h(m)).sum(1) + (_h(m + l[:, None]) - _h(m)).sum(0)
            d = np.diag(m)
            gain += _h(d + r + l + same) - _h(d + r) - _h(d + l) + _h(d)
            gain -= _h(rows + r.sum() + same) - _h(rows) + _h(cols + l.sum() + same) - _h(cols)
            to = int(np.argmax(gain[:classes]))
            if gain[to] <= gain[a] + 1e-9:
                to = a
            m[to] += r
            m[:, to] += l
            m[to, to] += same
            if to != a:
                moved += 1
                of[w] = to
                right[:, a] -= b[:, w]
                right[:, to] += b[:, w]
                left[:, a] -= b[w]
                left[:, to] += b[w]
        if moved <= n // 200:
            break
    return of[:n], np.maximum(m, 0)


def context_worth(m: np.ndarray) -> np.ndarray:
    """For each context (class before, then class after) what an occurrence there says for each
    class: the log of how much likelier the context is than by chance."""
    x = m + 0.5
    p = x / x.sum()
    by = np.log(p) - np.log(p.sum(1))[:, None] - np.log(p.sum(0))[None, :]
    return np.vstack([by[:, :CLASSES], by.T[:, :CLASSES]])


def contexts_of(corpus: DataFrame, words: np.ndarray, of: np.ndarray) -> np.ndarray:
    """(word, 2 * WIDTH): how often each class stands before, and after, each of the sorted ``words``,
    whose classes are ``of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words) * 2 * WIDTH, np.int64)
        for batch in batches:
            for own, ids, _, _, _, learns in Blocks(batch):
                at = np.append(lookup(words, own, -1), -1)
                around = np.append(np.where(at[:-1] < 0, OTHER, of[at[:-1]]), END)[ids]
                place = at[ids]
                mine = np.flatnonzero(learns & (place >= 0))
                if not len(mine):
                    continue
                before = np.where(mine > 0, around[mine - 1], END)
                base = place[mine] * (2 * WIDTH)
                codes, n = np.unique(np.concatenate([base + before, base + WIDTH + around[mine + 1]]), return_counts=True)
                total[codes] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["code", "n"])

    rows = corpus.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(words) * 2 * WIDTH, np.int64)
    out[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(len(words), 2 * WIDTH)


def class_matrix(contexts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Counts of class bigrams as far as one of both words is known by its contexts."""
    m = np.zeros((WIDTH, WIDTH))
    np.add.at(m, of, contexts[:, WIDTH:])
    # rows of OTHER and END come from what stands before known words
    before = np.zeros((WIDTH, WIDTH))
    np.add.at(before, of, contexts[:, :WIDTH])
    m[CLASSES:, :CLASSES] = before.T[CLASSES:, :CLASSES]
    return m


def reassigned(contexts: np.ndarray, of: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The classes after the words ``moves`` went where their contexts are likeliest."""
    best = (contexts @ context_worth(class_matrix(contexts, of))).argmax(1)
    return np.where(moves, best, of)


def rare_words(corpus: DataFrame, head: np.ndarray, head_class: np.ndarray) -> DataFrame:
    """(word, contexts): for each word not in ``head``, counts of the classes around it."""
    width = WIDTH

    def row(keys: np.ndarray, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        entries = np.empty(len(codes), ENTRY)
        entries["code"], entries["n"] = codes, n
        ends = np.append(first, len(codes)).astype(np.int32) * ENTRY.itemsize
        return pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(entries)])], names=["word", "contexts"])

    def combine(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, codes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((codes, keys))
        keys, codes, n = keys[order], codes[order], n[order]
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (codes[1:] != codes[:-1])])
        return keys[first], codes[first], np.add.reduceat(n, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for words, ids, _, _, _, learns in Blocks(batch):
                at = lookup(head, words, -1)
                of = np.append(np.where(at < 0, OTHER, head_class[at]) if len(head) else np.full(len(words), OTHER), END)
                around = of[ids]
                mine = np.flatnonzero(learns & (around == OTHER))
                if not len(mine):
                    continue
                before = np.where(mine > 0, around[mine - 1], END)
                code = np.concatenate([before, around[mine + 1] + width])
                key, n = np.unique(np.tile(ids[mine].astype(np.int64), 2) * (2 * width) + code, return_counts=True)
                parts.append((words[key // (2 * width)], (key % (2 * width)).astype(np.uint8), n))
                held += len(n)
                if held > MERGE:
                    yield row(*combine(parts))
                    parts, held = [], 0
        if parts:
            yield row(*combine(parts))

    return corpus.mapInArrow(run, "word bigint, contexts binary")


def rare_classes(contexts: DataFrame, worth: np.ndarray) -> DataFrame:
    """(word, n, class) from all contexts of each word, which may be in many rows."""
    width = WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, total, n = None, np.zeros(CLASSES), 0
        for batch in batches:
            words = batch.column(0).to_numpy()
            column = batch.column(1)
            _, offsets, data = column.buffers()
            at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // ENTRY.itemsize
            e = np.frombuffer(data, ENTRY)[at[0] : at[-1]]
            at = at - at[0]
            first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
            starts = at[first]
            counts = e["n"].astype(np.int64)
            score = np.add.reduceat(worth[e["code"]] * counts[:, None], starts, axis=0)
            seen = np.add.reduceat(np.where(e["code"] < width, counts, 0), starts)
            keys = words[first]
            if word is not None and keys[0] == word:
                score[0] += total
                seen[0] += n
            elif word is not None:
                keys, score, seen = np.append(word, keys), np.vstack([total, score]), np.append(n, seen)
            word, total, n = keys[-1], score[-1], int(seen[-1])
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(seen[:-1]), pa.array((score[:-1].argmax(1) + CLASSES).astype(np.int32))], names=["word", "n", "class"])
        if word is not None:
            yield pa.RecordBatch.from_arrays([pa.array([word]), pa.array([n]), pa.array([int(total.argmax()) + CLASSES], pa.int32())], names=["word", "n", "class"])

    return contexts.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word bigint, n bigint, class int")


def dictionaries(corpus: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch.column("block"), batch.column("words"), strict=True):
                own = np.frombuffer(words.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block.as_py())), pa.array(own)], names=["block", "word"])

    return corpus.select("block", "words").mapInArrow(run, "block bigint, word bigint")


def filled(known: DataFrame) -> DataFrame:
    """(block, counts, classes) of a block's dictionary, in the order of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ns, of = None, [], []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.concatenate(ns).astype(np.int64).tobytes()], pa.binary()), pa.array([np.concatenate(of).astype(np.uint8).tobytes()], pa.binary())], names=["block", "counts", "classes"])

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            n, c = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            cut = np.r_[0, np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, len(blocks)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if i == j:
                    continue
                if block is not None and blocks[i] != block:
                    yield row()
                    ns, of = [], []
                block = int(blocks[i])
                ns.append(n[i:j])
                of.append(c[i:j])
        if block is not None:
            yield row()

    return known.repartition("block").sortWithinPartitions("block", "word").mapInArrow(run, "block bigint, counts binary, classes binary")


def emissions(blocks: DataFrame, total: int, distinct: int, class_total: np.ndarray, ends_n: int) -> DataFrame:
    """A row for each document: all of its score but the transitions, and its classes."""
    rest = total + 0.5 * (distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled_in = zip(batch.column("counts"), batch.column("classes"), strict=True)
            for (words, ids, ends, docs, out, _), (counts, classes) in zip(Blocks(batch), filled_in, strict=True):
                n = np.zeros(len(words) + 1, np.int64)
                of = np.full(len(words) + 1, M_UNKNOWN, np.uint8)
                if counts.is_valid and len(words):
                    n[:-1], of[:-1] = np.frombuffer(counts.as_buffer(), np.int64), np.frombuffer(classes.as_buffer(), np.uint8)
                n[-1], of[-1] = ends_n, M_END if ends_n else M_UNKNOWN
                base = np.log10((n + 0.5) / rest)
                says = np.where(n > 0, np.log10(np.maximum(n - DISCOUNT, 0.1) / np.maximum(class_total[of], 1)), 0.0)
                begins = np.r_[0, ends[:-1]]
                per = lambda x: np.add.reduceat(x[ids], begins)
                own = of[ids].tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, pa.int64()), pa.array(out), pa.array((ends - begins).astype(np.int64)), pa.array(per((n > 0).astype(np.int64))), pa.array(per(base)), pa.array(per(says)),
                    pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(own)]),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "emitted", "classes"])

    return blocks.mapInArrow(run, SCORED)


def _class_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("classes")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].astype(np.int64), at - at[0]


def _pairs(now: np.ndarray, at: np.ndarray) -> np.ndarray:
    before = np.r_[M_END, now[:-1]]
    before[at[:-1][at[:-1] < len(now)]] = M_END
    return before * N_MODEL + now


def class_bigrams(scored: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_MODEL * N_MODEL, np.int64)
        for batch in batches:
            now, at = _class_arrays(batch)
            total += np.bincount(_pairs(now, at), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["code", "n"])

    rows = scored.where("NOT held_out").select("classes").mapInArrow(run, "code bigint, n bigint").where("n > 0").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(N_MODEL * N_MODEL, np.int64)
    out[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(N_MODEL, N_MODEL)


def transitions(m: np.ndarray, class_words: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), with the unknown word as the last class."""
    m = m[:-1, :-1].astype(float)
    mass = m.sum(0)
    if not mass.sum():
        return np.zeros((N_MODEL, N_MODEL))
    unigram = (mass + 0.5 * (class_words[:-1] > 0)) / (mass + 0.5 * (class_words[:-1] > 0)).sum()
    kinds = np.maximum((m > 0).sum(1, keepdims=True), 1)
    p = (m + kinds * unigram) / (m.sum(1, keepdims=True) + kinds)
    unknown = np.divide(DISCOUNT * class_words[:-1], mass, out=np.zeros_like(mass), where=mass > 0)
    after = mass * unknown
    p = np.vstack([p, (after / after.sum()) @ p if after.sum() else unigram])
    p = np.hstack([p, (p @ unknown)[:, None]])
    return np.log10(np.maximum(p, 1e-300))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", learned: dict | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row. A dict given
    as ``learned`` takes the words, a written table (word, n, class) of hashes, and the transitions."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    with batch_rows(spark, TEXTS_A_BATCH):
        corpus = scratch.save(tokenize(docs))
    with batch_rows(spark, BLOCKS_A_BATCH):
        counts = scratch.save(word_counts(corpus))
        total, distinct, ends_n = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0))).first()
        frequent = counts.where("word IS NOT NULL").orderBy(F.col("n").desc(), "word").limit(MIDDLE).toArrow()
        middle, middle_n = frequent.column("word").to_numpy(), frequent.column("n").to_numpy()
        scratch.drop(counts)
        scratch.free_shuffles()
        rank = np.argsort(middle)  # of the words in the order of their hashes
        middle, middle_n = middle[rank], middle_n[rank]
        top = rank < HEAD
        of = np.full(len(middle), OTHER)
        of[top], m = exchange(head_bigrams(corpus, middle[top]))
        for x in range(PASSES if len(middle) else 0):
            contexts = contexts_of(corpus, middle, of)
            of = reassigned(contexts, of, (of == OTHER) if x == 0 and (of == OTHER).any() else rank % 2 == x % 2)
            m = class_matrix(contexts, of)
        contexts = scratch.save(rare_words(corpus, middle, of))
    rows = pa.table({"word": pa.array(middle, pa.int64()), "n": pa.array(middle_n, pa.int64()), "class": pa.array(of.astype(np.int32), pa.int32())})
    words = scratch.save(rare_classes(contexts, context_worth(m)).union(spark.createDataFrame(rows, "word bigint, n bigint, class int")))
    scratch.drop(contexts)
    scratch.free_shuffles()
    class_total, class_words = np.zeros(N_MODEL), np.zeros(N_MODEL)
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        class_total[r["class"]], class_words[r["class"]] = r["n"], r["k"]
    class_total[M_END], class_words[M_END] = ends_n, int(ends_n > 0)
    with batch_rows(spark, BLOCKS_A_BATCH):
        known = scratch.save(dictionaries(corpus).join(words, "word", "left").select("block", "word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(M_UNKNOWN)).alias("class")))
    scratch.free_shuffles()
    entries = scratch.save(filled(known))
    scratch.drop(known)
    scratch.free_shuffles()
    with batch_rows(spark, BLOCKS_A_BATCH):
        scored = scratch.save(emissions(corpus.join(entries, "block", "left"), total, distinct, class_total, ends_n))
    moves_p = transitions(class_bigrams(scored), class_words)
    if learned is not None:
        learned.update(words=words, transitions=moves_p)
    scratch.keep(scored, *([] if learned is None else [words]))
    log_p = moves_p.reshape(-1)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now, at = _class_arrays(batch)
            if len(batch):
                moves = np.add.reduceat(log_p[_pairs(now, at)], at[:-1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array(np.full(len(moves), total, np.int64)), batch.column("base_score"), pa.array(moves + batch.column("emitted").to_numpy())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return scored.mapInArrow(finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
