"""SentencePiece encoding and decoding by streaming Viterbi.

The vocabulary and its scores come from a .model file. Encoding finds the segmentation of the
normalised text with the largest sum of scores, as the library's unigram model does: a piece of
the text that no vocabulary piece covers is an unknown character at a penalty, written as byte
pieces where the vocabulary has them. (For a file of merge ranks the scores are the negated
ranks. The library's merge order is another rule and can give other ids for such a file.)

The trellis is a window: positions before the last boundary that every surviving backpointer
path shares are committed and forgotten. It is looked for each time that the window has grown by
the longest piece's length beyond twice that, so the window is bounded by three such lengths and
the spread of the paths, whatever the length of the text. Where no piece crosses a position, that
position is such a boundary at once. Runs between characters that pieces can't cross are thus
decided alone, and their ids are kept in a bounded table, so that a frequent word costs a lookup.

Row by row: no shuffle. Defined results: null or empty text has no ids and decodes to "";
repeated rows repeat; columns other than the id and text are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import small_batches
from glossmill.llm.tokens import vocabulary_path

UNKNOWN_PENALTY = 10.0
SPACE = "▁"
CACHE_RUNS = 1_500_000
INFINITE = float("inf")
ENCODED = "doc_id bigint, ids array<int>, text_crc32 bigint"
DECODED = "doc_id bigint, text string, n_ids bigint, ids_crc32 bigint, text_crc32 bigint"


class Viterbi:
    """Best segmentation of a stream of characters into scored pieces."""

    def __init__(self, scores: dict[str, float], unknown: float):
        self.unknown = unknown
        self.longest = max(map(len, scores), default=1)
        #: Pieces with their scores, and beginnings of pieces that are none themselves with None.
        self.known: dict[str, float | None] = {p[:i]: None for p in scores for i in range(1, len(p))}
        self.known.update(scores)

    def segment(self, text: str) -> list[str]:
        """Pieces in order. Ties go to the longest last piece."""
        known, unknown, longest = self.known, self.unknown, self.longest
        n, base, reach, at, look = len(text), 0, 0, 0, 2 * longest
        best: list[float] = [0.0]  # of positions base, base + 1, .. reach
        back: list[int] = [0]
        out: list[str] = []
        while at < n:
            here = best[at - base]
            alone = False
            for j in range(at + 1, min(n, at + longest) + 1):
                piece = text[at:j]
                if piece not in known:
                    break
                s = known[piece]
                if s is None:
                    continue
                if j == at + 1:
                    alone = True
                s += here
                if j > reach:
                    best += [-INFINITE] * (j - reach)
                    back += [0] * (j - reach)
                    reach = j
                if s > best[j - base]:
                    best[j - base], back[j - base] = s, at
            if not alone:
                j, s = at + 1, here + unknown
                if j > reach:
                    best.append(-INFINITE)
                    back.append(0)
                    reach = j
                if s > best[j - base]:
                    best[j - base], back[j - base] = s, at
            at += 1
            cut = at if reach == at else base
            if cut == base and at >= look:  # once a piece's length, so the window is looked through in linear time
                cut, look = self._shared(back, base, at, reach), at + longest
            if cut > base:
                path, end = [], cut
                while end > base:
                    path.append(text[back[end - base] : end])
                    end = back[end - base]
                out += path[::-1]
                del best[: cut - base], back[: cut - base]
                base = cut
                look = max(look, base + 2 * longest)
        return out

    @staticmethod
    def _shared(back: list[int], base: int, at: int, reach: int) -> int:
        """The last boundary that the paths of all positions at .. reach share."""
        live = set(range(at, reach + 1))
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(max(back[top - base], base))
        return live.pop()


class Model:
    def __init__(self, path: str | None, proto: bytes | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path) if proto is None else sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.sp, n = sp, sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        scores = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.viterbi = Viterbi(scores, min(scores.values(), default=0.0) - UNKNOWN_PENALTY)
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) < 256:
            self.bytes = {}
        #: What each id stands for, as bytes of the normalised text.
        self.values = [b"" if sp.is_control(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.encode() for i, p in enumerate(self.pieces)]
        inside = {c for p in scores if len(p) > 1 for c in p}
        crossed = any(SPACE in p.lstrip(SPACE) for p in scores)
        # a run: a character that no longer piece holds, or spaces and what follows up to the next space
        held = "".join(map(re.escape, sorted(inside - {SPACE})))
        self.runs = re.compile(f"[^{held}{SPACE}]|{SPACE}*[{held}]+|{SPACE}+") if held and not crossed else None
        self.cache: dict[str, bytes] = {}

    def _run(self, run: str) -> bytes:
        out: list[int] = []
        for piece in self.viterbi.segment(run):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(self.sp.unk_id())
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian 32-bit numbers."""
        text = self.sp.normalize(text) if text else ""
        if self.runs is None:
            return self._run(text)
        runs = self.runs.findall(text)
        cache = self.cache
        try:
            return b"".join([cache[r] for r in runs])
        except KeyError:
            if len(cache) > CACHE_RUNS:
                cache.clear()
            for r in set(runs).difference(cache):
                cache[r] = self._run(r)
            return b"".join([cache[r] for r in runs])

    def decode(self, ids) -> str:
        """The text of ids: spaces again, and without the one that normalising put in front."""
        values = self.values
        text = b"".join([values[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@functools.cache
def model(path: str) -> Model:
    return Model(path)


def encode_documents(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, text_crc32): the ids of each text, and the checksum of the text itself."""
    path = path or vocabulary_path("piece_bpe_32k.model")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            coded = [m.encode(x or "") for x in texts]
            ends = np.cumsum([0, *(len(x) // 4 for x in coded)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([zlib.crc32((x or "").encode()) for x in texts], pa.int64())], names=["doc_id", "ids", "text_crc32"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ENCODED)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text, n_ids, ids_crc32, text_crc32) from encode_documents' rows."""
    path = path or vocabulary_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            col = batch.column(1)
            at, flat = col.offsets.to_numpy(), col.values.to_numpy()
            each = [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.decode(x.tolist()) for x in each], pa.string()), pa.array([len(x) for x in each], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64()), batch.column(2)], names=["doc_id", "text", "n_ids", "ids_crc32", "text_crc32"])

    return encoded.mapInArrow(run, DECODED)
