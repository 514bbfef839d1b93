"""Chat formatting by token-level assembly.

Each turn becomes  START role \\n content END \\n . The pieces are encoded apart from each other;
START and END are reserved ids beyond the vocabulary, spliced in as ids and never as text, so no
content can produce them. The loss mask covers the ids of assistant contents and is built by
prefix sums over the borders of the segments. In contents and roles the control strings are
escaped as well (a backslash goes after the ``<`` of each ``<|``, one more for each that is
there), so that the formatted text can be taken apart again.

Rows are dealt by conversation and sorted within partitions, then read as a stream: of a
conversation only its ids are held, and of a partition only a batch.

Defined results: null text or role is empty, null conv_id is a conversation of its own; turns
order by (turn, role, text), so repeated rows all count and ties are settled; an empty table
gives no rows. Columns other than the four are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import small_batches
from glossmill.llm.tokens import byte_bpe, vocabulary_path

# The control strings of the template.
START, END, LEARN = "<|im_start|>", "<|im_end|>", "assistant"
FORMATTED = "conv_id bigint, n_turns bigint, formatted string, ids array<int>, loss_mask array<tinyint>"
READ_BACK = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_ids bigint, n_loss_ids bigint"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on a line of its own."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(turns: list[tuple[str, str]], encode, start: int, end: int) -> tuple[list[int], np.ndarray]:
    """Ids and loss mask of (role, text) turns."""
    ids: list[int] = []
    borders: list[tuple[int, int]] = []
    line_end = encode("\n")
    for role, text in turns:
        ids.append(start)
        ids += encode(escape_role(role) + "\n")
        content = encode(escape(text))
        if role == LEARN and content:
            borders.append((len(ids), len(ids) + len(content)))
        ids += content
        ids.append(end)
        ids += line_end
    steps = np.zeros(len(ids) + 1, np.int8)
    for i, j in borders:
        steps[i] += 1
        steps[j] -= 1
    return ids, np.cumsum(steps[:-1], dtype=np.int8)


def format_conversations(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row for each conversation: its text, its ids and the mask of the ids to learn from."""
    path = vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")
    small_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(path)
        start, end = encoder.n_vocab, encoder.n_vocab + 1
        now: tuple | None = None
        turns: list[tuple[str, str]] = []

        def row():
            ids, mask = assemble(turns, encoder.encode_ordinary, start, end)
            text = "".join(f"{START}{escape_role(r)}\n{escape(t)}{END}\n" for r, t in turns)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([len(turns)], pa.int64()), pa.array([text]), pa.array([np.array(ids, np.int32)], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.int8()))], names=["conv_id", "n_turns", "formatted", "ids", "loss_mask"])

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now != (conv,):
                    if turns:
                        yield row()
                    now, turns = (conv,), []
                turns.append((role or "", text or ""))
        if turns:
            yield row()

    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Digests of the turns and of the text under the mask, taken from the ids and mask alone."""
    path = vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(path)
        start, end = encoder.n_vocab, encoder.n_vocab + 1
        for batch in batches:
            out = []
            for conv, formatted, ids, mask in zip(*(batch.column(c) for c in ("conv_id", "formatted", "ids", "loss_mask")), strict=True):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                begins, ends = np.flatnonzero(ids == start), np.flatnonzero(ids == end)
                turns, learned, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for i, j in zip(begins, ends, strict=True):
                    role, _, text = encoder.decode_bytes(ids[i + 1 : j].tolist()).decode().partition("\n")
                    turns.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                    n += 1
                    if mask[i:j].any():
                        said = unescape(encoder.decode_bytes(ids[i:j][mask[i:j] == 1].tolist()).decode())
                        learned.update(said.encode())
                        chars += len(said)
                out.append((conv.as_py(), n, turns.hexdigest(), chars, learned.hexdigest(), len(formatted.as_py()), len(ids), int(mask.sum())))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_ids", "n_loss_ids"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=names)

    return formatted.mapInArrow(run, READ_BACK)
