"""Chat transcripts assembled token by token, with loss masks.

Each segment, a role or a text, is encoded by itself; reserved ids beyond the
vocabulary mark where turns begin, where the role ends and where the turn ends.
So no text can forge a mark. Control strings inside segments are escaped before
encoding, which keeps the transcript safe as plain text too. Prefix sums over the
segments' lengths place every turn and its loss span in the conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.bpe import encoder

MARKS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")  # reserved ids: vocabulary size + 0, 1, 2
TRAINED_ROLE = "assistant"

_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURNS = "conv_id long, turn long, role string, ids binary, n_ids long, loss_from long, loss_ids long"
_READ = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def escape(text: str) -> str:
    """Put one backslash more between < and | wherever they meet: no control string is left."""
    return _OPEN.sub(lambda m: f"<\\{m[1]}|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}|", text)


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        start, sep, end = (np.array([tokens.size + i], "<u4").tobytes() for i in range(3))
        for batch in batches:
            conv, turn, roles, texts = (c.to_pylist() for c in batch.columns)
            rows = []
            for role, text in zip(roles, texts, strict=True):
                head = start + tokens.encode(escape(role or "").encode()) + sep
                body = tokens.encode(escape(text or "").encode())
                ids = head + body + end
                rows.append((ids, len(ids) // 4, len(head) // 4, len(body) // 4 if role == TRAINED_ROLE else 0))
            yield pa.RecordBatch.from_arrays([
                pa.array(conv, pa.int64()), pa.array(turn, pa.int64()), batch.column(2), pa.array([r[0] for r in rows], pa.binary()),
                *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)),
            ], names=[c.split()[0] for c in _TURNS.split(", ")])
    return encode


def assemble(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """The transcript of every conversation, one row for each turn, in order of (turn, role, text).

    conv_id, turn, position (from 0), ids (unsigned 32-bit little-endian
    numbers), begin (ids of the conversation before this turn), n_ids, loss_begin
    and loss_ids (the span of the conversation's ids to learn from: the text of
    an assistant turn, else no ids). Joining ids by position gives the whole
    transcript. Null role or text is empty; rows with a null conv_id are one
    conversation; repeated rows are turns of their own. An empty table gives no
    rows. Other columns are not looked at.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = rows.mapInArrow(_encode(vocabulary), _TURNS)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "ids")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    return turns.withColumn("position", F.row_number().over(order) - 1).withColumn("begin", begin).select(
        "conv_id", "turn", "position", "ids", "begin", "n_ids", (F.col("begin") + F.col("loss_from")).alias("loss_begin"), "loss_ids")


class _Reader:
    """Reads the ids of one conversation turn by turn and keeps running digests."""

    def __init__(self, conv_id: int | None, tokens):
        self.conv_id, self.tokens = conv_id, tokens
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.at = 0

    def add(self, ids: np.ndarray, loss_begin: int, loss_ids: int) -> None:
        size, decode = self.tokens.size, self.tokens.decode
        marks = np.flatnonzero(ids >= size)
        if ids[marks].tolist() != [size, size + 1, size + 2] or marks[0] != 0 or marks[2] != len(ids) - 1:
            raise ValueError(f"a turn of conversation {self.conv_id} is not start, role, separator, text, end")
        role, text = decode(ids[1:marks[1]].tobytes()), decode(ids[marks[1] + 1:-1].tobytes())
        self.chars += len(role) + len(text) + sum(map(len, MARKS))
        self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        learned = ids[loss_begin - self.at:loss_begin - self.at + loss_ids]
        learned = unescape(decode(learned.tobytes()))
        self.loss.update(learned.encode())
        self.loss_chars += len(learned)
        self.n += 1
        self.at += len(ids)

    def row(self) -> tuple:
        return (self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def _read(path: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, now, done = encoder(path), None, []

        def table() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            made = pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in done], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _READ.split(", ")])
            done.clear()
            return made

        for batch in batches:
            for conv, ids, loss_begin, loss_ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Reader(conv, tokens)
                now.add(np.frombuffer(ids, "<u4"), loss_begin, loss_ids)
            yield table()
        if now is not None:
            done.append(now.row())
        yield table()
    return read


def read_back(transcript: DataFrame, vocabulary: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the ids alone.

    The ids of a conversation stream through one task in order; digests are
    updated turn by turn, so its length does not matter for memory.
    formatted_chars counts the transcript as text, marks included.
    """
    rows = transcript.select("conv_id", "position", "ids", "loss_begin", "loss_ids").repartition("conv_id")
    ordered = rows.sortWithinPartitions("conv_id", "position").select("conv_id", "ids", "loss_begin", "loss_ids")
    return ordered.mapInArrow(_read(vocabulary), _READ)
