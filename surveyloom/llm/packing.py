"""Pack tokenised documents into sequences by the sum-of-squares rule, online."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.bpe import encoder
from surveyloom.llm.words import slices, text_bytes

CAPACITY = 2048
END_ID = 1
OPEN_WINDOWS = 4096  # open windows a task may hold; beyond, they are closed like at the end of the task

_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_SEQUENCE_BITS = 33


class Packer:
    """Windows of ``capacity`` ids, of which each keeps its fill level.

    ``levels[h]`` counts the open windows filled up to h. An item of s ids goes
    into the level that makes the sum of the squares of these counts least after
    the move; level 0 stands for a new window and a window that gets full leaves
    the table. So no level collects many windows and gaps of every size stay rare.
    """

    def __init__(self, capacity: int, limit: int = OPEN_WINDOWS):
        self.capacity, self.limit = capacity, limit
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(capacity)]
        self.count = 0

    def level_for(self, size: int) -> int:
        """Change of the sum of squares for each level: 2 (N[h + s] - N[h]) + 2, without the part that does not apply."""
        last = self.capacity - size
        change = np.zeros(last + 1, np.int64)
        change[:] = 2 * self.levels[size:] + 1
        change[-1] = 0
        change[1:] += 1 - 2 * self.levels[1:last + 1]
        change[1:][self.levels[1:last + 1] == 0] = np.iinfo(np.int64).max
        least = change.min()
        return int(np.flatnonzero(change == least)[-1])

    def place(self, piece: tuple, size: int) -> Iterator[list[tuple]]:
        """Place a piece; a window that gets full is returned."""
        level = self.level_for(size)
        window = [] if level == 0 else self.open[level].pop()
        if level:
            self.levels[level] -= 1
            self.count -= 1
        window.append(piece)
        if level + size == self.capacity:
            yield window
            return
        self.open[level + size].append(window)
        self.levels[level + size] += 1
        self.count += 1
        if self.count > self.limit:
            yield from self.close()

    def close(self) -> Iterator[list[tuple]]:
        """Close all open windows: the emptiest are cut up to fill the fullest, so one may stay short."""
        windows = [(h, w) for h in range(self.capacity - 1, 0, -1) for w in self.open[h]]
        self.open = [[] for _ in range(self.capacity)]
        self.levels[:] = 0
        self.count = 0
        loose: list[tuple] = []
        front, back = 0, len(windows) - 1
        while front <= back:
            fill, window = windows[front]
            front += 1
            while fill < self.capacity and (loose or front <= back):
                if not loose:
                    loose = windows[back][1]
                    back -= 1
                doc_id, start, ids, total = loose.pop()
                room = self.capacity - fill
                if len(ids) // 4 > room:
                    loose.append((doc_id, start + room, ids[4 * room:], total))
                    ids = ids[:4 * room]
                window.append((doc_id, start, ids, total))
                fill += len(ids) // 4
            yield window
        if loose:  # what is left of one window
            yield loose


def _pack(path: str, capacity: int, limit: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = encoder(path), Packer(capacity, limit)
        sequence = TaskContext.get().partitionId() << _SEQUENCE_BITS
        end = np.array([END_ID], "<u4").tobytes()
        rows: list[tuple] = []

        def write(window: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc_id, start, ids, total in window:
                rows.append((doc_id, start, len(ids) // 4, ids, total, sequence, offset))
                offset += len(ids) // 4
            sequence += 1

        def table() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            made = pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _PIECES.split(", ")])
            rows.clear()
            return made

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets):
                part, begin = data[offsets[lo]:offsets[hi]].tobytes(), offsets[lo:hi + 1] - offsets[lo]
                for i, doc_id in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                    ids = tokens.encode_marked(part[begin[i]:begin[i + 1]]) + end
                    total = len(ids) // 4
                    whole = total - total % capacity
                    for start in range(0, whole, capacity):
                        write([(doc_id, start, ids[4 * start:4 * (start + capacity)], total)])
                        if len(rows) >= 2000:
                            yield table()
                    if whole < total:
                        for window in packer.place((doc_id, whole, ids[4 * whole:], total), total - whole):
                            write(window)
                    if len(rows) >= 2000:
                        yield table()
            pa.default_memory_pool().release_unused()
        tokens.forget()
        for window in packer.close():
            write(window)
        yield table()
    return pack


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence.

    A document is the byte-level BPE ids of its whole text, as the library of the
    tokenizer gives them (so the string of a special token is that token), then
    ``END_ID``; a null text is empty. Full stretches of ``capacity`` ids are sequences of their
    own, the rest goes to the packer of the task. ids holds unsigned 32-bit
    little-endian numbers; sequences are unique over all tasks; offset and
    length lie within the sequence, which is to be padded to ``capacity``. Each
    task leaves at most one sequence short, and one more each time that more than
    ``open_windows`` are open, which are then closed like at its end. Rows with a null doc_id and repeated
    rows are packed like others. An empty table gives no rows. ``vocabulary`` is
    the path of the tokenizer's file, which every executor can read.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(vocabulary, capacity, open_windows), _PIECES)
