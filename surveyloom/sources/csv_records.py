"""Records of CSV files whose cells may hold line breaks, whatever the splits the files are read in.

A quotation mark opens or closes a quoted stretch (one inside is written twice),
so a record ends with a line up to which the marks are even. Whether a split
begins inside a stretch depends on all splits before it, but only through the
parity of their marks, and parities add up:

1. Each split reports its parity, and how many records begin in it for either
   state it may begin in.
2. A prefix pass over the splits of a file settles every state, and numbers the
   records.
3. Splits are read again, now each knowing its state. Records that lie in one
   split are finished there; only the pieces of those that cross splits are
   shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyloom.functions.numeric import BLANK_CHARACTERS
from surveyloom.plans.scratch import materialize

_QUOTE = ord('"')
_SPLITS = "file string, block long, odd long, begin_outside long, begin_inside long"
# Pieces: a whole record, or the first, a middle or the last piece of one that crosses splits.
_WHOLE, _FIRST, _MIDDLE, _LAST = range(4)
_PIECES = "split long, piece int, place long, cells long, marks long, filled boolean, text string"


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column without nulls, and the n + 1 offsets of its values."""
    _, marks, data = column.buffers()
    offsets = np.frombuffer(marks, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def _per_line(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the lines of each input split, in order."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: list | None = None  # key, then the columns of a split

    def row(found: list) -> pa.RecordBatch:
        kinds = (pa.string(), *[pa.int64()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(found[1:], kinds, strict=True)],
                                          names=[c.split()[0] for c in _SPLITS.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(3).to_numpy()
        for a, b in _runs(keys):
            if known is None or known[0] != keys[a]:
                if known is not None:
                    yield row(known)
                known = [keys[a], batch.column(0)[a].as_py(), batch.column(1)[a].as_py(), 0, 0, 0]
            data, offsets = _bytes_of(batch.column(2).slice(a, b - a))
            marks = _per_line(data == _QUOTE, offsets)
            before = (known[3] + np.cumsum(marks) - marks) & 1
            empty = np.diff(offsets) == 0
            known[4] += int(((before == 0) & ~empty).sum())
            known[5] += int(((before == 1) & ~empty).sum())
            known[3] = int((known[3] + marks.sum()) & 1)
    if known is not None:
        yield row(known)


def splits(spark: SparkSession, path: str) -> DataFrame:
    """One row per input split: file, block, split, inside, onward and before.

    ``inside`` says whether the split begins within a quoted stretch, ``onward``
    whether the next one of the file does, ``before`` how many records of the
    file begin earlier.
    """
    lines = _split_lines(spark, path).withColumn("key", F.xxhash64("file", "block"))
    found = lines.mapInArrow(_summaries, _SPLITS)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2 == 1
    begun = F.when(F.col("inside"), F.col("begin_inside")).otherwise(F.col("begin_outside"))
    onward = (F.col("inside").cast("int") + F.col("odd")) % 2 == 1
    last = F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()
    settled = found.withColumn("inside", inside).withColumn("before", F.coalesce(F.sum(begun).over(earlier), F.lit(0)))
    return materialize(settled.select("file", "block", F.xxhash64("file", "block").alias("split"), "inside", (onward & ~last).alias("onward"), "before"), "splits")


class _Open:
    """A record that has begun and not ended yet: sums over its lines, and the lines if they are wanted."""

    def __init__(self, place: int, begun: bool):
        self.place, self.begun = place, begun
        self.cells = self.marks = 0
        self.filled = False
        self.lines: list[str] = []

    def add(self, cells: int, marks: int, filled: bool, lines: list[str]) -> None:
        self.cells, self.marks, self.filled = self.cells + cells, self.marks + marks, self.filled or filled
        self.lines += lines

    def row(self, split: int, piece: int, texts: bool) -> tuple:
        return split, piece, self.place, self.cells, self.marks, self.filled, "\n".join(self.lines) if texts else None


def _assemble(delimiter: str, texts: bool):
    mark, blanks = delimiter.encode(), {*BLANK_CHARACTERS, delimiter}
    void = np.zeros(256, bool)
    void[[ord(c) for c in blanks if ord(c[0]) < 128 and len(c) == 1]] = True
    names = [c.split()[0] for c in _PIECES.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())

    def facts(column: pa.Array, state: int) -> tuple[np.ndarray, ...]:
        """Of each line: state before and after, delimiters outside quotes, quotation marks, whether it holds anything."""
        data, offsets = _bytes_of(column)
        quote = data == _QUOTE
        outside = ((state + np.cumsum(quote)) & 1) == 0
        hit = outside & (data == mark[0])
        for i, byte in enumerate(mark[1:], 1):
            hit[:-i] &= data[i:] == byte
            hit[-i:] = False
        marks = _per_line(quote, offsets)
        after = (state + np.cumsum(marks)) & 1
        filled = _per_line(~void[data] & (data < 128), offsets) > 0
        for i in np.flatnonzero(~filled & (_per_line(data >= 128, offsets) > 0)).tolist():
            filled[i] = not blanks.issuperset(column[i].as_py())
        return (after - marks) & 1, after, _per_line(hit, offsets), marks, filled, np.diff(offsets) == 0

    def finished(split: int, lines: pa.Array, first: np.ndarray, last: np.ndarray, places: np.ndarray, *sums: np.ndarray) -> pa.RecordBatch:
        """The records from line ``first`` to line ``last``, all at once."""
        n, column = len(first), pa.nulls(len(first), pa.string())
        cells, marks, filled = (t[last + 1] - t[first] for t in (np.concatenate([[0], np.cumsum(x)]) for x in sums))
        if texts and n:
            data, offsets = _bytes_of(lines)
            used = np.zeros(len(lines) + 1, np.int64)
            np.add.at(used, first, 1)
            np.add.at(used, last + 1, -1)
            used = np.cumsum(used[:-1]) > 0
            size = np.where(used, np.diff(offsets) + 1, 0)  # a line and the break after it
            size[last] -= 1
            begin = np.cumsum(size) - size
            out = np.full(int(size.sum()), 10, np.uint8)
            keep = np.repeat(used, np.diff(offsets))
            out[(np.repeat(begin - offsets[:-1], np.diff(offsets)) + np.arange(len(data)))[keep]] = data[keep]
            bounds = np.append(begin[first], len(out)).astype(np.int32)
            column = pa.StringArray.from_buffers(n, pa.py_buffer(bounds.tobytes()), pa.py_buffer(out.tobytes()))
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, split)), pa.array(np.full(n, _WHOLE, np.int32)), pa.array(places), pa.array(cells + 1),
            pa.array(marks), pa.array(filled > 0), column], names=names)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, state, place, onward, open_ = None, 0, 0, False, None

        def left() -> list[tuple]:
            """What the end of a split leaves open; at the end of a file a record begun there is as whole as it gets."""
            if open_ is None:
                return []
            return [open_.row(split, _MIDDLE if not open_.begun else _FIRST if onward else _WHOLE, texts)]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            for a, b in _runs(keys):
                rows: list[tuple] = []
                if keys[a] != split:
                    rows += left()
                    split, place = int(keys[a]), 0
                    state, onward = int(batch.column(1)[a].as_py()), batch.column(2)[a].as_py()
                    open_ = _Open(0, False) if state else None
                lines = batch.column(3).slice(a, b - a)
                before, after, cells, marks, filled, empty = facts(lines, state)
                places = place + np.cumsum((before == 0) & ~empty)
                place, state = int(places[-1]), int(after[-1])
                begins = np.flatnonzero((before == 0) & ~empty)
                closes = np.flatnonzero((after == 0) & ~((before == 0) & empty))
                if open_ is not None:  # begun in an earlier batch or split
                    end = int(closes[0]) + 1 if len(closes) else b - a
                    open_.add(int(cells[:end].sum()), int(marks[:end].sum()), bool(filled[:end].any()), lines.slice(0, end).to_pylist() if texts else [])
                    if len(closes):
                        rows.append(open_.row(split, _WHOLE if open_.begun else _LAST, texts))
                        open_ = None
                which = np.searchsorted(closes, begins)
                done = which < len(closes)
                first, last = begins[done], closes[which[done]]
                yield finished(split, lines, first, last, places[first], cells, marks, filled)
                if not done.all():
                    at = int(begins[-1])
                    open_ = _Open(int(places[at]), True)
                    open_.add(int(cells[at:].sum()) + 1, int(marks[at:].sum()), bool(filled[at:].any()), lines.slice(at).to_pylist() if texts else [])
                if rows:
                    yield made(rows)
        if rows := left():
            yield made(rows)
    return assemble


def records(spark: SparkSession, path: str, delimiter: str = ",", texts: bool = True) -> DataFrame:
    """(file, number, cells, marks, filled, text): every record of the files, numbered from 1 in each.

    cells counts delimiters outside quotes, plus one; marks is the number of
    quotation marks, odd if the file ends before the record does; filled says whether there is
    anything but blanks and delimiters. text has its line breaks as \\n and is null
    without ``texts``: then a record takes no room however long it is. Empty lines
    between records are none.
    """
    known = splits(spark, path)
    # One row for each input split, so small beside the files whatever their size.
    here = F.broadcast(known.select("file", "block", "split", "inside", "onward"))
    lines = _split_lines(spark, path).join(here, ["file", "block"])
    asked = ["split", "inside", "onward", "value"]
    pieces = lines.select(*asked).mapInArrow(_assemble(delimiter, texts), _PIECES)
    numbered = F.broadcast(known.select("split", "file", "before"))
    columns = ["file", (F.col("before") + F.col("place")).alias("number"), "cells", "marks", "filled", "text"]
    whole = pieces.filter(F.col("piece") == _WHOLE).join(numbered, "split").select(*columns)
    if known.filter("inside").isEmpty():
        return whole
    # Only splits at whose ends a record goes on have pieces.
    torn = lines.filter("inside or onward").select(*asked).mapInArrow(_assemble(delimiter, texts), _PIECES).filter(F.col("piece") != _WHOLE)
    first = F.col("piece") == _FIRST
    placed = torn.join(F.broadcast(known.select("split", "file", "block", "before")), "split")
    in_order = Window.partitionBy("file").orderBy("block", first).rowsBetween(Window.unboundedPreceding, 0)
    spans = placed.withColumn("span", F.sum(first.cast("int")).over(in_order))
    parts = F.array_sort(F.collect_list(F.struct("block", "text")))
    joined = spans.groupBy("file", "span").agg(
        F.max(F.when(first, F.col("before") + F.col("place"))).alias("number"), F.sum("cells").alias("cells"), F.sum("marks").alias("marks"),
        F.bool_or("filled").alias("filled"), *([parts.alias("parts")] if texts else []))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n") if texts else F.lit(None).cast("string")
    return whole.unionByName(joined.select("file", "number", "cells", "marks", "filled", text.alias("text")))
