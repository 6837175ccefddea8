"""Substring dedup with a sparse suffix array.

Only suffixes that begin at content-selected places are kept: of every window
of words the phrase with the least hash, so equal passages keep suffixes at equal
places. Those whose phrase recurs are sorted as text over the whole cluster,
which puts equal beginnings next to each other. Each suffix is compared with its
neighbours: the longest common prefix says how far a match can reach to the
right. Suffixes that are equal with all that stands left of them belong to the
first in order. For the others the match is extended to the left: the windows
around the place, as far right as a neighbour allows, are compared by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.passages import (
    KEY, PHRASE, SPAN_TYPE, SPANS, WINDOW, merged, prepared, read_phrases, recurring, repeated_starts, span_rows, spans_of,
    with_least_owner,
)
from surveyloom.llm.words import WHITE, minimisers, slices, split_words, text_bytes, word_places
from surveyloom.plans.scratch import discard, materialize, release_shuffles

_SUFFIXES = "suffix binary, left binary, n int, first int, doc_id long, text_hash long"
_COMPARED = "doc_id long, text_hash long, start int, size int, owner long, head_hash long, head_first int, gram long, hash long"
# Bytes of a suffix by which suffixes are dealt to partitions, with the doc_id: what the sampling for it sends stays small.
BEGINNING = 32


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each suffix kept: its words and those left of it, as far as its windows reach."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        lists = batch.column(3)
        known = lists.flatten().field(0).to_numpy()
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        for lo, hi in slices(offsets):
            words = split_words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], WHITE)
            runs = minimisers(words, PHRASE, WINDOW)
            joined, begin, end = words.joined()
            of_text = [set(known[bounds[i]:bounds[i + 1]].tolist()) for i in range(lo, hi)]
            grams = runs.gram.view(np.int64).tolist()
            kept = np.array([i for i, (t, g) in enumerate(zip(runs.text.tolist(), grams, strict=True)) if g in of_text[t]], np.int64)
            first, count, place, owner = runs.first[kept], runs.count[kept], runs.place[kept], runs.text[kept]
            a, p, b = begin[first].tolist(), begin[place].tolist(), (end[first + count + WINDOW - 2] + 1).tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array([joined[i:j] for i, j in zip(p, b, strict=True)], pa.binary()),
                pa.array([joined[i:j] for i, j in zip(a, p, strict=True)], pa.binary()),
                pa.array(count.astype(np.int32)), pa.array((first - words.bounds[owner]).astype(np.int32)),
                batch.column(0).take(pa.array(owner + lo)), batch.column(1).take(pa.array(owner + lo)),
            ], names=[c.split()[0] for c in _SUFFIXES.split(", ")])


def _common_words(a: bytes, b: bytes) -> int:
    """Words that two suffixes begin with; every word ends with a space."""
    if a == b:
        return a.count(b" ")
    short = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, short), np.frombuffer(b, np.uint8, short)
    apart = np.flatnonzero(x != y)
    return a[:apart[0] if len(apart) else short].count(b" ")


def _windows(suffix: bytes, left: bytes, n: int, reach: int) -> Iterator[tuple[int, bytes]]:
    """(i, words) of the windows of a suffix that go at most ``reach`` words to the right of its place."""
    whole = left + suffix
    ends = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32).tolist()
    starts = [0, *[e + 1 for e in ends]]
    before = left.count(b" ")
    for i in range(min(n, reach - WINDOW + before + 1)):
        yield i, whole[starts[i]:ends[i + WINDOW - 1]]


class _Class:
    """Suffixes that are equal with all that stands left of them; all rows of its first document are heads."""

    def __init__(self, key: tuple[bytes, bytes, int], head: tuple[int, int, int], reach: int):
        self.key, self.heads, self.reach = key, [head], reach

    def rows(self, reach: int) -> Iterator[tuple]:
        suffix, left, n = self.key
        for i, window in _windows(suffix, left, n, reach):
            digest = xxhash.xxh3_128_intdigest(window)
            high, low = ((part ^ 1 << 63) - (1 << 63) for part in (digest >> 64, digest & (1 << 64) - 1))
            for doc_id, text_hash, first in self.heads:
                yield (doc_id, text_hash, first + i, None, doc_id, text_hash, first, high, low)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes against their neighbours.

    Classes that begin like the first or the last one of a partition can have
    neighbours in the next one; their matches count as reaching all the way.
    """
    rows: list[tuple] = []
    waiting: list[_Class] = []  # classes with one beginning, until the next beginning shows that it is not the last
    whole = True  # whether the classes waiting have to count as reaching all the way

    def table() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                          names=[c.split()[0] for c in _COMPARED.split(", ")])

    def settle(classes: list[_Class]) -> Iterator[pa.RecordBatch]:
        for one in classes:
            rows.extend(one.rows(WINDOW if whole else one.reach))
            if len(rows) > 20_000:
                yield table()

    for batch in batches:
        for suffix, left, n, first, doc_id, text_hash in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            last = waiting[-1] if waiting else None
            if last is not None and last.key == (suffix, left, n):
                if doc_id == last.heads[0][0]:
                    last.heads.append((doc_id, text_hash, first))
                else:
                    rows.append((doc_id, text_hash, first, n, *last.heads[0], None, None))
                continue
            reach = 0
            if last is not None:
                reach = _common_words(suffix, last.key[0])
                last.reach = max(last.reach, reach)
                if suffix[:BEGINNING] != last.key[0][:BEGINNING]:
                    yield from settle(waiting)
                    waiting, whole = [], False
            waiting.append(_Class((suffix, left, n), (doc_id, text_hash, first), reach))
        if len(rows) > 20_000:
            yield table()
    whole = True
    yield from settle(waiting)
    yield table()


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans): for each document with words to remove, (start, size, owner) of its repeated windows."""
    read = read_phrases(docs)
    phrases = recurring(read)
    discard(read)
    suffixes = materialize(prepared(docs).join(phrases, list(KEY)).mapInArrow(_select, _SUFFIXES), "suffixes")
    # The texts shuffled for them go before they are shuffled themselves.
    discard(phrases)
    release_shuffles(docs.sparkSession)
    order = ("suffix", "left", "n", "doc_id", "text_hash", "first")
    compared = materialize(
        suffixes.repartitionByRange(F.substring("suffix", 1, BEGINNING), "doc_id").sortWithinPartitions(*order)
        .mapInArrow(_compare, _COMPARED), "compared")
    discard(suffixes)
    release_shuffles(docs.sparkSession)
    run = ("head_doc", "head_hash", "head_first")
    rows = compared.withColumn("head_doc", F.col("owner"))
    settled = rows.filter("size is not null").select(*KEY, *run, "start", "size", "owner")
    opened = rows.filter("size is null").select(*KEY, *run, "gram", "hash", "start")
    found = materialize(repeated_starts(opened, run), "repeated-starts")
    spans = materialize(spans_of(found.select(*KEY, "start", "size", "owner").unionByName(with_least_owner(settled, found, run))), "spans")
    discard(compared, found)
    release_shuffles(docs.sparkSession)
    return spans


def _without(text: str, spans: list[dict]) -> tuple[str, list[dict], bool]:
    """The text without the words of the spans, the stretches cut, and whether a word is left."""
    raw, cut = text.encode(), merged(spans)
    starts, ends = word_places(np.frombuffer(raw, np.uint8), WHITE)
    parts, at = [], 0
    for begin, end, _ in cut:
        parts.append(raw[at:starts[begin]])
        at = int(ends[end - 1])
    left = len(starts) > sum(e - b for b, e, _ in cut)
    return (b"".join(parts) + raw[at:]).decode("utf-8", "replace"), span_rows(cut), left


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["text", "spans", "words_left"]
    for batch in batches:
        _, offsets = text_bytes(batch.column(0))
        for lo, hi in slices(offsets):
            part = batch.slice(lo, hi - lo)
            given = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
            made = [_without(text, spans) if spans else (text, [], True) for text, spans in given]
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), SPANS, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*columns, *part.columns[2:]], names=[*names, *batch.schema.names[2:]])
        pa.default_memory_pool().release_unused()


def cut_repeats(docs: DataFrame, spans_as: str = "spans", words_left_as: str = "words_left") -> DataFrame:
    """All rows and columns of ``docs`` with repeated passages cut out of ``text``, and two new columns.

    A word goes if a window of ``WINDOW`` words covers it that also stands in a
    document with a smaller doc_id. White space around what is cut stays. spans
    are (begin, end, owner) in words; words_left is false if a text lost all its
    words; both can be renamed. A null, wordless or short text stays as it is, and so does one with a
    null doc_id, which is no source for others either; rows with equal ids are not
    held against each other. An empty table gives no rows. The new columns must
    not have names that ``docs`` has.
    """
    spans = repeated_spans(docs)
    others = [c for c in docs.columns if c != "text"]
    keyed = docs.select("text", *[F.col(c).alias(f"_c{i}") for i, c in enumerate(others)],
                        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    rows = keyed.join(spans, list(KEY), "left").select("text", "spans", *[f"_c{i}" for i in range(len(others))])
    kinds = dict(docs.dtypes)
    carried = "".join(f", _c{i} {kinds[c]}" for i, c in enumerate(others))
    cut = rows.mapInArrow(_cut, f"text string, spans {SPAN_TYPE}, words_left boolean{carried}")
    back = {c: F.col(f"_c{i}").alias(c) for i, c in enumerate(others)} | {"text": F.col("text")}
    return cut.select(*[back[c] for c in docs.columns], F.col("spans").alias(spans_as), F.col("words_left").alias(words_left_as))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, span_start, span_words and first_doc_id: a row for each stretch of words that ``cut_repeats`` would cut.

    Stretches are the same for rows of equal id and text, and are given once.
    first_doc_id is the least doc_id that also holds a window of the stretch.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(d, b, e - b, o) for d, s in zip(*(c.to_pylist() for c in batch.columns), strict=True) for b, e, o in merged(s)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)],
                                             names=["doc_id", "span_start", "span_words", "first_doc_id"])
    return repeated_spans(docs).select("doc_id", "spans").mapInArrow(
        rows, "doc_id long, span_start long, span_words long, first_doc_id long")
