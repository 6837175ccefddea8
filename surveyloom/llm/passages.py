"""What the two passage operators share: words, windows, phrases that recur.

Words are runs of anything but white space, unchanged. A window is ``WINDOW``
words of a document in a row. A window keeps the k-gram with the least hash, its
phrase, so equal windows keep equal phrases and windows whose phrase occurs in
one document only cannot recur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.words import WHITE, Words, list_column, minimisers, range_hashes, slices, split_words, text_bytes
from surveyloom.plans.scratch import discard, materialize, release_shuffles

WINDOW = 50
PHRASE = 8
KEY = ("doc_id", "text_hash")

SPAN_TYPE = "array<struct<begin:int,end:int,owner:long>>"
SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("owner", pa.int64())]))

_WINDOW_BASE = 0xD6E8FEB86659FD93


def prepared(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text); documents are known by the first two, so rows that repeat share their fate."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def window_hashes(words: Words, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of each run, and how many come before each run's."""
    starts = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return range_hashes(words.hashes, starts, starts + WINDOW, _WINDOW_BASE), np.concatenate([[0], np.cumsum(count)])


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        for lo, hi in slices(offsets):
            words = split_words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], WHITE)
            runs = minimisers(words, PHRASE, WINDOW)
            joined, begin, end = words.joined()
            digests = [
                hashlib.sha256(joined[begin[a]:end[b - 1]] if b > a else b"").hexdigest()
                for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)]
            # One entry for each phrase of a document, at its first place.
            order = np.lexsort((runs.place, runs.gram, runs.text))
            text, gram, place = runs.text[order], runs.gram[order], runs.place[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
            text, gram, place = text[new], gram[new], place[new] - words.bounds[text[new]]
            bounds = np.searchsorted(text, np.arange(hi - lo + 1))
            entries = pa.StructArray.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(place.astype(np.int32))], names=["gram", "place"])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                pa.array(np.diff(words.bounds), pa.int64()), pa.array(digests), list_column(entries, bounds),
            ], names=["doc_id", "text_hash", "n_words", "words_sha256", "phrases"])


def read_phrases(docs: DataFrame) -> DataFrame:
    """One stored row per document: its key, n_words, the digest of its words and its windows' phrases."""
    return materialize(prepared(docs).mapInArrow(
        _phrases, "doc_id long, text_hash long, n_words long, words_sha256 string, phrases array<struct<gram:long,place:int>>"),
        "phrases")


def recurring(read: DataFrame) -> DataFrame:
    """(doc_id, text_hash, phrases): for documents with phrases that other documents have too, those phrases.

    Counting combines map-side; a phrase that a third of the documents hold is
    one row of the counts. These are stored, so that the join has nothing but
    shuffled rows below it and Spark can split a hot phrase. The result is stored
    too: what was shuffled for it is gone before whole texts are. Documents with
    a null doc_id take no part.
    """
    each = read.filter("doc_id is not null").select(*KEY, F.explode("phrases").alias("p")).select(*KEY, "p.gram", "p.place")
    shared = materialize(each.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("gram"), "shared")
    found = materialize(
        each.join(shared, "gram").groupBy(*KEY).agg(F.collect_set(F.struct("gram", "place")).alias("phrases")), "recurring")
    discard(shared)
    release_shuffles(read.sparkSession)
    return found


def repeated_starts(windows: DataFrame, run: tuple[str, ...]) -> DataFrame:
    """(doc_id, text_hash, run columns, start, size, owner) of windows that a smaller doc_id also has, given (…, gram, hash, start)."""
    owners = materialize(windows.groupBy("gram", "hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter(
        "owner < last").select("gram", "hash", "owner"), "owners")
    return windows.join(owners, ["gram", "hash"]).filter("doc_id > owner").select(
        *KEY, *run, "start", F.lit(1).alias("size"), "owner")


def with_least_owner(copies: DataFrame, found: DataFrame, run: tuple[str, ...]) -> DataFrame:
    """Copies of a run with the least doc_id that holds one of its windows: its first owner, or one found for a window."""
    least = materialize(found.groupBy(*run).agg(F.min("owner").alias("_least")), "least-owners")
    return copies.join(least, list(run), "left").withColumn("owner", F.least("owner", "_least")).select(*KEY, "start", "size", "owner")


def spans_of(starts: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans): per document the sorted (start, windows, owner) entries."""
    return starts.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("start", "size", "owner"))).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int, int]]:
    """Maximal (first word, one past the last, least owner) covered by entries sorted by start."""
    found: list[list[int]] = []
    for s in spans:
        begin, end = s["start"], s["start"] + s["size"] + WINDOW - 1
        if found and begin <= found[-1][1]:
            found[-1][1] = max(found[-1][1], end)
            found[-1][2] = min(found[-1][2], s["owner"])
        else:
            found.append([begin, end, s["owner"]])
    return [tuple(f) for f in found]


def span_rows(cut: list[tuple[int, int, int]]) -> list[dict]:
    return [{"begin": b, "end": e, "owner": o} for b, e, o in cut]
