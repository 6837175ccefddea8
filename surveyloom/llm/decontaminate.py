"""Benchmark decontamination by winnowing.

Of every window of ten words the k-gram with the least hash is kept, so an item
and a document that share ten words in a row keep the same k-gram there. Kept
k-grams of documents pass a filter of fixed size made from those of the items;
for the few that pass, the windows around them are written out and joined to
the windows of the items by their words, which extends a hit to the whole shared
span and drops false ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.words import NOT_ALNUM, Words, gram_hashes, minimisers, mix, slices, split_words, text_bytes
from surveyloom.plans.scratch import materialize

WINDOW = 10
GRAM = 5
FILTER_BITS = 1 << 23  # 1 MB whatever the benchmark's size; a fuller filter only lets more k-grams through to the join
PROBES = 3

_WINDOWS = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("words", pa.string())]))


def _probe(grams: np.ndarray, size: int, probe: int) -> np.ndarray:
    """The bit a k-gram of ``size`` words sets or asks for."""
    return mix(grams + np.uint64(size * PROBES + probe)) & np.uint64(FILTER_BITS - 1)


def _kept(words: Words, sizes: list[int]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words in a window, text, first window, windows, k-gram) for full windows and each shorter size."""
    runs = minimisers(words, GRAM, WINDOW)
    kept = [(WINDOW, runs.text, runs.first, runs.count, runs.gram)]
    text = words.text_of()
    for size in sizes:
        grams = gram_hashes(words, size)
        at = np.flatnonzero(text[:len(grams)] == text[size - 1:]) if len(grams) else np.zeros(0, np.int64)
        kept.append((size, text[at], at, np.ones(len(at), np.int64), grams[at]))
    return kept


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, size, words, bits): each window of an item, bits on the first window that keeps a k-gram."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        ids, rows = batch.column(0).to_pylist(), []
        for lo, hi in slices(offsets):
            words = split_words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], NOT_ALNUM, lower=True)
            joined, begin, end = words.joined()
            lengths = np.diff(words.bounds)
            short = sorted({int(n) for n in lengths if 0 < n < WINDOW})
            for size, text, first, count, gram in _kept(words, short):
                bits = np.stack([_probe(gram, size, p) for p in range(PROBES)], axis=1).astype(np.int64)
                for i in range(len(text)):
                    if size < WINDOW and lengths[text[i]] != size:
                        continue
                    for s in range(first[i], first[i] + count[i]):
                        rows.append((ids[lo + text[i]], size, joined[begin[s]:end[s + size - 1]].decode("utf-8", "replace"),
                                     bits[i].tolist() if s == first[i] else []))
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
            pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.list_(pa.int64())),
        ], names=["item_id", "size", "words", "bits"])


def _filter(items: DataFrame) -> np.ndarray:
    """The bits of all items' k-grams; at most FILTER_BITS / 64 numbers reach the driver."""
    bits = items.select(F.explode("bits").alias("bit")).select(
        F.shiftright("bit", 6).alias("at"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
    rows = bits.groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    field = np.zeros(FILTER_BITS // 64, np.int64)
    field[rows.column("at").to_numpy()] = rows.column("mask").to_numpy()
    return field.view(np.uint64)


def _document_rows(shared, sizes: list[int]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets):
                words = split_words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], NOT_ALNUM, lower=True)
                found: list[list[tuple[int, int, str]]] = [[] for _ in range(hi - lo)]
                joined = None
                for size, text, first, count, gram in _kept(words, sizes):
                    passed = np.arange(len(gram))
                    for p in range(PROBES):
                        bit = _probe(gram[passed], size, p)
                        passed = passed[(field[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
                    if len(passed) and joined is None:
                        joined, begin, end = words.joined()
                    for i in passed:
                        for s in range(first[i], first[i] + count[i]):
                            window = joined[begin[s]:end[s + size - 1]].decode("utf-8", "replace")
                            found[text[i]].append((s - int(words.bounds[text[i]]), size, window))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.diff(words.bounds), pa.int64()),
                    pa.array([[dict(zip(("start", "size", "words"), w, strict=True)) for w in f] for f in found], _WINDOWS),
                ], names=["doc_id", "text_hash", "n_words", "windows"])
    return scan


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, n_words, spans, item_ids.

    Words are runs of digits, letters and non-ASCII characters of the text with
    A-Z lower-cased. A window is ten words of an item in a row; an item of
    fewer words is one window. spans are the (start, size) in words of the
    windows that occur in the document, item_ids the sorted ids, as strings, of
    the items they belong to. Null or wordless texts have no words; items
    without words or with a null id are left out; an id that repeats is one item with
    all its rows' windows. Repeated documents are judged each on its own. Other
    columns are not looked at. Without documents there are no rows, without
    items no spans.
    """
    spark = docs.sparkSession
    windows = materialize(
        items.filter("item_id is not null").select(F.col("item_id").cast("long"), "text")
        .mapInArrow(_item_rows, "item_id long, size int, words string, bits array<long>"), "item-windows")
    sizes = sorted(r["size"] for r in windows.filter(F.col("size") < WINDOW).select("size").distinct().collect())  # below WINDOW
    field = spark.sparkContext.broadcast(_filter(windows))
    read = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
            _document_rows(field, sizes), "doc_id long, text_hash long, n_words long, windows array<struct<start:int,size:int,words:string>>")
        .withColumn("row", F.monotonically_increasing_id()), "document-windows")
    hits = (
        read.select("row", F.explode("windows").alias("w")).select("row", "w.start", "w.size", "w.words")
        .join(windows.select("size", "words", "item_id").distinct(), ["size", "words"])
        .groupBy("row").agg(F.collect_set(F.struct("start", "size")).alias("spans"),
                            F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    return read.drop("windows").join(hits, "row", "left").select(
        "doc_id", "text_hash", "n_words",
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,size:int>>)")).alias("spans"),
        F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"))


def covered(spans: str) -> Column:
    """How many words an array of (start, size) covers."""
    return F.expr(
        f"aggregate(array_sort({spans}), named_struct('n', 0L, 'to', 0), (a, s) -> named_struct("
        "'n', a.n + cast(greatest(0, s.start + s.size - greatest(a.to, s.start)) as bigint), "
        "'to', greatest(a.to, s.start + s.size)), a -> a.n)")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of the result of ``contamination``."""
    return found.select(
        "doc_id", "n_words", covered("spans").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
