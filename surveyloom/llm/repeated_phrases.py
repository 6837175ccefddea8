"""Substring dedup with automata of recurring phrases.

1. Every window of a document keeps its phrase; phrases are counted over the
   corpus and those that two documents or more hold are confirmed as recurring.
2. Documents that hold one are dealt into shards, together with the phrases
   confirmed for them. Each shard compiles an Aho-Corasick automaton and streams
   its documents through it, which locates every occurrence; nothing else says where
   one is. A window belongs to the occurrence in it whose phrase hashes least: in a
   window that recurs that is the phrase it keeps, in every shard. Runs of windows at
   the same occurrence are reported with a hash of all their words.
3. Runs that are equal as a whole are settled by their least doc_id. Only the
   runs of that document are opened into windows and compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.passages import (
    KEY, PHRASE, SPAN_TYPE, SPANS, WINDOW, merged, prepared, read_phrases, recurring, repeated_starts, span_rows, spans_of,
    window_hashes, with_least_owner,
)
from surveyloom.llm.words import WHITE, list_column, minimisers, mix, range_hashes, slices, split_words, text_bytes
from surveyloom.plans.scratch import discard, materialize, release_shuffles

_RUN_BASE = 0x9FB21C651E98DF25
SHARD_BYTES = 1 << 19

_RUNS = "doc_id long, text_hash long, gram long, block long, first int, n int, hashes array<long>"
_RUN = ("gram", "block")
_CHANGED = f"doc_id long, n_words long, n_removed long, kept_sha256 string, spans {SPAN_TYPE}, kept string"


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        lists = batch.column(3)
        places = lists.flatten().field(1).to_numpy()
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        for lo, hi in slices(offsets, SHARD_BYTES):
            words = split_words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], WHITE)
            joined, begin, end = words.joined()
            text = f" {joined.decode('latin-1')}"  # one letter for each byte; words are framed by spaces
            owner = np.repeat(np.arange(lo, hi), np.diff(bounds[lo:hi + 1]))
            at = words.bounds[owner - lo] + places[bounds[lo]:bounds[hi]]
            shard = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for i in at.tolist():
                shard.add_word(text[begin[i]:end[i + PHRASE - 1] + 2])
            shard.make_automaton()
            # A phrase ends with the space after its last word, and lies in one text.
            spaces = np.fromiter((last for last, _ in shard.iter(text)) if len(at) else (), np.int64)
            del shard, text, joined
            hit = np.searchsorted(end + 1, np.unique(spaces)) - PHRASE + 1
            text_of = words.text_of()
            hit = hit[text_of[hit] == text_of[hit + PHRASE - 1]]
            runs = minimisers(words, PHRASE, WINDOW, hit)
            first, count, place, owner = runs.first, runs.count, runs.place, runs.text
            hashes, marks = window_hashes(words, first, count)
            shape = ((place - first) * WINDOW + count).astype(np.uint64)
            block = mix(range_hashes(words.hashes, first, first + count + WINDOW - 1, _RUN_BASE) + shape)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(owner + lo)), batch.column(1).take(pa.array(owner + lo)),
                pa.array(runs.gram.view(np.int64)), pa.array(block.view(np.int64)),
                pa.array((first - words.bounds[owner]).astype(np.int32)), pa.array(count.astype(np.int32)),
                list_column(pa.array(hashes.view(np.int64)), marks),
            ], names=[c.split()[0] for c in _RUNS.split(", ")])
        pa.default_memory_pool().release_unused()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), SPANS, pa.string())
    for whole in batches:
        _, offsets = text_bytes(whole.column(1))
        for lo, hi in slices(offsets):
            batch, rows = whole.slice(lo, hi - lo), []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, cut = text.encode().split(), merged(spans)
                left, at = [], 0
                for begin, end, _ in cut:
                    left += words[at:begin]
                    at = end
                left = b" ".join(left + words[at:])
                rows.append((doc_id, len(words), sum(e - b for b, e, _ in cut), hashlib.sha256(left).hexdigest(),
                             span_rows(cut), left.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"])
        pa.default_memory_pool().release_unused()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256, spans and kept.

    A word goes if a window of ``WINDOW`` words covers it whose words also stand,
    as a window, in a document with a smaller doc_id; windows are those of the
    input. spans are the stretches of words removed, with the least doc_id that
    also holds a part; kept is the text of the words left, joined by one space, or
    null if none was removed; kept_sha256 is its digest either way. A null or
    wordless text has no words; a text shorter than a window loses none, nor does
    one with a null doc_id, which is no source for others either. Rows with equal
    ids are not held against each other. Other columns are not looked at; an
    empty table gives no rows.
    """
    read = read_phrases(docs)
    phrases = recurring(read)
    runs = materialize(prepared(docs).join(phrases, list(KEY)).mapInArrow(_locate, _RUNS), "runs")
    discard(phrases)
    release_shuffles(docs.sparkSession)
    owners = materialize(runs.groupBy("gram", "block").agg(F.min("doc_id").alias("owner")), "run-owners")
    heads = F.when(F.col("doc_id") == F.col("owner"), F.col("hashes"))
    owned = materialize(runs.join(owners, ["gram", "block"]).withColumn("hashes", heads), "owned-runs")
    discard(runs)
    release_shuffles(docs.sparkSession)
    later = owned.filter("hashes is null").select(*KEY, *_RUN, F.col("first").alias("start"), F.col("n").alias("size"), "owner")
    opened = owned.filter("hashes is not null").select(*KEY, *_RUN, "first", F.posexplode("hashes").alias("i", "hash")).select(
        *KEY, *_RUN, "hash", (F.col("first") + F.col("i")).alias("start"))
    found = materialize(repeated_starts(opened, _RUN), "repeated-starts")
    spans = materialize(spans_of(found.select(*KEY, "start", "size", "owner").unionByName(with_least_owner(later, found, _RUN))), "spans")
    discard(owned, found)
    release_shuffles(docs.sparkSession)
    changed = prepared(docs).join(spans, list(KEY)).select("doc_id", "text", "spans").mapInArrow(_remove, _CHANGED)
    whole = read.join(spans.select(*KEY), list(KEY), "left_anti").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("words_sha256").alias("kept_sha256"),
        F.expr(f"cast(array() as {SPAN_TYPE})").alias("spans"), F.lit(None).cast("string").alias("kept"))
    return whole.unionByName(changed)
