"""Near-duplicates by the Jaccard similarity of word shingles.

A text's shingles are hashed under ``BANDS`` x ``ROWS`` orders and the least of
each order kept. Texts that agree in all rows of a band meet in a bucket: two
texts of similarity s do in one band at least with probability
1 - (1 - s^ROWS)^BANDS. Every pair that is linked has been confirmed on the whole
sets of shingles. Each bucket is compared with one of its members first; only
buckets whose members are then still in different components are compared pair
by pair, and only across components. Pairs whose sets are told apart by their
sizes or parities are dropped there before the sets are fetched: the parities of
two sets differ in no more bits than the sets differ in shingles, so no similar
pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.simhash import keep_least
from surveyloom.llm.words import WHITE, list_column, mix, range_hashes, slices, split_words, text_bytes
from surveyloom.plans.components import components
from surveyloom.plans.membership import split_by_keys
from surveyloom.plans.scratch import discard, materialize, release_shuffles
from surveyloom.plans.skew import lookup

SHINGLE = 5
SIMILARITY = 80  # in hundredths
BANDS = 24
ROWS = 4
PARITY_WORDS = 8  # of 64 bits; each shingle flips one bit

_SHINGLE_BASE = 0xA0761D6478BD642F
_ORDERS = np.random.default_rng(42).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, repeats included, and the n + 1 bounds of the texts."""
    words = split_words(data, offsets, WHITE, lower=True)
    count = np.diff(words.bounds)
    shingles = np.maximum(count - size + 1, 1)
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    owner = np.repeat(np.arange(len(count)), shingles)
    first = words.bounds[:-1][owner] + np.arange(len(owner)) - bounds[:-1][owner]
    last = np.minimum(first + size, words.bounds[1:][owner])
    return range_hashes(words.hashes, first, last, _SHINGLE_BASE), bounds


def _bands(size: int):
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets):
                hashes, bounds = _hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], size)
                keys = np.empty((hi - lo, BANDS), np.uint64)
                for band in range(BANDS):
                    key = np.full(hi - lo, band + 1, np.uint64)
                    for order in range(band * ROWS, band * ROWS + ROWS):
                        value = (hashes ^ _ORDERS[0, order]) * _ORDERS[1, order]
                        value ^= value >> np.uint64(32)
                        value *= _ORDERS[0, order]
                        key = mix(key + np.minimum.reduceat(value, bounds[:-1]))
                    keys[:, band] = key
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo),
                     list_column(pa.array(keys.ravel().view(np.int64)), np.arange(hi - lo + 1) * BANDS)],
                    names=["node", "buckets"])
    return bands


def _sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets):
                hashes, bounds = _hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], size)
                owner = np.repeat(np.arange(hi - lo), np.diff(bounds))
                order = np.lexsort((hashes, owner))
                owner, hashes = owner[order], hashes[order]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
                values = pa.array(hashes[new].view(np.int64))
                ends = np.searchsorted(owner[new], np.arange(hi - lo + 1))
                parity = np.zeros((hi - lo, PARITY_WORDS), np.uint64)
                word = ((hashes[new] >> np.uint64(6)) % np.uint64(PARITY_WORDS)).astype(np.int64)
                np.bitwise_xor.at(parity, (owner[new], word), np.uint64(1) << (hashes[new] & np.uint64(63)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), list_column(values, ends), pa.array(np.diff(ends), pa.int32()),
                     list_column(pa.array(parity.ravel().view(np.int64)), np.arange(hi - lo + 1) * PARITY_WORDS)],
                    names=["node", "shingles", "n", "parity"])
    return sets


def _may_be_similar(similarity: int) -> str:
    """Condition on rows u and v with n and the words of parity: true wherever their sets are as similar as asked for."""
    apart = " + ".join(f"bit_count(u.p{i} ^ v.p{i})" for i in range(PARITY_WORDS))
    return f"{100 + similarity} * greatest(abs(u.n - v.n), {apart}) <= {100 - similarity} * (u.n + v.n)"


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int, tag: str) -> DataFrame:
    """The pairs (u, v) whose sets of shingles are as similar as asked for."""
    both = lookup(pairs, sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), ["u"], "inner")
    both = lookup(both, sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), ["v"], "inner", rows=pairs.stored_rows)
    shared, total = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    return materialize(both.filter((100 + similarity) * shared >= similarity * total).select("u", "v"), tag)


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, candidates: DataFrame | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash and root, which rows of one group share.

    Words are those of simhash.fingerprints; a text's shingles are the distinct
    runs of ``shingle`` words, or all words if there are fewer. Texts are linked
    where shared shingles are ``similarity`` hundredths or more of those either
    has, and groups are what is linked in any number of steps. Texts without
    words are alike. Other columns are not looked at.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    stored = materialize(keyed.select("doc_id", "text_hash"), "texts")
    read = materialize(keyed.select("text_hash", "text").mapInArrow(_bands(shingle), "node long, buckets array<long>"), "bands")
    met = materialize(read.dropDuplicates(["node"]).select("node", F.explode("buckets").alias("bucket")), "buckets")
    first = materialize(met.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter(
        "first < last").select("bucket", "first"), "first-in-bucket")
    shared = materialize(met.join(first, "bucket"), "shared-buckets")
    discard(read, met)
    release_shuffles(docs.sparkSession)
    given = None if candidates is None else materialize(candidates.select("u", "v"), "given-pairs")
    met_nodes = shared.select("node") if given is None else shared.select("node").unionByName(
        given.select(F.explode(F.array("u", "v")).alias("node")))
    nodes = materialize(met_nodes.distinct(), "candidates")
    # Texts that met no other stay where they are; of the rest one copy each is moved, before it becomes a set.
    possible, _ = split_by_keys(keyed.select(F.col("text_hash").alias("node"), "text"), F.col("node"), nodes, F.col("node"))
    texts = possible.dropDuplicates(["node"]).join(nodes, "node", "left_semi")
    sets = materialize(texts.mapInArrow(_sets(shingle), "node long, shingles array<long>, n int, parity array<long>"), "shingle-sets")
    release_shuffles(docs.sparkSession)
    pairs = shared.filter("node != first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    stars = materialize((pairs if given is None else pairs.unionByName(given)).distinct(), "stars")
    links = _confirmed(stars, sets, similarity, "star-links")
    discard(stars, *([] if given is None else [given]))
    release_shuffles(docs.sparkSession)
    roots = components(nodes, links)
    placed = materialize(shared.select("bucket", "node").join(roots, "node"), "placed")
    discard(shared, roots)
    mixed = materialize(placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select(
        "bucket"), "mixed-buckets")
    # What the bucket's first member was compared with needs no second look.
    parities = sets.select("node", "n", *[F.col("parity")[i].alias(f"p{i}") for i in range(PARITY_WORDS)])
    open_ = materialize(placed.join(mixed, "bucket").join(first, "bucket").filter("node != first").drop("first").join(
        parities, "node"), "open")
    discard(placed, mixed, first)
    pair = F.expr(f"u.bucket = v.bucket and u.node < v.node and u.root != v.root and {_may_be_similar(similarity)}")
    across = materialize(open_.alias("u").join(open_.alias("v"), pair).select(
        F.col("u.node").alias("u"), F.col("v.node").alias("v")).distinct(), "across")
    found = _confirmed(across, sets, similarity, "across-links")
    discard(open_, across, sets)
    groups = components(nodes, links.unionByName(found)).select(F.col("node").alias("text_hash"), "root")
    discard(nodes, links, found)
    release_shuffles(docs.sparkSession)
    return lookup(stored, groups, ["text_hash"], rows=stored.stored_rows).select(
        "doc_id", "text_hash", F.coalesce("root", "text_hash").alias("root"))


def keep_one(
    docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, candidates: DataFrame | None = None,
) -> DataFrame:
    """The documents with one of each group of near-duplicates: the least doc_id, null last; then the least text hash."""
    return keep_least(docs, near_duplicates(docs, shingle, similarity, candidates))
