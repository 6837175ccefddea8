"""Near-duplicates by SimHash, linked through a Gray-order hierarchical index.

Two fingerprints that differ in at most three bits agree in one of four blocks of
16 bits. For each block, fingerprints are rotated so that the block leads and
sorted by Gray rank, which puts those that share it next to each other and keeps
neighbours close in their other bits. The sorted run is the bottom of a tree:
chunks of it, groups in a chunk, and single fingerprints. Every upper node keeps
the bits all its members share; two nodes whose shared bits already differ in more
than three places are dropped with all they hold. Each task returns a spanning
forest of the links it finds, so a dense group gives as many links as members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.words import WHITE, slices, split_words, text_bytes
from surveyloom.plans.components import components
from surveyloom.plans.membership import split_by_keys
from surveyloom.plans.scratch import discard, materialize

SHINGLE = 3
DISTANCE = 3
SEED = 42
BLOCKS = DISTANCE + 1
BLOCK_BITS = 64 // BLOCKS
CHUNK = 1024
GROUP = 32

_NODES = "u long, v long, rotation int, prefix int, first long, shared long, pattern long, members array<long>"


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for lo, hi in slices(offsets):
            words = split_words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], WHITE, lower=True)
            joined, begin, end = words.joined()
            count = np.diff(words.bounds)
            shingles = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
            ends = np.cumsum(shingles)
            owner = np.repeat(np.arange(hi - lo), shingles)
            first = words.bounds[:-1][owner] + np.arange(len(owner)) - (ends - shingles)[owner]
            last = np.minimum(first + SHINGLE, words.bounds[1:][owner]) - 1
            hashes = np.fromiter(
                (digest(joined[a:b], SEED) for a, b in zip(begin[first].tolist(), end[last].tolist(), strict=True)),
                np.uint64, len(first))
            prints = np.zeros(hi - lo, np.uint64)
            some = np.flatnonzero(shingles)
            if len(some):
                bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                ones = np.add.reduceat(bits, (ends - shingles)[some], axis=0, dtype=np.int64)
                over = ones * 2 > shingles[some][:, None]
                prints[some] = np.packbits(over, axis=1).view(">u8").ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(prints.view(np.int64)), batch.column(2).slice(lo, hi - lo)],
                names=["doc_id", "print", "text_hash"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print, text_hash): the 64-bit fingerprint of each whole text as a signed long.

    Words are runs of anything but white space, A-Z lower-cased; shingles are
    three words joined by a space, repeats included, or all words if there are
    fewer. A bit is set if more than half the shingles' XXH64 have it. A null
    text, or one without words, has fingerprint zero.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        _fingerprints, "doc_id long, print long, text_hash long")


def _gray_rank(code: Column) -> Column:
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code


def _rotated(code: Column, block: int) -> Column:
    by = block * BLOCK_BITS
    return code if not by else F.shiftleft(code, by).bitwiseOR(F.shiftrightunsigned(code, 64 - by))


def _groups(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where groups begin, a member of each, and the bits each shares."""
    begin = np.arange(0, len(codes), GROUP)
    pattern = codes[begin]
    apart = np.bitwise_or.reduceat(codes ^ np.repeat(pattern, np.diff(np.append(begin, len(codes)))), begin)
    return begin, pattern, ~apart


def _close(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs within the distance, inside ``a`` or between ``a`` and ``b``."""
    other = a if b is None else b
    (begin_a, pattern_a, shared_a), (begin_b, pattern_b, shared_b) = _groups(a), _groups(other)
    apart = np.bitwise_count((pattern_a[:, None] ^ pattern_b[None, :]) & shared_a[:, None] & shared_b[None, :])
    near_a, near_b = np.nonzero(np.triu(apart <= DISTANCE) if b is None else apart <= DISTANCE)
    step = np.arange(GROUP)
    left, right = [], []
    for at in range(0, len(near_a), 512):
        i = begin_a[near_a[at:at + 512]][:, None] + step
        j = begin_b[near_b[at:at + 512]][:, None] + step
        there = (i < len(a))[:, :, None] & (j < len(other))[:, None, :]
        x, y = a[np.minimum(i, len(a) - 1)], other[np.minimum(j, len(other) - 1)]
        close = (np.bitwise_count(x[:, :, None] ^ y[:, None, :]) <= DISTANCE) & there
        if b is None:
            close &= i[:, :, None] < j[:, None, :]
        p, q, r = np.nonzero(close)
        left.append(i[p, q])
        right.append(j[p, r])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that has a smaller one in its component, and the smallest there."""
    label = np.arange(n)
    while len(left):
        least = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        label = label[label]
        if np.array_equal(before, label):
            break
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def _rows(u=(), v=(), chunks=()) -> pa.RecordBatch:
    n, none = len(chunks), [None] * len(u)
    return pa.RecordBatch.from_arrays([
        pa.array([*u, *[None] * n], pa.int64()), pa.array([*v, *[None] * n], pa.int64()),
        pa.array([*none, *[c[0] for c in chunks]], pa.int32()), pa.array([*none, *[c[1] for c in chunks]], pa.int32()),
        *(pa.array([*none, *[c[i] for c in chunks]], pa.int64()) for i in (2, 3, 4)),
        pa.array([*none, *[c[5] for c in chunks]], pa.list_(pa.int64())),
    ], names=["u", "v", "rotation", "prefix", "first", "shared", "pattern", "members"])


def _signed(code: np.ndarray | np.uint64) -> int:
    return int(np.asarray(code, np.uint64).view(np.int64))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among Gray-sorted fingerprints, and the chunks of prefixes that go on elsewhere."""
    rest_key, rest = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    started = False

    def chunk(key: int, codes: np.ndarray) -> tuple[pa.RecordBatch, tuple]:
        node, root = _forest(len(codes), *_close(codes))
        shared = ~np.bitwise_or.reduce(codes ^ codes[0])
        members = codes.view(np.int64)
        row = (key >> BLOCK_BITS, key & (1 << BLOCK_BITS) - 1, int(members[0]), _signed(shared), int(members[0]), members.tolist())
        return _rows(members[node].tolist(), members[root].tolist()), row

    def run(key: int, codes: np.ndarray, goes_on: bool) -> Iterator[pa.RecordBatch]:
        parts = [chunk(key, codes[i:i + CHUNK]) for i in range(0, len(codes), CHUNK)]
        for links, _ in parts:
            yield links
        if goes_on or len(parts) > 1:
            yield _rows(chunks=[row for _, row in parts])

    def finish(keys: np.ndarray, codes: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal started
        if not len(keys):
            return
        begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.append(begin, len(keys)))
        # A prefix at either end of the partition can go on in the next one.
        edge = np.zeros(len(begin), dtype=bool)
        edge[0] |= not started
        edge[-1] |= last
        started = True
        for i in np.flatnonzero(edge | (sizes > GROUP)):
            yield from run(int(keys[begin[i]]), codes[begin[i]:begin[i] + sizes[i]], bool(edge[i]))
        small = np.repeat(~edge & (sizes <= GROUP), sizes)
        u, v = [], []
        for step in range(1, int(min(GROUP, sizes.max()))):
            near = np.flatnonzero(small[:-step] & (keys[step:] == keys[:-step])
                                  & (np.bitwise_count(codes[step:] ^ codes[:-step]) <= DISTANCE))
            u.append(codes[near])
            v.append(codes[near + step])
        if u:
            yield _rows(np.concatenate(u).view(np.int64).tolist(), np.concatenate(v).view(np.int64).tolist())

    for batch in batches:
        rotation = batch.column(0).to_numpy().astype(np.int64)
        code = batch.column(1).to_numpy().view(np.uint64)
        top = (code >> (np.uint64(64) - np.uint64(BLOCK_BITS) * (rotation.astype(np.uint64) + np.uint64(1)))) & np.uint64(
            (1 << BLOCK_BITS) - 1)
        key = np.append(rest_key, rotation << BLOCK_BITS | top.astype(np.int64))
        code = np.append(rest, code)
        open_at = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1]) if len(key) else 0
        yield from finish(key[:open_at], code[:open_at], False)
        rest_key, rest = key[open_at:], code[open_at:]
        if len(rest) > 64 * CHUNK:  # a prefix too long to wait for its end: its chunks meet in the join
            yield from run(int(rest_key[0]), rest[:64 * CHUNK], True)
            rest_key, rest, started = rest_key[64 * CHUNK:], rest[64 * CHUNK:], False
    yield from finish(rest_key, rest, True)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two chunks of one prefix."""
    for batch in batches:
        for left, right in zip(batch.column(0), batch.column(1), strict=True):
            a, b = (x.values.to_numpy().view(np.uint64) for x in (left, right))
            i, j = _close(a, b)
            node, root = _forest(len(a) + len(b), i, j + len(a))
            codes = np.concatenate([a, b]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(codes[node]), pa.array(codes[root])], names=["u", "v"])


def links(prints: DataFrame) -> DataFrame:
    """(u, v) that connect exactly the distinct fingerprints within the distance, given unique (print)."""
    turns = F.explode(F.array(*[
        F.struct(F.lit(b).alias("rotation"), _gray_rank(_rotated(F.col("print"), b)).alias("rank")) for b in range(BLOCKS)]))
    order = prints.select("print", turns.alias("t")).select("t.rotation", "print", "t.rank")
    nodes = materialize(
        order.repartitionByRange("rotation", "rank").sortWithinPartitions("rotation", "rank").select("rotation", "print")
        .mapInArrow(_index, _NODES), "gray-index")
    chunks = nodes.filter("members is not null")
    a = chunks.select("rotation", "prefix", *[F.col(c).alias(f"a_{c}") for c in ("first", "shared", "pattern", "members")])
    b = chunks.select("rotation", "prefix", *[F.col(c).alias(f"b_{c}") for c in ("first", "shared", "pattern", "members")])
    apart = F.bit_count(F.col("a_pattern").bitwiseXOR(F.col("b_pattern")).bitwiseAND(F.col("a_shared")).bitwiseAND(F.col("b_shared")))
    across = (
        a.join(b, ["rotation", "prefix"]).filter((F.col("a_first") < F.col("b_first")) & (apart <= DISTANCE))
        .select("a_members", "b_members").mapInArrow(_across, "u long, v long")
    )
    return nodes.filter("u is not null").select("u", "v").unionByName(across)


def text_pairs(docs: DataFrame) -> DataFrame:
    """(u, v), text hashes: distinct texts of one fingerprint with the least of them, and the least ones across every link."""
    prints = materialize(fingerprints(docs).select("print", "text_hash").distinct(), "text-prints")
    least = materialize(prints.groupBy("print").agg(F.min("text_hash").alias("first"), F.max("text_hash").alias("last")), "prints")
    same = prints.join(least.filter("first < last"), "print").filter("text_hash != first").select(
        F.col("first").alias("u"), F.col("text_hash").alias("v"))
    ends = [least.select(F.col("print").alias(end), F.col("first").alias(f"text_{end}")) for end in "uv"]
    across = links(least.select("print")).distinct().join(ends[0], "u").join(ends[1], "v").select(
        F.least("text_u", "text_v").alias("u"), F.greatest("text_u", "text_v").alias("v"))
    return same.unionByName(across)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, print, text_hash, root and component_id.

    Fingerprints within three bits are linked; root is the least fingerprint
    reachable and component_id the least doc_id. Texts without words have
    fingerprint zero and are linked like any other. Rows with a null doc_id take
    part; component_id is null where no other id is reachable. Repeated rows are
    all returned. An empty table gives no rows. Other columns are not looked at.
    """
    stored = materialize(fingerprints(docs), "fingerprints")
    prints = materialize(stored.groupBy("print").agg(F.min("doc_id").alias("least")), "prints")
    edges = materialize(links(prints.select("print")), "links")
    ends = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    roots = components(materialize(ends, "ends"), edges).select(F.col("node").alias("print"), "root")
    rooted = materialize(prints.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of_print = materialize(rooted.select("print", "root").join(least, "root"), "print-components")
    return stored.join(of_print, "print").select("doc_id", "print", "text_hash", "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each group of near-duplicates: the least doc_id, null last; then the least text hash."""
    return keep_least(docs, near_duplicates(docs))


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with one of each ``root`` of ``found`` (doc_id, text_hash, root): the least doc_id, null last; then the least text hash."""
    each = materialize(found.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies")), "each")
    chosen = materialize(each.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash", "copies")).alias("c")).select(
        "c.doc_id", "c.text_hash", "c.copies"), "chosen")
    once, repeated = chosen.filter("copies = 1"), chosen.filter("copies > 1")
    # Only documents that are not the one row chosen of their group are moved, and the few that look like them.
    others = materialize(each.alias("e").join(once.alias("c"), F.expr("e.doc_id <=> c.doc_id and e.text_hash = c.text_hash"), "left_anti")
                         .select(F.xxhash64("doc_id", "text_hash").alias("key")), "not-chosen")
    discard(each)
    key = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))
    unsure, kept = split_by_keys(docs, key, others, F.col("key"))
    same = F.expr("cast(d.doc_id as bigint) <=> c.doc_id and xxhash64(d.text) = c.text_hash")
    kept = kept.unionByName(unsure.alias("d").join(once.alias("c"), same).select("d.*"))
    if repeated.isEmpty():  # no row stands twice
        return kept
    return kept.unionByName(unsure.alias("d").join(repeated.alias("c"), same).select("d.*").dropDuplicates(["doc_id", "text"]))
