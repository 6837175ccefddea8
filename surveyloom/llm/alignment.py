"""Two tokenizers aligned on every text: which ids of one stand where ids of the other do, and how often.

1. Documents are shuffled by their full text; of equal texts one is kept, with
   how many there are.
2. Distinct texts go through both tokenizers in blocks. A space after something
   that is not white space begins a new token in both, so a block is tokenised
   and aligned slice by slice, each distinct slice once, and a text's figures
   are sums over its slices. A block lists its distinct id pairs with the number of documents
   that hold them, copies included.
3. Pair counts are summed over blocks, compared with the highest of their first
   id, and handed back to the blocks, one value for each pair of a block.
4. Blocks turn them into measures of their texts, which join the documents by
   the digest of the text.
"""

from __future__ import annotations

import hashlib
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from surveyloom.llm.words import list_column, slices, text_bytes
from surveyloom.plans.scratch import materialize
from surveyloom.plans.skew import lookup

BLOCK_BYTES = 2 << 20
CHUNK_BYTES = 1 << 14  # of distinct slices given to a tokenizer at once
GROUP = 1 << 16  # slices of a text looked at at once
MARK = "▁"
_BLOCK_BITS = 33
_PAIR_BITS = 32
_WHITE_LEADS = b"\xc2\x9a\x80\x81"  # second last bytes of the white space beyond ASCII
_MAY_LEAD = np.isin(np.arange(256), list(_WHITE_LEADS))

_BLOCKS = ("block long, pairs array<long>, held array<long>, texts binary, digests array<string>, figures array<long>, "
           "entries binary, links binary")
_FIGURES = ("n_a", "n_b", "n_groups", "n_links")
_MEASURES = "text_key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers with the bytes of each of their ids."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(letters.get(c, 63) for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        # A piece that went on beyond a space would make tokens of a slice depend on the next.
        self.cuttable = not any(MARK in p.lstrip(MARK) for p in pieces)
        ids = range(max(len(self.a_bytes), len(self.b_bytes)))
        self.a_size = np.array([len(b) for b in self.a_bytes])
        self.b_size = np.array([len(b) for b in self.b_bytes])
        self.written = [[b"%d%s" % (i, sep) for i in ids] for sep in (b",", b"|", b";")]

    def tokens(self, text: bytes) -> tuple[list[int], list[int]] | None:
        """Ids of a text that begins with a space, or None if the bytes of either do not join to it."""
        read = text.decode()
        # The fast form gives the same ids and keeps no places of characters.
        a = self.a.encode_batch_fast([read], add_special_tokens=False)[0].ids
        # The model gives an empty text no space; after something it does.
        b = self.b.encode(read[1:]) if read != " " else self.b.encode("a ")[len(self.b.encode("a")):]
        same = b"".join([self.a_bytes[i] for i in a]) == text == b"".join([self.b_bytes[i] for i in b])
        return (a, b) if same else None


@lru_cache(maxsize=1)
def pair(first: str, second: str) -> Pair:
    """One for each pair of files and Python worker."""
    return Pair(first, second)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Bytes that are a space after something that is surely not white space."""
    before = np.concatenate([[32], data[:-1]]).astype(np.uint8)
    earlier = np.concatenate([[32, 32], data[:-2]]).astype(np.uint8)[:len(data)]
    return np.flatnonzero((data == 32) & (before > 32) & ((before < 128) | ~_MAY_LEAD[earlier]))


def _goes_on(piece: bytes) -> bool:
    """Whether another slice may follow: not after what may be white space."""
    return piece[-1] > 32 and (piece[-1] < 128 or piece[-2] not in _WHITE_LEADS)


def _small(values: np.ndarray) -> bytes:
    """Numbers, none negative, in as few bytes as the largest needs, compressed."""
    size = next(n for n in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << 8 * n)
    return zstandard.compress(b"%d" % size + values.astype(f"<u{size}").tobytes(), 1)


def _large(value: pa.Scalar) -> np.ndarray:
    """The numbers again."""
    data = zstandard.decompress(value.as_buffer())
    return np.frombuffer(data, f"<u{data[:1].decode()}", offset=1).astype(np.int64)


def _distinct(groups: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id and number of equal ids in a group, sorted."""
    keys, counts = np.unique(groups << _PAIR_BITS | ids, return_counts=True)
    return keys >> _PAIR_BITS, keys & ((1 << _PAIR_BITS) - 1), counts


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers that both of two sorted arrays hold, each once and in order."""
    a = a[np.append(True, a[1:] != a[:-1])[:len(a)]]
    return a[np.searchsorted(b, a, "right") > np.searchsorted(b, a)]


class Aligned:
    """Distinct slices of a block with their tokens, groups and links."""

    def __init__(self, both: Pair, found: list[bytes]):
        self.n = len(found)
        self.good = np.ones(self.n, bool)
        ids_a, ids_b = self._tokenised(both, found)
        sizes = np.array([len(s) for s in found], np.int64) * self.good
        ends = np.cumsum(sizes)
        ends_a, ends_b = np.cumsum(both.a_size[ids_a]), np.cumsum(both.b_size[ids_b])
        # Groups end where both do. A token is in the group whose end is the first at or after its own.
        common = _shared(ends_a, ends_b)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        count_a, count_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        owner = np.searchsorted(ends, common)  # slices without bytes end where the one before does and own nothing
        self.figures = np.stack([np.bincount(owner, weights=w, minlength=self.n).astype(np.int64)
                                 for w in (count_a, count_b, np.ones(len(common)), count_a * count_b)])
        # Every link: ids of A with how often a group has them, with all ids of B in their group.
        (in_a, of_a, times_a), (in_b, of_b, times_b) = _distinct(group_a, ids_a), _distinct(group_b, ids_b)
        span = np.bincount(in_b, minlength=len(common))
        times, first_b = span[in_a], (np.cumsum(span) - span)[in_a]
        at_b = np.repeat(first_b - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        self.pairs, local = np.unique((np.repeat(of_a, times) << _PAIR_BITS) | of_b[at_b], return_inverse=True)
        many = max(len(self.pairs), 1)
        keys, place = np.unique(np.repeat(owner[in_a], times) * many + local, return_inverse=True)
        self.links = np.zeros(len(keys), np.int64)
        np.add.at(self.links, place, np.repeat(times_a, times) * times_b[at_b])
        self.link_pairs, self.bounds = keys % many, np.searchsorted(keys // many, np.arange(self.n + 1))
        self.written = self._written(both, ids_a, ids_b, group_a, group_b, owner)

    def _tokenised(self, both: Pair, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the good slices, one after the other."""
        all_a, all_b, run, size = [], [], [], 0

        def flush() -> None:
            nonlocal size
            if not run:
                return
            ids = both.tokens(b"".join([found[i] for i in run]))
            if ids is None and len(run) > 1:
                for i in run:
                    add(i, both.tokens(found[i]))
            else:
                add(run[0], ids)
            run.clear()
            size = 0

        def add(i: int, ids: tuple | None) -> None:
            if ids is None:
                self.good[i] = False
            else:
                all_a.append(np.array(ids[0], np.int64))
                all_b.append(np.array(ids[1], np.int64))

        for i, piece in enumerate(found):
            run.append(i)
            size += len(piece)
            if size >= CHUNK_BYTES or not both.cuttable or not _goes_on(piece):
                flush()
        flush()
        none = [np.zeros(0, np.int64)]
        return np.concatenate(all_a or none), np.concatenate(all_b or none)

    def _written(self, both: Pair, ids_a, ids_b, group_a, group_b, owner) -> list[bytes]:
        """Each slice's groups as text: A's ids, a bar, B's ids, and a semicolon after each group."""
        groups = np.concatenate([group_a, group_b])
        side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
        order = np.argsort(groups * 2 + side, kind="stable")
        ids, groups, side = np.concatenate([ids_a, ids_b])[order], groups[order], side[order]
        last = np.ones(len(ids), bool)
        last[:-1] = (groups[1:] != groups[:-1]) | (side[1:] != side[:-1])
        kind = np.where(last, 1 + side, 0)
        comma, bar, semi = both.written
        parts = [(comma, bar, semi)[k][i] for k, i in zip(kind.tolist(), ids.tolist(), strict=True)]
        bounds = np.searchsorted(owner[groups], np.arange(self.n + 1)).tolist()
        return [b"".join(parts[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _align(first: str, second: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(first, second)
        block = TaskContext.get().partitionId() << _BLOCK_BITS
        for batch in batches:
            all_data, all_offsets = text_bytes(batch.column(0))
            for lo, hi in slices(all_offsets, BLOCK_BYTES):
                copies = batch.column(1).slice(lo, hi - lo).to_numpy()
                yield _block(both, block, all_data[all_offsets[lo]:all_offsets[hi]], all_offsets[lo:hi + 1] - all_offsets[lo], copies,
                             batch.column(2).slice(lo, hi - lo).to_pylist())
                block += 1
            pa.default_memory_pool().release_unused()
    return align


def _block(both: Pair, block: int, data: np.ndarray, offsets: np.ndarray, copies: np.ndarray, keys: list[bytes]) -> pa.RecordBatch:
    whole, n = data.tobytes(), len(offsets) - 1
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    numbers, read = [], np.ones(n, bool)
    for i in range(n):
        text = whole[offsets[i]:offsets[i + 1]]
        try:
            text.decode()
        except UnicodeDecodeError:
            read[i] = False
        mine = []
        if read[i] and MARK.encode() not in text:
            text = b" " + text
            cuts = cut_places(np.frombuffer(text, np.uint8)).tolist() if both.cuttable else []
            cuts = [0, *cuts, len(text)]
            for at in range(0, len(cuts) - 1, GROUP):
                pieces = map(text.__getitem__, map(slice, cuts[at:at + GROUP], cuts[at + 1:at + GROUP + 1]))
                mine.append(np.fromiter(map(known.__getitem__, pieces), np.int64))
        else:
            read[i] = False
        numbers.append(np.concatenate(mine) if mine else np.zeros(0, np.int64))
    found = Aligned(both, list(known))
    digests = []
    for i, mine in enumerate(numbers):
        if not found.good[mine].all():
            read[i], numbers[i] = False, mine[:0]
        if not read[i]:
            digests.append("")
            continue
        digest, written = hashlib.sha256(), found.written
        for at in range(0, len(mine), GROUP):
            part = b"".join([written[u] for u in mine[at:at + GROUP].tolist()])
            digest.update(part if at + GROUP < len(mine) else part[:-1])
        digests.append(digest.hexdigest())
    bounds = np.cumsum([0, *map(len, numbers)])
    used = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    figures = np.diff(np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(found.figures[:, used], axis=1)], axis=1)[:, bounds], axis=1)
    # Entries are the pairs of each text: those of its distinct slices, put together.
    slots, many = max(found.n, 1), max(len(found.pairs), 1)
    once, uses = np.unique(np.repeat(np.arange(n), np.diff(bounds)) * slots + used, return_counts=True)
    owner, once = once // slots, once % slots
    times = found.bounds[once + 1] - found.bounds[once]
    at = np.repeat(found.bounds[once] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    entries = np.repeat(owner, times) * many + found.link_pairs[at]
    links = np.repeat(uses, times) * found.links[at]
    order = np.argsort(entries, kind="stable")
    entries, links = entries[order], links[order]
    new = np.flatnonzero(np.append(True, entries[1:] != entries[:-1])[:len(entries)])
    entries, links = entries[new], np.add.reduceat(links, new) if len(new) else links
    weights = np.zeros(len(found.pairs), np.int64)
    np.add.at(weights, entries % many, copies[entries // many])
    small = [_small(np.diff(entries, prepend=0)), _small(links)]
    one = np.array([0, 1])
    return pa.RecordBatch.from_arrays([
        pa.array([block], pa.int64()), list_column(pa.array(found.pairs, pa.int64()), one * len(found.pairs)),
        list_column(pa.array(weights, pa.int64()), one * len(weights)), pa.array([b"".join(keys)], pa.binary()),
        list_column(pa.array(digests, pa.string()), one * n), list_column(pa.array(figures.ravel(), pa.int64()), one * 4 * n),
        *(pa.array([x], pa.binary()) for x in small),
    ], names=[c.split()[0] for c in _BLOCKS.split(", ")])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            column = {name: row.column(i) for i, name in enumerate(row.schema.names)}
            entries, links = np.cumsum(_large(column["entries"][0])), _large(column["links"][0])
            digests = column["digests"].flatten()
            n = len(digests)
            figures = column["figures"].flatten().to_numpy().reshape(4, n)
            counts = column["counts"].flatten()
            documents, highest = (counts.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            many = max(len(documents), 1)
            bounds = np.searchsorted(entries, np.arange(n + 1) * many)
            sums = [np.diff(np.append(0, np.cumsum(links * value[entries % many]))[bounds]) for value in (highest, documents)]
            keys = column["texts"][0].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[32 * i:32 * i + 32] for i in range(n)], pa.binary()), *(pa.array(x, pa.int64()) for x in (*figures, *sums)), digests],
                names=[c.split()[0] for c in _MEASURES.split(", ")])


def _text_key():
    return F.unhex(F.sha2("text", 256))


def align(docs: DataFrame, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    """Measures of all documents, and the counts of all id pairs.

    ``first`` is the file of a byte-level tokenizer, which reads a space and the
    text; ``second`` that of a SentencePiece model, which reads the text and adds
    the space itself. Strings of special tokens are plain text. Byte offsets at
    which tokens of both end cut them into groups, and every token of the one is
    linked with every token of the other in its group.

    The first table has a row for each row of ``docs``: doc_id, n_a and n_b
    (tokens), n_groups, n_links, n_best (links whose pair has the highest count
    of all pairs of its first id, ties included), count_sum (of the links' pairs'
    counts) and groups_sha256, the digest of all groups as ``a1,a2|b1;a3|b2,b3``.
    The second has a, b and ``documents``: how many documents hold the pair
    linked. Texts that are null, empty, not UTF-8, or not what the bytes of the
    tokens join to have zeros and an empty groups_sha256, and count for no pair. Null and repeated
    doc_ids stay as they are; other columns are not looked at; an empty table
    gives empty tables. Every executor can read both files.
    """
    named = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key")), "text-keys")
    texts = docs.filter(F.length("text") > 0).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    blocks = materialize(texts.select("text", "copies", _text_key()).mapInArrow(_align(first, second), _BLOCKS), "aligned-blocks")
    seen = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(
        F.sum("p.held").alias("documents"))
    # An id of the first tokenizer has no more partners than the second has ids.
    of_first = Window.partitionBy(F.shiftright("pair", _PAIR_BITS))
    counts = materialize(seen.withColumn("highest", F.col("documents") == F.max("documents").over(of_first)), "pair-counts")
    asked = blocks.select("block", F.posexplode("pairs").alias("pos", "pair")).join(counts, "pair")
    handed = asked.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "documents", "highest"))).alias("counts"))
    # A block without pairs has texts all the same.
    none = F.expr("cast(array() as array<struct<pos:int,documents:long,highest:boolean>>)")
    measures = materialize(blocks.drop("pairs", "held").join(handed, "block", "left").withColumn(
        "counts", F.coalesce("counts", none)).mapInArrow(_measure, _MEASURES), "text-measures")
    numbers = [c.split()[0] for c in _MEASURES.split(", ")][1:-1]
    joined = lookup(named, measures, ["text_key"], rows=named.stored_rows)
    pairs = counts.select(F.shiftright("pair", _PAIR_BITS).cast("int").alias("a"),
                          F.col("pair").bitwiseAND(F.lit((1 << _PAIR_BITS) - 1)).cast("int").alias("b"), "documents")
    return joined.select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
                         F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")), pairs
