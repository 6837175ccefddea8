"""Byte-level BPE without regular expressions: boundaries by a scan of transition functions, pairs merged once per slice.

A text is an array of code points. Each gets a symbol from tables of letters,
digits and white space, with what the next one or two code points decide folded
in (a contraction begins here, white space goes on). A symbol is a function
from the state before it to the state after it. Functions compose
associatively, so an array is cut into blocks: one pass composes every block
from all states at once, a scan over the blocks gives each the state it starts
in, and a second pass marks where slices begin. Slices are merged pair by pair,
each distinct one once, and every id keeps the byte its bytes begin at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.words import slices, text_bytes

KEPT_BYTES = 64 << 20  # of slices kept with their ids, for each Python worker
STRETCH = 1 << 18  # code points scanned at once
GROUP = 1 << 15  # slices looked up at once
_BLOCK = 512
_LONG = 64  # bytes of a slice that is merged alone

_ENCODED = "doc_id long, n_tokens long, ids binary, offsets binary, ids_sha256 string"
_DECODED = "doc_id long, n_tokens long, ids_sha256 string, decoded binary"

# Classes of code points.
_OTHER, _LETTER, _DIGIT, _WHITE, _SPACE = range(5)
# Symbols: white space comes as the last before something else (a space, or another kind) or not.
_S_LETTER, _S_DIGIT, _S_OTHER, _S_SHORT, _S_LONG, _S_LAST_SPACE, _S_LAST_WHITE, _S_WHITE, _SYMBOLS = range(9)
# States: what the slice under way is made of, a space that joins what follows, letters a contraction still takes.
_IN_LETTERS, _IN_DIGITS, _IN_OTHERS, _IN_WHITE, _JOINS, _TWO_MORE, _ONE_MORE, _FRESH, _STATES = range(9)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """State after, and whether a slice begins, for every symbol and state before; symbols of a text's start come second."""
    after = np.zeros((2 * _SYMBOLS + 1, _STATES), np.uint8)
    begins = np.ones((2 * _SYMBOLS + 1, _STATES), bool)
    fresh = {_S_LETTER: _IN_LETTERS, _S_DIGIT: _IN_DIGITS, _S_OTHER: _IN_OTHERS, _S_SHORT: _ONE_MORE, _S_LONG: _TWO_MORE,
             _S_LAST_SPACE: _JOINS, _S_LAST_WHITE: _FRESH, _S_WHITE: _IN_WHITE}
    for symbol, state in fresh.items():
        after[[symbol, symbol + _SYMBOLS]] = state
    for symbol, run in ((_S_LETTER, _IN_LETTERS), (_S_DIGIT, _IN_DIGITS), (_S_OTHER, _IN_OTHERS),
                        (_S_SHORT, _IN_OTHERS), (_S_LONG, _IN_OTHERS)):
        for state in (run, _JOINS):
            after[symbol, state], begins[symbol, state] = run, False
    begins[_S_WHITE, _IN_WHITE] = False
    for state, less in ((_TWO_MORE, _ONE_MORE), (_ONE_MORE, _FRESH)):
        after[:_SYMBOLS, state], begins[:_SYMBOLS, state] = less, False
    after[-1] = np.arange(_STATES)  # fills blocks up
    return after, begins


_AFTER, _BEGINS = _machine()


def members(pattern: str) -> list[tuple[int, int]]:
    """Ranges (first, last) of the code points that tiktoken's own tables count to a one-character pattern."""
    single = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = np.frombuffer(bytes(single.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4").astype(np.int64)
    cut = np.flatnonzero(np.diff(found) > 1)
    return list(zip(found[np.append(0, cut + 1)].tolist(), found[np.append(cut, len(found) - 1)].tolist(), strict=True))


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, read off once for each Python process."""
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_DIGIT, r"\p{N}"), (_WHITE, r"\s")):
        for first, last in members(pattern):
            table[first:last + 1] = kind
    table[ord(" ")] = _SPACE
    return table


def symbols(points: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ``last`` marks the ends of texts. The last two points serve to look ahead."""
    kind = classes()[points]
    ahead = np.append(kind[1:], np.uint8(_WHITE))
    ahead[last] = _WHITE
    found = np.array([_S_OTHER, _S_LETTER, _S_DIGIT, _S_WHITE, _S_WHITE], np.uint8)[kind]
    stops = ahead < _WHITE
    found[(kind == _WHITE) & stops] = _S_LAST_WHITE
    found[(kind == _SPACE) & stops] = _S_LAST_SPACE
    at = np.flatnonzero((points == ord("'")) & ~last)
    points, last = np.append(points, [0, 0]), np.append(last, [True, True])
    one = points[at + 1]
    found[at[np.isin(one, [ord(c) for c in "stmd"])]] = _S_SHORT
    at, one = at[~last[at + 1]], one[~last[at + 1]]
    two = points[at + 2]
    long = ((one == ord("l")) & (two == ord("l"))) | (((one == ord("v")) | (one == ord("r"))) & (two == ord("e")))
    found[at[long]] = _S_LONG
    return found


def scan(found: np.ndarray, state: int = _FRESH) -> tuple[np.ndarray, int]:
    """Whether a slice begins at each symbol, given the state before the first; and the state after the last."""
    n, blocks = len(found), -(-len(found) // _BLOCK)
    filled = np.full(blocks * _BLOCK, 2 * _SYMBOLS, np.intp)
    filled[:n] = found
    columns = np.ascontiguousarray(filled.reshape(blocks, _BLOCK).T)
    after = _AFTER.ravel()
    whole = np.tile(np.arange(_STATES, dtype=np.uint8), (blocks, 1))
    for symbol in columns:
        whole = after[symbol[:, None] * _STATES + whole]
    step = 1
    while step < blocks:  # inclusive scan: each block's function after all those before it
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), axis=1)
        step *= 2
    now = np.concatenate([[state], whole[:-1, state]]).astype(np.uint8)
    begins = np.empty(columns.shape, bool)
    flat = _BEGINS.ravel()
    for j, symbol in enumerate(columns):
        place = symbol * _STATES + now
        begins[j], now = flat[place], after[place]
    return begins.T.ravel()[:n], int(whole[-1, state])


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes at which slices begin in the texts data[offsets[i]:offsets[i + 1]], valid UTF-8; every text begins one."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    firsts = np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0])
    start, last = np.zeros(len(lead), bool), np.zeros(len(lead), bool)
    start[firsts] = True
    last[np.append(firsts[1:], len(lead))[:len(firsts)] - 1] = True
    marks, state = [], _FRESH
    for lo in range(0, len(lead), STRETCH):
        hi = min(lo + STRETCH, len(lead))
        seen = min(hi + 2, len(lead))
        end = lead[seen] if seen < len(lead) else len(data)
        points = np.frombuffer(data[lead[lo]:end].tobytes().decode().encode("utf-32-le"), "<u4")
        found = symbols(points, last[lo:seen])[:hi - lo] + start[lo:hi] * np.uint8(_SYMBOLS)
        begins, state = scan(found, state)
        marks.append(lead[lo:hi][begins])
    return np.concatenate(marks) if marks else np.zeros(0, np.int64)


class Merger:
    """Ids of slices, from ranks; each distinct slice is merged once while it is kept."""

    def __init__(self, path: str):
        ranks = {}
        with open(path, "rb") as file:
            for line in file:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.ranks = ranks
        by_rank = sorted((rank, token) for token, rank in ranks.items())
        self.count = by_rank[-1][0] + 1
        self.size = np.zeros(self.count, np.int64)
        self.size[[rank for rank, _ in by_rank]] = [len(token) for _, token in by_rank]
        self.begin = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.bytes = np.frombuffer(b"".join(token for _, token in by_rank), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:i]] * self.count + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
                 if t[:i] in ranks and t[i:] in ranks]
        self._pairs, self._merged = np.array(sorted(pairs), np.int64).reshape(-1, 2).T.copy()
        self._decimal = [b" %d" % i for i in range(self.count)]
        self._kept: dict[bytes, tuple[bytes, bytes]] = {}
        self._kept_bytes = 0

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that two neighbours become, ``count`` where they become none."""
        pair = left * self.count + right
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        return np.where((self._pairs[at] == pair) & (left >= 0) & (right >= 0), self._merged[at], self.count)

    def _together(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces of up to ``width`` bytes, a row for each, and how many: every round merges one pair of each row."""
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width + 2), -1, np.int64)
        ids[np.arange(width + 2) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width + 1)
        rows = np.arange(len(pieces))
        step = np.arange(width + 1)
        while len(rows):
            now = ranks[rows]
            at = now.argmin(axis=1)
            best = now[np.arange(len(rows)), at]
            going = best < self.count
            rows, at, best, now = rows[going], at[going], best[going], now[going]
            beyond = step + (step > at[:, None])
            own = np.take_along_axis(ids[rows], beyond, axis=1)
            k = np.arange(len(rows))
            own[k, at] = best
            ids[rows, :-1] = own
            now = np.take_along_axis(np.pad(now, ((0, 0), (0, 1)), constant_values=self.count), beyond, axis=1)
            now[k, at] = self._rank(best, own[k, np.minimum(at + 1, width)])
            left = np.flatnonzero(at)
            now[left, at[left] - 1] = self._rank(own[left, at[left] - 1], best[left])
            ranks[rows] = now
        return ids, (ids >= 0).sum(axis=1)

    def merge(self, piece: bytes) -> list[int]:
        """One piece of any length: the neighbours of least rank become one, the leftmost first, until none has a rank."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = [(ranks[piece[i:i + 2]], i, i + 1, i + 2) for i in range(n - 1) if piece[i:i + 2] in ranks]
        heapq.heapify(pairs)
        while pairs:
            _, i, j, k = heapq.heappop(pairs)
            if end[i] != j or end[j] != k:  # one of the two has changed since
                continue
            end[i], end[j] = k, -1
            if k < n:
                before[k] = i
                if (rank := ranks.get(piece[i:end[k]])) is not None:
                    heapq.heappush(pairs, (rank, i, k, end[k]))
            if (h := before[i]) >= 0 and (rank := ranks.get(piece[h:k])) is not None:
                heapq.heappush(pairs, (rank, h, i, k))
        found, i = [], 0
        while i < n:
            found.append(ranks[piece[i:end[i]]])
            i = end[i]
        return found

    def _learn(self, pieces: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Each piece's ids as little-endian numbers, and in decimal with a space before each."""
        learned, todo = {}, {}
        for piece in pieces:
            rank = self.ranks.get(piece)
            if rank is not None:
                learned[piece] = [rank]
            elif len(piece) > _LONG:
                learned[piece] = self.merge(piece)
            else:
                todo.setdefault(-(-len(piece) // 8) * 8, []).append(piece)
        for width, same in todo.items():
            ids, count = self._together(same, width)
            flat = ids[ids >= 0].tolist()
            ends = np.cumsum(count).tolist()
            learned.update((p, flat[a:b]) for p, a, b in zip(same, [0, *ends], ends))
        decimal = self._decimal
        return {p: (pack(f"<{len(ids)}I", *ids), b"".join([decimal[i] for i in ids])) for p, ids in learned.items()}

    def _entries(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        missing = set(pieces).difference(self._kept)
        if missing:
            learned = self._learn(list(missing))
            grown = sum(200 + 8 * len(p) for p in missing)
            if self._kept_bytes + grown > KEPT_BYTES:
                kept, self._kept, self._kept_bytes = self._kept, {}, 0
                learned.update((p, kept[p]) for p in set(pieces).intersection(kept))
                grown = sum(200 + 8 * len(p) for p in learned)
            if grown > KEPT_BYTES:
                return [learned[p] for p in pieces]
            self._kept.update(learned)
            self._kept_bytes += grown
        return list(map(self._kept.__getitem__, pieces))

    def encode(self, data: bytes, marks: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[str]]:
        """Ids of the texts data[offsets[i]:offsets[i + 1]], whose slices begin at ``marks``, and digests of their decimal form."""
        bounds, ends = np.searchsorted(marks, offsets).tolist(), [*marks[1:].tolist(), len(data)]
        marks, ids, digests, i = marks.tolist(), [[] for _ in bounds[1:]], [hashlib.sha256() for _ in bounds[1:]], 0
        for lo in range(0, len(marks), GROUP):
            hi = min(lo + GROUP, len(marks))
            found = self._entries([data[a:b] for a, b in zip(marks[lo:hi], ends[lo:hi], strict=True)])
            while i < len(ids) and bounds[i] < hi:
                mine = found[max(bounds[i], lo) - lo:bounds[i + 1] - lo]
                decimal = b"".join([d for _, d in mine])
                digests[i].update(decimal[1:] if bounds[i] >= lo else decimal)
                ids[i].append(b"".join([x for x, _ in mine]))
                if bounds[i + 1] > hi:
                    break
                i += 1
        return [b"".join(x) for x in ids], [d.hexdigest() for d in digests]


@lru_cache(maxsize=1)
def merger(path: str) -> Merger:
    """One for each file and Python worker."""
    return Merger(path)


def _valid(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts as they are, or with U+FFFD for what is not UTF-8."""
    whole = data.tobytes()
    try:
        whole.decode()
        return data, offsets
    except UnicodeDecodeError:
        texts = [whole[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = merger(path)
        for batch in batches:
            all_data, all_offsets = text_bytes(batch.column(1))
            for lo, hi in slices(all_offsets):
                data, offsets = _valid(all_data[all_offsets[lo]:all_offsets[hi]], all_offsets[lo:hi + 1] - all_offsets[lo])
                ids, digests = tokens.encode(data.tobytes(), boundaries(data, offsets), offsets)
                count = np.array([len(x) // 4 for x in ids], np.int64)
                flat = np.frombuffer(b"".join(ids), "<u4")
                # Ids cover all bytes, so an id begins where those before it end.
                places = np.cumsum(tokens.size[flat]) - tokens.size[flat] - np.repeat(offsets[:-1], count)
                places, ends = places.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(count), pa.array(ids, pa.binary()),
                    pa.array([places[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary()), pa.array(digests, pa.string()),
                ], names=[c.split()[0] for c in _ENCODED.split(", ")])
            pa.default_memory_pool().release_unused()
    return encode


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids, offsets and ids_sha256 for each row of ``docs``, whose whole text is encoded.

    ids are unsigned 32-bit little-endian numbers, as tiktoken gives them for the
    file of ranks and the pattern of that vocabulary; the strings of special
    tokens are plain text. offsets, of the same shape, say at which byte of the
    text each id begins. ids_sha256 is the digest of the decimal ids with one
    space between. A null text is empty, and an empty text has no ids. Bytes that
    are not UTF-8 count as U+FFFD. Null ids and repeated rows stay as they are;
    other columns are not looked at; an empty table gives no rows. Every executor
    can read ``ranks``. One text is scanned in stretches, so beyond its bytes and
    its ids memory does not grow with it.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(ranks), _ENCODED)


def _decode(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = merger(path)
        for batch in batches:
            raw, marks = text_bytes(batch.column(2))
            places, _ = text_bytes(batch.column(3))
            for lo, hi in slices(marks):
                ids = np.frombuffer(raw[marks[lo]:marks[hi]].tobytes(), "<u4")
                place = np.frombuffer(places[marks[lo]:marks[hi]].tobytes(), "<u4").astype(np.int64)
                bounds = (marks[lo:hi + 1] - marks[lo]) // 4
                size = tokens.size[ids]
                full = np.flatnonzero(np.diff(bounds))
                length = np.zeros(hi - lo, np.int64)
                length[full] = (place + size)[bounds[full + 1] - 1]
                ends = np.cumsum(length)
                out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
                start = place + np.repeat(ends - length, np.diff(bounds))
                step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                out[np.repeat(start, size) + step] = tokens.bytes[np.repeat(tokens.begin[ids], size) + step]
                data = out.tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), batch.column(4).slice(lo, hi - lo),
                    pa.array([data[b - n:b] for b, n in zip(ends.tolist(), length.tolist(), strict=True)], pa.binary()),
                ], names=[c.split()[0] for c in _DECODED.split(", ")])
            pa.default_memory_pool().release_unused()
    return decode


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded, the bytes of the ids, for each row that ``encode`` gives.

    Every id writes its bytes at its own offset. Rows without ids decode to no bytes.
    """
    return encoded.select("doc_id", "n_tokens", "ids", "offsets", "ids_sha256").mapInArrow(_decode(ranks), _DECODED)
