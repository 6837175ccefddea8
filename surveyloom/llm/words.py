"""Words of many texts at once, on the bytes of Arrow columns.

Texts stay UTF-8 bytes in one buffer. Both word classes in use are separated by
ASCII bytes alone, so working on bytes equals working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

_STEP = 0x9E3779B97F4A7C15
_GRAM = 0x2545F4914F6CDD1D
_WRAP = 2**64
SLICE_BYTES = 1 << 19


def _table(members: bytes) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(members)] = True
    return found


WHITE = _table(b"\x20\x09\x0a\x0b\x0c\x0d")
# Everything in ASCII but digits and lower-case letters.
NOT_ALNUM = _table(bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122)))
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its values; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, marks, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(marks, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; a longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))])


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls in sizes of powers of two."""
    return _powers(base % _WRAP, 1 << max(12, (max(n, 1) - 1).bit_length()))[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[start:end] for each range, independent of where the range lies."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    found = sums[ends] - sums[starts]
    return mix(found * powers(pow(base, -1, _WRAP), len(values) + 1)[starts])


@dataclass
class Words:
    """Words of the texts of one slice, in order."""

    data: np.ndarray  # bytes of the slice, lower-cased if asked for
    start: np.ndarray  # byte where a word begins
    end: np.ndarray
    bounds: np.ndarray  # text i has words bounds[i]:bounds[i + 1]
    hashes: np.ndarray

    def text_of(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, and where each begins and ends there."""
        sizes = self.end - self.start
        begin = np.cumsum(sizes + 1) - sizes - 1
        source = np.repeat(self.start - begin, sizes + 1) + np.arange(int((sizes + 1).sum()))
        out = np.append(self.data, np.uint8(32))[source]
        out[begin + sizes] = 32
        return out.tobytes(), begin, begin + sizes


def word_places(data: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes at which the words of one text begin and end."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separators[data]
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def split_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]; offsets begin at 0."""
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = ~separators[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(n, dtype=bool)
    before[:1] = True
    before[1:] = ~inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1:] = True
    after[:-1] = ~inside[1:]
    start = np.flatnonzero(inside & (before | cut[:n]))
    end = np.flatnonzero(inside & (after | cut[1:])) + 1
    hashes = range_hashes(data.astype(np.uint64) + np.uint64(1), start, end, _STEP)
    return Words(data, start, end, np.searchsorted(start, offsets), hashes)


def gram_hashes(words: Words, k: int) -> np.ndarray:
    """A hash of the k words from each word on; the last k - 1 have none."""
    n = len(words.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words.hashes[j:j + n] * np.uint64(pow(_GRAM, j + 1, _WRAP))
    return mix(total + np.uint64(k))


@dataclass
class Runs:
    """Windows next to each other that keep the same k-gram."""

    text: np.ndarray  # text of the slice
    first: np.ndarray  # word where the first window begins
    count: np.ndarray  # windows in the run
    place: np.ndarray  # word where the kept k-gram begins
    gram: np.ndarray  # its hash


def minimisers(words: Words, k: int, span: int, places: np.ndarray | None = None) -> Runs:
    """Winnowing: of every ``span`` words of a text, the k-gram with the least hash, the last of equals.

    Which k-gram a window keeps depends on its words alone, so equal windows
    keep the same one, wherever they occur. With ``places`` only the k-grams that
    begin at these words are there to choose from, and windows without one drop out.
    """
    grams = gram_hashes(words, k)
    windows = len(words.hashes) - span + 1
    if windows <= 0:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none, none.astype(np.uint64))
    low = np.uint64((1 << max(20, int(len(grams)).bit_length())) - 1)
    least = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    there = np.ones(len(grams), dtype=bool)
    if places is not None:
        there[:] = False
        there[places] = True
        least[~there] = np.uint64(_WRAP - 1)
    reach, width = 1, span - k + 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    place = (low - (least & low)).astype(np.int64)
    text = words.text_of()
    # a window without a place to choose from comes out at one before it, or at one that is not there
    whole = np.flatnonzero((text[:windows] == text[span - 1:]) & there[place] & (place >= np.arange(windows)))
    place, text = place[whole], text[whole]
    new = np.ones(len(whole), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1] + 1)
    at = np.flatnonzero(new)
    return Runs(text[at], whole[at], np.diff(np.append(at, len(whole))), place[at], grams[place[at]])


def list_column(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    """Lists values[bounds[i]:bounds[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
