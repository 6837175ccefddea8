"""Byte-level BPE ids of texts, from the vocabulary file of a public tokenizer.

A space between two words always begins a new piece of the pre-tokenizer, so a
text can be cut there and each cut piece encoded by itself. Pieces repeat, and
their ids are kept in a table of bounded size.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken

PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
KEPT_BYTES = 72 << 20  # of pieces kept with their ids, as Python holds them
LONGEST_KEPT = 64
_ENTRY = 250  # bytes that an entry takes besides its piece

# A space before white space, or at the end, belongs to a longer run: such a text is encoded whole.
_RUN = re.compile(rb" (?:[ \t-\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\Z)")


def _byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["content"] for t in model["added_tokens"]}
        self._special = {t["content"].encode(): np.array([t["id"]], "<u4").tobytes() for t in model["added_tokens"]}
        longest_first = sorted(self._special, key=len, reverse=True)
        self._mark = re.compile(b"(" + b"|".join(map(re.escape, longest_first)) + b")") if longest_first else None
        byte = _byte_of_letter()
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.size = 1 + max([*ranks.values(), *(t["id"] for t in model["added_tokens"])])
        self._bpe = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._kept: dict[bytes, bytes] = {}
        self._room = KEPT_BYTES

    def forget(self) -> None:
        """Drop the ids kept, which a worker would otherwise hold while it does other work."""
        self._kept, self._room = {}, KEPT_BYTES

    def _whole(self, text: bytes) -> bytes:
        return np.array(self._bpe.encode_ordinary(text.decode("utf-8", "replace")), "<u4").tobytes()

    def encode_marked(self, text: bytes) -> bytes:
        """Ids of a text in which the string of a special token is that token, as the tokenizer's own library reads it."""
        if self._mark is None:
            return self.encode(text)
        parts = self._mark.split(text)
        return b"".join(self._special[x] if i % 2 else self.encode(x) for i, x in enumerate(parts))

    def encode(self, text: bytes) -> bytes:
        """Ids of a text in which the strings of special tokens are ordinary text."""
        if not text:
            return b""
        if _RUN.search(text):
            return self._whole(text)
        kept, found = self._kept, []
        first, *rest = text.split(b" ")
        if first:
            found.append(self._whole(first))
        for word in rest:
            ids = kept.get(word)
            if ids is None:
                ids = self._whole(b" " + word)
                if len(word) <= LONGEST_KEPT:
                    self._room -= _ENTRY + len(word) + len(ids)
                    if self._room < 0:
                        self.forget()
                        kept = self._kept
                    kept[word] = ids
            found.append(ids)
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        return self._bpe.decode_bytes(np.frombuffer(ids, "<u4").tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path)
