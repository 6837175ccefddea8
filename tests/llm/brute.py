"""The operators again, as plainly as possible, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections import defaultdict

import xxhash

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text):
    words = WHITE.findall(ascii_lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, distance=3):
    """The least fingerprint reachable from each."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in prints}


def near_duplicates(docs):
    """(doc_id, fingerprint, component_id) of (doc_id, text) rows."""
    prints = [(d, fingerprint(t)) for d, t in docs]
    root = linked([p for _, p in prints])
    least = defaultdict(lambda: None)
    for d, p in prints:
        if d is not None and (least[root[p]] is None or d < least[root[p]]):
            least[root[p]] = d
    return [(d, f"{p:016x}", least[root[p]]) for d, p in prints]


def repeated(docs, size=50):
    """(doc_id, words, words removed as a set, (window start, owner) list) for each row."""
    owner = {}
    for d, t in docs:
        w = WHITE.findall(t or "")
        for i in range(len(w) - size + 1) if d is not None else ():
            key = tuple(w[i:i + size])
            owner[key] = min(owner.get(key, d), d)
    out = []
    for d, t in docs:
        w = WHITE.findall(t or "")
        hits = [(i, owner[tuple(w[i:i + size])]) for i in range(len(w) - size + 1) if d is not None and owner[tuple(w[i:i + size])] < d]
        out.append((d, w, {j for i, _ in hits for j in range(i, i + size)}, hits))
    return out


def removed_rows(docs):
    return [(d, len(w), len(gone), sha256(" ".join(x for i, x in enumerate(w) if i not in gone))) for d, w, gone, _ in repeated(docs)]


def spans(docs):
    """(doc_id, start, words, least owner) of each stretch removed."""
    found = set()
    for d, w, gone, hits in repeated(docs):
        at = 0
        while at < len(w):
            if at not in gone:
                at += 1
                continue
            end = at
            while end in gone:
                end += 1
            found.add((d, at, end - at, min(o for i, o in hits if at <= i < end)))
            at = end
    return found


def contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(ascii_lower(text))
        if item is not None and w:
            size = min(10, len(w))
            for i in range(len(w) - size + 1):
                windows[tuple(w[i:i + size])].add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for d, text in docs:
        w = ALNUM.findall(ascii_lower(text))
        hit, ids = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit |= set(range(i, i + size))
                    ids |= windows[tuple(w[i:i + size])]
        out.append((d, len(w), len(hit), len(ids), sha256(",".join(sorted(ids))), bool(hit)))
    return out


def top_k(rows, k=10, every=100):
    vectors = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        vectors.append((i, [math.floor(1024 * struct.unpack("f", struct.pack("f", x))[0]) for x in v]))
    found = []
    for r, (q, v) in enumerate(vectors):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for s, (i, w) in enumerate(vectors) if s != r and len(w) == len(v))
            found += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return found


def _draw(key, level, generation, name):
    h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    h = xxhash.xxh64_intdigest(level.encode(), h)
    return ((_int_hash(name, _int_hash(generation, h)) >> 11) + 0.5) / 2**53


def _int_hash(value, seed):
    return xxhash.xxh64_intdigest(struct.pack("<i", value), seed)


def shard(key, tree):
    """tree: (shard, region, rack, weight, generation) tuples."""
    def pick(level, groups):
        return min(groups, key=lambda g: -math.log(_draw(key, level, *g)) / sum(p[3] for p in groups[g]))

    def grouped(places, name):
        found = defaultdict(list)
        for p in places:
            found[name(p)].append(p)
        return found

    tops = grouped(tree, lambda p: (p[4], p[1]))
    inside = tops[pick("region", tops)]
    racks = grouped(inside, lambda p: (p[4], p[2]))
    inside = racks[pick("rack", racks)]
    leaves = grouped(inside, lambda p: (p[4], p[0]))
    return pick("shard", leaves)[1]


def phrases(text, known):
    """Longest-match phrases of a text against one sample."""
    at, n = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at:end + 1] in known:
            end += 1
        at, n = end, n + 1
    return n
