"""Encoding, alignment and hard negatives as plainly as possible, for small tables."""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
import tiktoken
from tokenizers import Tokenizer


def sha256(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def public_encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(docs):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    public = public_encoding()
    found = []
    for d, t in docs:
        ids = public.encode_ordinary(t or "")
        found.append((d, len(ids), sha256(" ".join(map(str, ids))), sha256(public.decode_bytes(ids))))
    return found


def _letters():
    """Byte-level vocabularies: what stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    found = {chr(b): b for b in shown}
    found.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)})
    return found


def aligned(docs):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = _letters()

    def b_bytes(i):
        piece = b_model.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()

    held, read = Counter(), []
    for d, t in docs:
        groups = []
        if t:
            a, b = a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)
            sizes_a = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
            sizes_b = [b_bytes(i) for i in b]
            if b"".join(sizes_a) == b"".join(sizes_b) == (" " + t).encode():
                i = j = end_a = end_b = 0
                now = ([], [])
                while i < len(a) or j < len(b):
                    if end_a <= end_b and i < len(a):
                        end_a += len(sizes_a[i])
                        now[0].append(a[i])
                        i += 1
                    else:
                        end_b += len(sizes_b[j])
                        now[1].append(b[j])
                        j += 1
                    if end_a == end_b:
                        groups.append(now)
                        now = ([], [])
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        held.update(set(links))
        read.append((d, groups, links))
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    return [(d, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
             sum(held[p] == highest[p[0]] for p in links), sum(held[p] for p in links),
             sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)) if groups else "")
            for d, groups, links in read]


def hard_negatives(rows, k=5):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, vector, label) rows."""
    sound = []
    for r, (i, v, label) in enumerate(rows):
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            sound.append((r, i, [math.floor(256 * x) for x in v], int(math.fmod(label + 1, 10)) if i % 7 == 0 else label))
    found = []
    for r, i, v, label in sound:
        if i % 100:
            continue
        scores = [(sum(x * y for x, y in zip(v, w, strict=True)), j, s, other) for s, j, w, other in sound if s != r and len(w) == len(v)]
        scores.sort(key=lambda x: (-x[0], x[1], x[2]))
        for p, j, _, _ in [x for x in scores if x[3] == label][:k]:
            among = [x for x in scores if x[3] != label and 80 * p <= 100 * x[0] <= 100 * p]
            found += [(i, j, rank, x[1], p, x[0]) for rank, x in enumerate(among[:k], 1)]
    return found
