"""Byte-level encoding, alignment and hard negatives against plain versions."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given as given_
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute_tokens as brute  # noqa: E402
from surveyloom.llm import alignment, byte_pairs, hard_negatives, queries  # noqa: E402
from surveyloom.llm.words import text_bytes  # noqa: E402
from test_llm_operators import awkward_texts, frame  # noqa: E402

LETTERS = " '  \n\t\r stmdlverxaST1²!é　\u0085  .<|中😀́Ⅷ▁"


def odd_texts(seed, n=60, size=60):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(LETTERS) for _ in range(rng.randrange(size)))) for i in range(n)]


def long_texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeſést'") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    return [(1, " ".join(rng.choice(words) for _ in range(150_000))), (2, "a" * 40_000), (3, "\n" * 5000 + " ab" + " " * 4000),
            (4, "'" * 3000 + "s" * 3000), (5, "xyz" * 9000 + " " + "0123456789" * 900)]


def ids_of(texts):
    import pyarrow as pa

    data, offsets = text_bytes(pa.array(texts))
    merger = byte_pairs.merger(queries.RANKS)
    ids, _ = merger.encode(data.tobytes(), byte_pairs.boundaries(data, offsets), offsets)
    return [np.frombuffer(x, "<u4").tolist() for x in ids]


PUBLIC = brute.public_encoding()


@settings(max_examples=300, deadline=None)
@given_(st.lists(st.one_of(st.text(max_size=30), st.text(LETTERS, max_size=40)), min_size=1, max_size=5))
def test_ids_equal_the_library_on_any_text(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert ids_of(texts) == [PUBLIC.encode_ordinary(t) for t in texts]


def test_every_code_point():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    assert ids_of([every]) == [PUBLIC.encode_ordinary(every)]


@pytest.mark.parametrize(("stretch", "block", "group", "kept"), [(1 << 18, 512, 1 << 15, 64 << 20), (7, 3, 5, 64 << 20), (100, 512, 11, 2000)])
def test_cutting_the_scan_changes_nothing(monkeypatch, stretch, block, group, kept):
    for name, value in (("STRETCH", stretch), ("_BLOCK", block), ("GROUP", group), ("KEPT_BYTES", kept)):
        monkeypatch.setattr(byte_pairs, name, value)
    texts = [t for _, t in odd_texts(5)]
    assert ids_of(texts) == [PUBLIC.encode_ordinary(t) for t in texts]


def test_a_state_is_carried_between_scans():
    marks = np.random.default_rng(1).integers(0, byte_pairs._SYMBOLS, 3000).astype(np.uint8)
    whole, last = byte_pairs.scan(marks)
    first, state = byte_pairs.scan(marks[:1234])
    second, end = byte_pairs.scan(marks[1234:], state)
    assert np.array_equal(whole, np.concatenate([first, second])) and end == last


def test_encoding_and_decoding(spark):
    for given in (awkward_texts(), odd_texts(1), long_texts()):
        docs = frame(spark, given).withColumns({c: F.lit("own") for c in ("ids", "offsets", "decoded", "n_tokens")})
        encoded = byte_pairs.encode(docs, queries.RANKS)
        found = byte_pairs.decode(encoded, queries.RANKS).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256))
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute.encoded(given), key=repr)
        for r in encoded.join(docs.select("doc_id", "text"), "doc_id").collect() if given[0][0] is not None else ():
            text, ids, places = (r.text or "").encode(), np.frombuffer(r.ids, "<u4"), np.frombuffer(r.offsets, "<u4")
            if len(ids) < 500:
                assert [text[a:b] for a, b in zip(places, [*places[1:], len(text)])] == [PUBLIC.decode_single_token_bytes(i) for i in ids]


def test_bytes_that_are_no_text_count_as_replaced(spark):
    docs = spark.sql("select 1L doc_id, cast(X'61FF20C3' as string) text union all select 2L, 'b'")
    found = byte_pairs.decode(byte_pairs.encode(docs, queries.RANKS), queries.RANKS).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in found] == ["a� �", "b"]


def test_alignment_equals_pairing_tokens_one_by_one(spark, tiny_hot):
    specials = [(70, "a <|endoftext|> b"), (71, "<s> x </s> <unk> <0x41>"), (72, "plain text"), (73, "plain text"), (74, "plain text")]
    for given in (awkward_texts(), odd_texts(2) + odd_texts(2)[:20] + specials, long_texts()):
        docs = frame(spark, given).withColumns({c: F.lit("own") for c in ("text_key", "n_a", "copies", "block")})
        measures, pairs = alignment.align(docs, queries.VOCABULARY, queries.PIECES)
        assert sorted(map(tuple, measures.collect()), key=repr) == sorted(brute.aligned(given), key=repr)
        assert pairs.filter("documents < 1").count() == 0


def test_alignment_of_small_blocks(spark, monkeypatch):
    both = alignment.pair(queries.VOCABULARY, queries.PIECES)
    texts = [t for _, t in odd_texts(4, 40, 200) if t]
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 1)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    keys = [bytes([i]) * 32 for i in range(len(texts))]
    small = alignment._block(both, 0, data, offsets, np.ones(len(texts), np.int64), keys)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 1 << 20)
    monkeypatch.setattr(alignment, "GROUP", 3)
    large = alignment._block(both, 0, data, offsets, np.ones(len(texts), np.int64), keys)
    assert small.equals(large)


def test_shared_ends_of_tokens_are_found_in_order():
    """Ends of tokens are sorted already; a token without bytes repeats an end."""
    rng = np.random.default_rng(7)
    for n in (0, 1, 5, 300):
        a, b = (np.sort(rng.integers(0, 2 * n + 1, size)) for size in (n, n // 2 + n % 2))
        assert alignment._shared(a, b).tolist() == np.intersect1d(a, b).tolist()
        assert alignment._shared(b, a).tolist() == np.intersect1d(a, b).tolist()


def test_ids_come_without_places_of_characters(monkeypatch):
    """Places of characters are half of the work of the first tokenizer, and nothing reads them."""
    both = alignment.Pair(queries.VOCABULARY, queries.PIECES)
    plain = both.a

    class Fast:
        encode_batch_fast = plain.encode_batch_fast

    monkeypatch.setattr(both, "a", Fast())
    for _, text in odd_texts(5, 40, 200) + [(0, "a <|endoftext|> b\u2003c  d")]:
        if text and alignment.MARK not in text:
            found = both.tokens(f" {text}".encode())
            assert found is None or found[0] == plain.encode(f" {text}", add_special_tokens=False).ids


def test_no_documents(spark):
    none = frame(spark, [], clash=False)
    assert byte_pairs.decode(byte_pairs.encode(none, queries.RANKS), queries.RANKS).collect() == []
    measures, pairs = alignment.align(none, queries.VOCABULARY, queries.PIECES)
    assert measures.collect() == [] and pairs.collect() == []


def vector_rows(seed, n=700, dim=9):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)], rng.randrange(4)) for i in range(n)]
    rows += [(200, rows[3][1], 1), (200, rows[200][1], rows[200][2]), (300, rows[300][1], rows[300][2])]  # ids that repeat
    rows += [(i, rows[5][1], rows[5][2]) for i in range(1000, 1200)]  # one vector that many have
    rows += [(2000, None, 1), (None, rows[1][1], 1), (2100, rows[1][1], None), (2200, [1.0, None, 2.0], 1),
             (2300, [float("nan")] * dim, 1), (2400, [float("inf")] * dim, 1)]
    rows += [(2500, [0.5, 1.0], 1), (2501, [0.5, 1.0], 1), (2502, [0.45, 1.0], 2), (2600, [], 1), (2601, [], 1), (2602, [], 2)]
    rng.shuffle(rows)
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns(
        {c: F.lit("own") for c in ("pack", "dim", "score", "row_id", "place", "column", "v")}).repartition(5)


@pytest.mark.parametrize(("chunk", "block"), [(4096, 1024), (50, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", block)
    rows = vector_rows(1)
    found = sorted(map(tuple, hard_negatives.mine(vector_frame(spark, rows)).collect()))
    assert found == sorted(brute.hard_negatives(rows))


def test_no_vectors(spark):
    assert hard_negatives.mine(vector_frame(spark, [(1, [1.0], 1)]).filter("false")).collect() == []
    assert hard_negatives.mine(vector_frame(spark, [(100, [1.0], 1), (101, [1.0], 2)])).collect() == []


@pytest.mark.parametrize(("dim", "size"), [(1, 1), (5, 3), (64, 300), (40, 2**17), (7, 2**24), (3, 2**29), (4, 0)])
def test_fields_give_exact_products(dim, size):
    rng = np.random.default_rng(dim)
    candidates, anchors = (rng.integers(-size, size + 1, (n, dim)) for n in (37, 11))
    fields = hard_negatives.Fields(candidates, int(anchors.min()), int(anchors.max()))
    assert np.array_equal(fields.scores(anchors), anchors @ candidates.T)
    assert fields.fields > 1 or fields.exact


def test_products_beyond_64_bits_are_an_error():
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.Fields(np.full((2, 3), 2**40), 0, 2**40)
