"""The pipeline against brute force, stage by stage and as a whole."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from surveyloom.llm import queries  # noqa: E402
from test_llm_operators import ITEMS, awkward_texts, sentence  # noqa: E402
from test_shingles import grouped  # noqa: E402


def cut(text, gone):
    """The text without the words at the given places; white space between two words that go goes with them."""
    out, at, end = [], 0, None
    for i, m in enumerate(brute.WHITE.finditer(text)):
        if i in gone:
            if end is None:
                out.append(text[at:m.start()])
            end = m.end()
        elif end is not None:
            at, end = end, None
    return "".join(out) + text[at if end is None else end:]


def texts():
    import random

    rng = random.Random(21)
    bench = " ".join(f"q{i}" for i in range(30))
    given = [(d, t) for d, t in awkward_texts() if d is not None]
    given += [(200, "Intro words here. " + bench + " and more."), (201, sentence(rng, 300)), (202, "!!! 123"), (203, "   "), (204, "a <|endoftext|> x"), (205, "<|endoftext|>")]
    return given


def expected(given):
    """(doc_id, text) after each stage but the last."""
    spoken = [(d, t) for d, t in given if t is not None and any(c.isalpha() for c in t)]
    yield "language", spoken
    single = [min(g) for g in grouped(spoken)]
    yield "near_duplicates", single
    kept = []
    for (d, t), (_, w, gone, _) in zip(single, brute.repeated(single), strict=True):
        if not gone or len(gone) < len(w):
            kept.append((d, cut(t, gone) if gone else t))
    yield "repeated_passages", kept
    clean = {r[0] for r in brute.contamination(kept, ITEMS) if not r[5]}
    yield "benchmark", [(d, t) for d, t in kept if d in clean]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts()], "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit(f"own {c}") for c in ("text_hash", "score", "lang_pred", "spans", "words_left", "print", "copies", "_1", "row", "_cut_spans", "_words_left")}
    docs.withColumns(clash).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages_do_what_brute_force_does(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.dtypes
    for (name, stage), (same, want) in zip(corpus_pipeline.STAGES[:-1], expected(texts()), strict=True):
        assert name == same
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.dtypes == columns
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want), name
        assert all(r.n_chars == len(r.text) and r.spans == "own spans" for r in docs.collect())


def test_the_whole_run_packs_what_is_left(spark, folder):
    *_, (_, left) = expected(texts())
    public = Tokenizer.from_file(queries.VOCABULARY)
    found = corpus_pipeline.run(spark, folder).collect()
    lengths = {d: len(public.encode(t, add_special_tokens=False).ids) + 1 for d, t in left}
    assert {r.doc_id: r.doc_tokens for r in found} == lengths
    for d, n in lengths.items():
        at = 0
        for start, length in sorted((r.start, r.length) for r in found if r.doc_id == d):
            assert start == at
            at += length
        assert at == n
    import zlib

    for d, t in left:
        ids = np.array([*public.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert all(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in found if r.doc_id == d)


def test_no_documents(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
