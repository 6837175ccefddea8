"""Near-duplicates by five-word shingles against all pairs, in the operator and in the pipeline's stage."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from surveyloom.llm import shingles, sparse_suffixes  # noqa: E402
from surveyloom.plans.scratch import scratch_root  # noqa: E402
from test_llm_operators import awkward_texts, frame, sentence  # noqa: E402


def shingle_set(text, size=5):
    words = brute.WHITE.findall(brute.ascii_lower(text))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def grouped(given):
    """The rows in groups, by comparing all pairs."""
    sets, root = [shingle_set(t) for _, t in given], list(range(len(given)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root = [root[j] if r == root[i] else r for r in root]
    found = {}
    for r, row in zip(root, given, strict=True):
        found.setdefault(r, []).append(row)
    return list(found.values())


def edited(rng, text, edits):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def copies():
    """Texts with copies of every degree, a large group of near copies, and a line that many hold."""
    rng = random.Random(8)
    given = []
    for _ in range(25):
        text = sentence(rng, rng.randrange(40, 200))
        given += [text, *[edited(rng, text, rng.randrange(1, 7)) for _ in range(3)]]
    hub, line = sentence(rng, 150), sentence(rng, 25)
    given += [edited(rng, hub, rng.randrange(0, 6)) for _ in range(60)]
    given += [line + " " + sentence(rng, rng.randrange(0, 30)) for _ in range(30)]
    rng.shuffle(given)
    return list(enumerate(given))


def test_links_equal_those_of_all_pairs(spark):
    for given in (awkward_texts(), copies()):
        found = {}
        for r in shingles.near_duplicates(frame(spark, given)).collect():
            found.setdefault(r.root, []).append(r.doc_id)
        want = [sorted((d for d, _ in g), key=repr) for g in grouped(given)]
        assert sorted((sorted(g, key=repr) for g in found.values()), key=repr) == sorted(want, key=repr)


def test_the_stage_keeps_the_least_of_each_group(spark, tmp_path):
    given = [(d, t) for d, t in awkward_texts() if d is not None and t is not None and any(c.isalpha() for c in t)]
    for rows in (given, copies()):
        docs = frame(spark, rows)
        left = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path))
        assert left.dtypes == docs.dtypes
        assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted(min(g) for g in grouped(rows))


def test_the_stage_goes_through_the_simhash_index(spark, tmp_path, monkeypatch):
    """Without buckets in common, what fingerprints link is still found, and what is less similar than asked for is not."""
    rng = random.Random(4)
    base = sentence(rng, 400)
    words = base.split()
    given = [(1, base), (2, " ".join([*words[:-1], "end"])), (3, base + "  "), (4, sentence(rng, 90)), (5, "a b"), (6, "A  b")]
    whole = shingles._bands

    def alone(size):
        bands = whole(size)

        def unmet(batches):
            for batch in bands(batches):
                nodes = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[n] for n in nodes], pa.list_(pa.int64()))], names=batch.schema.names)
        return unmet

    monkeypatch.setattr(shingles, "_bands", alone)
    docs = frame(spark, given)
    assert {r.doc_id for r in shingles.keep_one(docs).collect()} == {1, 2, 3, 4, 5, 6}
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()} == {1, 4, 5}


def test_no_texts(spark):
    assert shingles.keep_one(frame(spark, [], clash=False)).collect() == []


def test_tables_that_nothing_reads_any_more_are_deleted(spark):
    """What a stage leaves on disk lies beside all that the next one writes."""
    place = Path(scratch_root(spark)) / "surveyloom"
    rng = random.Random(12)
    passage = sentence(rng, 80)
    docs = frame(spark, [(i, f"{sentence(rng, 20)} {passage}") for i in range(6)])

    def left(work):
        before = {p.name for p in place.glob("*")}
        count = work().count()
        return count, {p.name.rsplit("-", 1)[0] for p in place.glob("*") if p.name not in before}

    count, kept = left(lambda: shingles.near_duplicates(docs))
    assert count == 6 and kept <= {"texts", "roots"}
    count, kept = left(lambda: sparse_suffixes.repeated_spans(docs))
    assert count == 5 and not kept & {"phrases", "shared", "recurring", "suffixes", "compared", "repeated-starts"}


def test_texts_that_met_no_other_and_are_kept_are_not_moved(spark, tmp_path, monkeypatch):
    """Of 300 long texts two are near-duplicates and one is a copy: shuffles hold a small part of all text."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghijklmnop  ") for _ in range(8000)) for _ in range(298)]
    given = list(enumerate([*texts, texts[0], texts[1] + " end"]))
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().endswith(".data")}

    def moved(work):
        before = shuffled()
        return work(), sum(n for name, n in shuffled().items() if name not in before)

    moves, store = {}, shingles.materialize

    def stored(df, tag):
        table, moves[tag] = moved(lambda: store(df, tag))
        return table

    monkeypatch.setattr(shingles, "materialize", stored)
    frame(spark, given).write.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = corpus_pipeline.near_duplicate_stage(spark, spark.read.parquet(f"{tmp_path}/docs"), str(tmp_path))
        _, moves["kept"] = moved(lambda: left.write.parquet(f"{tmp_path}/kept"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == list(range(298))
    whole = sum(len(t) for _, t in given)
    assert moves["shingle-sets"] < whole / 8 and moves["kept"] < whole / 8, moves
