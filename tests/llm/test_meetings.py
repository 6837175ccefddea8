"""Blocks that meet packs: what is copied, what is found."""

from __future__ import annotations

import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import brute_tokens  # noqa: E402
from surveyloom.llm import hard_negatives, meetings, vector_search  # noqa: E402


def copies_broadcast(df):
    """Whether the plan sends every machine rows that were first copied for each shard or pack."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depths = [len(re.match(r"[\s:+\-*]*", line).group()) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(lines)) if depths[j] <= depths[i]), len(lines))
            if any("Generate" in x for x in lines[i:below]):
                return True
    return False


@pytest.fixture
def small_broadcasts(spark):
    """Broadcasts up to 10 KB only, so that a few hundred vectors are a large table."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "10k")
    yield
    spark.conf.set(setting, before)


def test_queries_copied_for_shards_are_not_broadcast(spark, monkeypatch, small_broadcasts):
    monkeypatch.setattr(vector_search, "SHARD_ROWS", 20)
    rng = random.Random(3)
    made = [(i, [rng.uniform(-1, 1) for _ in range(16)]) for i in range(600)]
    found = vector_search.top_k(spark.createDataFrame(made, "vec_id long, embedding array<float>").repartition(3))
    assert sorted(map(tuple, found.collect())) == sorted(brute.top_k(made))
    assert not copies_broadcast(found)


@pytest.mark.parametrize("values", [0, 1 << 22])
def test_vectors_that_tie(spark, monkeypatch, values):
    """Equal vectors, products beyond what floats of 32 bits hold, and packs that share a group or do not."""
    monkeypatch.setattr(vector_search, "SHARD_ROWS", 40)
    monkeypatch.setattr(vector_search, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(meetings, "GROUP_VALUES", values)
    rng = random.Random(4)
    made = [(i, [0.5, -0.25, 0.125]) for i in range(300)] + [(i, [rng.choice((7.0, 900.0, -3.5)), 2.0, 1.0]) for i in range(300, 600)]
    made += [(700, []), (701, []), (800, [1.0]), (100, [0.5, -0.25, 0.125])]
    rng.shuffle(made)
    found = vector_search.top_k(spark.createDataFrame(made, "vec_id long, embedding array<float>").repartition(5))
    assert sorted(map(tuple, found.collect())) == sorted(brute.top_k(made))


def test_best_of_each_key():
    rng = np.random.default_rng(1)
    best, entered = meetings.Best(3, 4), []
    for _ in range(30):
        key, score, ids = rng.integers(0, 3, 9), rng.integers(-3, 3, 9), rng.integers(0, 50, 9)
        best.add(key, score, ids)
        entered += zip(key.tolist(), (-score).tolist(), ids.tolist())
    key, score, ids = best.settle()
    want = [x for k in range(3) for x in sorted(e for e in entered if e[0] == k)[:4]]
    assert list(zip(key.tolist(), (-score).tolist(), ids.tolist())) == want
    few = meetings.Best(2, 3, np.array([5, -10]))
    few.add(np.array([0, 0, 1]), np.array([4, 5, -10]), np.array([1, 2, 3]))
    assert [x.tolist() for x in few.settle()] == [[0, 1], [5, -10], [2, 3]]


@pytest.mark.parametrize("x", [[[0, 1], [-128, 127]], [[300, 2]], [[-(2**31), 5]], [[2**40, -1]], np.zeros((2, 0), int), np.zeros((0, 3), int)])
def test_narrow_numbers_come_back(x):
    import pyarrow as pa

    x = np.array(x, np.int64)
    assert np.array_equal(meetings.matrix(pa.scalar(meetings.narrow(x).tobytes(), pa.binary()), *x.shape), x)


def test_anchors_copied_for_chunks_are_not_broadcast(spark, monkeypatch, small_broadcasts):
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", 20)
    asked, whole = [], hard_negatives.materialize
    monkeypatch.setattr(hard_negatives, "materialize", lambda df, tag: asked.append((tag, df)) or whole(df, tag))
    rng = random.Random(5)
    made = [(i, [rng.uniform(-1, 1) for _ in range(64)], rng.randrange(3)) for i in range(900)]
    found = hard_negatives.mine(spark.createDataFrame(made, "vec_id long, embedding array<double>, label int").repartition(3))
    assert sorted(map(tuple, found.collect())) == sorted(brute_tokens.hard_negatives(made))
    positives = dict(asked)["positives"]
    positives.collect()
    assert not copies_broadcast(found) and not copies_broadcast(positives)


@pytest.mark.parametrize("values", [0, 1 << 22])
def test_anchors_with_ties_and_many_labels(spark, monkeypatch, values):
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", 30)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 2)
    monkeypatch.setattr(hard_negatives, "_STRIPE", 45)
    monkeypatch.setattr(meetings, "GROUP_VALUES", values)
    rng = random.Random(6)
    made = [(i, [0.5, rng.choice((0.25, -0.25, 300.0))], rng.randrange(40 if i % 2 else 2)) for i in range(700)]
    made += [(700, [], 1), (701, [], 1), (702, [], 2), (800, [0.0, 0.0], 1), (100, [0.5, 0.25], 0)]
    rng.shuffle(made)
    found = hard_negatives.mine(spark.createDataFrame(made, "vec_id long, embedding array<double>, label int").repartition(4))
    assert sorted(map(tuple, found.collect())) == sorted(brute_tokens.hard_negatives(made))
