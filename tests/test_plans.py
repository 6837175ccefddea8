"""Skew splitting, global ranks, order statistics, sums, components."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyloom.plans import membership, ranking, vectors
from surveyloom.plans.components import components
from surveyloom.plans.scratch import materialize
from surveyloom.plans.skew import lookup


def _left():
    rng = np.random.default_rng(3)
    keys = np.where(rng.random(400) < 0.4, 7, rng.integers(0, 30, 400))
    return pd.DataFrame({"k": keys, "v": np.arange(400)})


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_splits_hot_and_null_keys(spark, tiny_hot, how):
    left = _left().astype({"k": "Int64"})
    left.loc[::9, "k"] = pd.NA
    right = pd.DataFrame({"k": np.arange(20), "w": np.arange(20) * 10})
    sl = spark.createDataFrame([(None if pd.isna(k) else int(k), int(v)) for k, v in left.itertuples(index=False)], "k bigint, v bigint")
    got = lookup(sl, spark.createDataFrame(right), ["k"], how=how)
    plain = sl.join(spark.createDataFrame(right), ["k"], how)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.select(*got.columns).collect()))
    assert "_piece" in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("read_out, accuracy", [(4096, 2000), (5, 10)])
def test_order_statistics_match_sorting(spark, monkeypatch, read_out, accuracy):
    monkeypatch.setattr(ranking, "_READ_OUT", read_out)
    monkeypatch.setattr(ranking, "_ACCURACY", accuracy)
    rng = np.random.default_rng(0)
    columns = {
        "skewed": rng.lognormal(0, 6, 3000), "ties": rng.integers(0, 5, 3000).astype(float),
        "flat": np.full(3000, 2.5), "signed": rng.normal(0, 1e-9, 3000),
        "extreme": rng.choice([-1.7e308, 0.0, 1.6e308, 1.7e308], 3000),
    }
    df = spark.createDataFrame(pd.DataFrame(columns)).repartition(5)
    ranks = [0, 1, 750, 1499, 1500, 2998, 2999]
    got = ranking.order_statistics(df, {c: F.col(c) for c in columns}, lambda n: ranks)
    for c, values in columns.items():
        assert got[c] == list(np.sort(values)[ranks])


def test_heavy_tails_need_no_more_passes(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_READ_OUT", 100)
    monkeypatch.setattr(ranking, "_ACCURACY", 100)
    passes = []
    for name in ("_bracket", "_read_out"):
        inner = getattr(ranking, name)
        monkeypatch.setattr(ranking, name, lambda view, places, inner=inner: (passes.append(bool(places)), inner(view, places))[1])
    values = np.exp(np.random.default_rng(4).normal(0, 80, 20_000))
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(4)
    assert ranking.medians(df, {"v": F.col("v")})["v"] == float(np.median(values))
    assert sum(passes) <= 4


def test_medians_skip_missing_and_report_empty(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (4.0, None), (2.0, None)], "a double, b double")
    assert ranking.medians(df, {"a": F.col("a"), "b": F.col("b")}) == {"a": 2.0, "b": None}


@pytest.mark.parametrize("parts", [1, 7])
def test_midranks(spark, parts):
    values = np.random.default_rng(1).integers(0, 60, 500)
    df = spark.createDataFrame(pd.DataFrame({"v": values})).withColumn("n", F.lit(1)).repartition(parts)
    got = {r["v"]: r["rank"] for r in ranking.midranks(df, "v", "n").collect()}
    want = dict(zip(values, pd.Series(values).rank()))
    assert got == want


def test_cross_products_wide_and_narrow_agree(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_FAN_IN", 2)
    x = np.random.default_rng(2).normal(5, 2, (300, 14))
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(14)])).repartition(9)
    partials = df.select(F.lit(1).alias("key"), F.array("c0", "c1").alias("vec"))
    for plain_scan in (False, True):
        np.testing.assert_allclose(vectors.tree_sum(partials, plain_scan)[1], x[:, :2].sum(axis=0))
    for p in (4, 14):
        n, sums, gram = vectors.cross_products(df, [F.col(f"c{i}") for i in range(p)], [5.0] * p)
        assert n == 300
        np.testing.assert_allclose(sums, (x[:, :p] - 5).sum(axis=0))
        np.testing.assert_allclose(gram, (x[:, :p] - 5).T @ (x[:, :p] - 5))


@pytest.mark.parametrize("hot", [False, True])
def test_components(spark, request, hot):
    if hot:
        request.getfixturevalue("tiny_hot")
    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(12)]
    star = [(100, 100 + i) for i in range(1, 20)]
    extra = [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(40)]
    edges, nodes = chain + star + extra, list(range(0, 300))
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = components(
        spark.createDataFrame([(n,) for n in nodes], "node bigint"), spark.createDataFrame(edges, "u bigint, v bigint"))
    assert {r["node"]: r["root"] for r in got.collect()} == {n: find(n) for n in nodes}


def test_components_without_edges(spark):
    got = components(spark.createDataFrame([(3,), (1,)], "node bigint"), spark.createDataFrame([], "u bigint, v bigint"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (3, 3)]


def test_materialize_counts_rows(spark):
    stored = materialize(spark.range(17), "rows")
    assert stored.stored_rows == 17 == stored.count()
    assert materialize(spark.range(17).filter("id < 0"), "none").stored_rows == 0


@pytest.mark.parametrize("keys, most", [(0, 1 << 26), (50, 1 << 26), (6000, 1 << 26), (6000, 1 << 15)])
def test_rows_are_split_by_keys_without_loss(spark, monkeypatch, keys, most):
    """No row with one of the keys is taken for one without, however few bits there are; names may be any."""
    monkeypatch.setattr(membership, "MOST_BITS", most)
    rows = spark.range(20000).selectExpr("id as `_bits`", "cast(if(id % 3 = 0, null, id) as string) as `a.b`", "id as `_row`")
    among = spark.range(keys).selectExpr("xxhash64(id) as key")
    there, rest = membership.split_by_keys(rows, F.xxhash64("_row"), among, F.col("key"))
    assert there.dtypes == rest.dtypes == rows.dtypes
    found, left = ({tuple(r) for r in t.collect()} for t in (there, rest))
    assert not found & left and found | left == {tuple(r) for r in rows.collect()}
    assert {r[0] for r in found} >= set(range(keys))
    assert len(found) <= keys + 20000 * (0.3 if most < 1 << 20 else 0.1)
