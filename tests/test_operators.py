import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import codes, crosstab, feedback, groups, missing, profile, search, search_index, transfer, view
from surveyloom.operators.correlation import correlate
from surveyloom.plans.scratch import materialize


def _scan(spark, **columns):
    pdf = pd.DataFrame(columns)
    return {(r["column"], r["value"]): r for r in codes.scan_codes(spark.createDataFrame(pdf)).collect()}


@pytest.mark.parametrize("values, expected", [
    ([1, 2, 3, 4, 5, 6, 7] * 5 + [9, 9, 9], {9: "likely"}),
    ([1, 2, 3, 4, 5, 6, 7] * 5 + [99], {99: "certain"}),
    ([20, 35, 48, 61, 80] * 4 + [-9], {-9: "certain"}),
    (list(range(0, 101)) + [99], {}),
    (list(range(0, 11)) * 3 + [9], {}),
    ([-2.5, -1.0, 0.3, 1.2, 2.2] * 4 + [-3], {}),
    ([1, 2, 3, 4] + [99], {}),
    ([5] * 20 + [99], {99: "possible"}),
    ([1, 2, 3, 4, 5] * 20 + [9], {9: "possible"}),
])
def test_code_rules(spark, values, expected):
    found = _scan(spark, x=[float(v) for v in values])
    assert {v: r["confidence"] for (_, v), r in found.items()} == expected


def test_cooccurrence_raises_but_never_creates(spark):
    n = 200
    hit = [i % 50 == 0 for i in range(n)]
    found = _scan(
        spark,
        item_a=[9.0 if h else float(i % 7 + 1) for i, h in enumerate(hit)],
        item_b=[9.0 if h else float(i % 6 + 1) for i, h in enumerate(hit)],
        child_age=[float(i % 15) for i in range(n)],
    )
    a = found[("item_a", 9.0)]
    assert a["confidence"] == "likely" and "co-occurs" in a["reasons"] and a["peers"] == 2 and a["suggested"]
    assert "in the same rows by 2 other columns" in a["message"]
    assert not any(c == "child_age" for c, _ in found)


def test_declared_codes_are_listed_literally(spark):
    pdf = pd.DataFrame({"age": [float(i % 15) for i in range(60)], "txt": ["a"] * 60})
    rows = codes.scan_codes(spark.createDataFrame(pdf), declared=[9, 500]).collect()
    assert [(r["column"], r["value"], r["confidence"], r["suggested"]) for r in rows] == [("age", 9.0, None, False)]
    assert rows[0]["message"] == "listed because it was declared"


def test_parse_codes():
    assert codes.parse_codes("9, 99 -99,, 9 x") == [9.0, 99.0, -99.0]
    assert codes.parse_codes("") == [] == codes.parse_codes(" , ")


def test_recode_keeps_everything_else_and_is_idempotent(spark):
    df = spark.createDataFrame([("9", 1.0), (" 9.0 ", 9.0), ("x", None), (None, 2.0)], "t string, n double")
    plan = {"t": [9], "n": [9], "absent": [1]}
    once = codes.apply_recode(df, plan)
    assert sorted(map(str, once.collect())) == sorted(map(str, codes.apply_recode(once, plan).collect()))
    assert [tuple(r) for r in once.collect()] == [(None, 1.0), (None, None), ("x", None), (None, 2.0)]
    effects = {r["column"]: r for r in codes.recode_effects(df, plan).collect()}
    assert effects["t"]["replaced"] == 2 and effects["t"]["n_after"] == 0 and effects["n"]["mean_after"] == 1.5
    assert all(r["untouched_identical"] for r in effects.values())
    lines = {r["column"]: r["message"] for r in codes.describe_recode(codes.recode_effects(df, {"n": [9], "t": [5]})).collect()}
    assert lines["n"] == "n | 1 of 3 numbers blanked (33.3%) | mean -2.500 | sd -3.652"
    assert lines["t"] == "t | no cell holds a planned code"


def test_wide_tables_are_scanned_in_one_pass(spark):
    rng = np.random.default_rng(12)
    x = rng.integers(1, 8, size=(3105, 1156)).astype(float)
    x[::50, :450] = 9
    table = spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>").repartition(8)
    wide = materialize(table.select(*[F.col("v")[i].alias(f"q{i}") for i in range(x.shape[1])]), "wide")
    found = codes.scan_codes(wide).collect()
    assert [r["column"] for r in found] == [f"q{i}" for i in range(450)] and {r["value"] for r in found} == {9.0}
    assert {(r["count"], r["peers"], r["confidence"]) for r in found} == {(63, 449, "likely")}
    assert [r["place"] for r in found] == list(range(1, 451))


def test_group_guards_and_noise(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"v": rng.normal(size=75), "g": [f"g{i // 3}" for i in range(75)], "u": [str(i) for i in range(75)],
                        "p": [str(i // 2) for i in range(74)] + ["z"]})
    df = spark.createDataFrame(pdf)
    effect = groups.compare_groups(df, "v", "g").effects.first()
    assert effect["status"] == "ok" and effect["eta_squared"] - effect["omega_squared"] > 0.05 and len(effect["caveats"]) == 2
    assert groups.compare_groups(df, "v", "u").effects.first()["status"] == "identifier"
    fine = groups.compare_groups(df, "v", "p").effects.first()
    assert fine["status"] == "too-fine" and fine["singleton_groups"] == 1


def test_group_sd_of_a_singleton_is_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (9.0, "b")], "v double, g string")
    assert [tuple(r)[:3] for r in groups.compare_groups(df, "v", "g").groups.collect()] == [("b", 1, 9.0), ("a", 2, 1.5)]
    assert groups.compare_groups(df, "v", "g").groups.first()["sd"] is None


@pytest.mark.parametrize("parts", [1, 7])
def test_correlation_uses_complete_pairs_and_midranks(spark, tiny_hot, parts):
    rng = np.random.default_rng(11)
    a = rng.integers(0, 6, 300).astype(float)
    b = np.round(a + rng.normal(0, 2, 300))
    a[::17], b[::13] = np.nan, np.nan
    got = correlate(spark.createDataFrame(pd.DataFrame({"a": a, "b": b})).repartition(parts), "a", "b").first()
    both = pd.DataFrame({"a": a, "b": b}).dropna()
    assert got["n"] == len(both)
    assert got["pearson"] == pytest.approx(both.corr().iloc[0, 1])
    assert got["spearman"] == pytest.approx(both.rank().corr().iloc[0, 1])


def test_correlation_needs_three_pairs(spark):
    got = correlate(spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "a double, b double"), "a", "b").first()
    assert tuple(got) == (2, None, None)


def test_scan_kinds(spark):
    n = 60
    pdf = pd.DataFrame({"num": np.arange(n) % 21, "few": np.arange(n) % 20, "many": [f"t{i}" for i in range(n)],
                        "digits": [str(i) for i in range(n)], "some": [f"t{i % 50}" for i in range(n)], "flag": np.arange(n) % 2,
                        "blank": ["  "] * n})
    want = {"num": "continuous", "few": "categorical", "many": "too-many", "digits": "too-many", "some": "categorical",
            "flag": "categorical", "blank": "categorical"}
    df = spark.createDataFrame(pdf)
    for exact in (True, False):
        rows = {r["column"]: r for r in profile.scan_columns(df, exact_distinct=exact).collect()}
        assert {c: r["kind"] for c, r in rows.items()} == want
        assert rows["digits"]["is_numeric"] and rows["blank"]["missing"] == n and rows["flag"]["boolean_like"]


def test_scan_of_odd_columns(spark):
    rows = [(-0.0, "true", None, [1], 1e300), (0.0, " false ", None, None, float("nan")), (None, "", None, [None], float("inf"))]
    df = spark.createDataFrame(rows, "zero double, flag string, none int, list array<int>, wide double").withColumn(
        "list", F.col("list").cast("string"))
    for table, n in ((df, 3), (df.limit(0), 0), (df.repartition(3), 3)):
        got = {r["column"]: r for r in profile.scan_columns(table).collect()}
        assert got["none"]["missing"] == n and not got["none"]["is_numeric"] and not got["none"]["boolean_like"]
        assert got["zero"]["n_unique"] == min(n, 1) and got["flag"]["boolean_like"] == got["zero"]["boolean_like"] == (n > 0)
        assert got["wide"]["missing"] == n - min(n, 1) and got["wide"]["max"] == (1e300 if n else None)
        assert got["flag"]["n_unique"] == got["list"]["n_unique"] == (2 if n else 0)
        assert {r["kind"] for r in got.values()} == {"categorical"}


@pytest.mark.parametrize("n, parts", [(50, 7), (51, 1), (51, 7), (4000, 3), (40000, 5)])
def test_scan_counts_many_values(spark, n, parts):
    df = spark.range(3 * n).repartition(parts).select(
        (F.col("id") % n).alias("number"), F.concat(F.lit("t"), F.col("id") % n).alias("text"), F.lit(1.5).alias("one"))
    for exact in (True, False):
        got = {r["column"]: r for r in profile.scan_columns(df, exact_distinct=exact).collect()}
        for c in ("number", "text"):
            assert got[c]["n_unique"] == n if exact or n <= 50 else abs(got[c]["n_unique"] - n) <= max(1, 0.12 * n)
        assert got["text"]["kind"] == ("too-many" if n > 50 else "categorical") and got["one"]["n_unique"] == 1
        assert (got["number"]["min"], got["number"]["max"]) == (0, n - 1) and not got["number"]["boolean_like"]


def test_default_choices(spark):
    df = spark.createDataFrame([(i, i * 1.0, i % 2, f"c{i % 3}", f"s{i % 3}") for i in range(30)],
                               "user_id int, v double, flag int, cat string, cat2 string")
    assert profile.default_axes(df) == ("v", "flag", None)
    assert profile.default_color(df) == "cat" and profile.default_color(df, "flag") == "flag"
    scored = df.withColumn("PC1", F.lit(1.0)).withColumn("PC2", F.lit(2.0)).withColumn("Cluster", F.lit("Noise"))
    assert profile.default_axes(scored) == ("PC1", "PC2", None) and profile.default_color(scored) == "Cluster"
    assert profile.suggest_standardize(scored, ["PC1", "PC2"]) is False


def test_histogram_refuses_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    rows = profile.histogram(df, ["a", "b"]).collect()
    assert {r["column"] for r in rows} == {"a"} and sum(r["n"] for r in rows) == 2 and len(rows) == 14


def test_median_imputation_and_empty_columns(spark):
    df = spark.createDataFrame([("1", None), ("x", None), ("4", None)], "a string, b double")
    assert [r["a"] for r in missing.impute_median(df, ["a"]).collect()] == [1.0, 2.5, 4.0]
    with pytest.raises(ValueError):
        missing.impute_median(df, ["a", "b"])


def test_natural_order_and_crosstab(spark):
    labels = ["Cluster 10", "Noise", "Cluster 2", None, "Cluster 2"]
    df = spark.createDataFrame([(v, "g") for v in labels], "Cluster string, g string")
    assert [r["label"] for r in crosstab.category_index(df, "Cluster").orderBy("index").collect()] == [
        "Cluster 2", "Cluster 10", "N/A", "Noise"]
    assert [r["n"] for r in crosstab.cluster_sizes(df).collect()] == [2, 1, 1, 1]
    cells = {(r["cluster"], r["group"]): r["n"] for r in crosstab.crosstab(df, "Cluster", "g").collect()}
    assert cells[("Cluster 2", "g")] == 2 and cells[(None, "g")] == 5 and cells[("Noise", None)] == 1


@pytest.mark.parametrize("groups, block", [(4, 1000), (501, 1000), (501, 60)])
def test_composition_has_one_shape_at_every_width(spark, tiny_hot, monkeypatch, groups, block):
    monkeypatch.setattr(crosstab, "_LABELS_PER_BLOCK", block)
    df = spark.createDataFrame([("a", f"g{i % groups}") for i in range(3 * groups)] + [("b", "g0")], "c string, g string")
    rows = {(r["row"], r["column"]): (r["n"], r["percent"]) for r in crosstab.composition(df, "c", "g").collect()}
    assert len(rows) == 2 * groups and rows[("a", "g1")] == (3, 100.0 / groups)
    assert rows[("b", "g0")] == (1, 100.0) and rows[("b", "g1")] == (0, 0.0)
    filled = crosstab.composition(df, "c", "g", zeros=False)
    assert {(r["row"], r["column"]) for r in filled.collect()} == {k for k, v in rows.items() if v[0]}


def test_numbers_as_categories_read_plainly(spark):
    df = spark.createDataFrame([(1.0,)] * 6 + [(2.5,)] * 5, "v double")
    assert [r["value"] for r in profile.categorical_profile(df, ["v"]).orderBy("rank").collect()] == ["1", "2.5"]


def test_a_repeated_key_needs_an_order(spark):
    source = spark.createDataFrame([("k", 1, 5), ("k", 2, None), ("j", 3, 1)], "key string, v int, at int")
    target = spark.createDataFrame([("k",), ("j",)], "key string")
    with pytest.raises(Exception, match="repeats key k"):
        transfer.transfer_by_key(target, source, "v", "key", "new").collect()
    got = transfer.transfer_by_key(target, source, "v", "key", "new", order="at").collect()
    assert {r["key"]: r["new"] for r in got} == {"k": 1, "j": 3}


def test_breakdown_refuses_individuals(spark):
    df = spark.createDataFrame([("c", f"p{i}", "x") for i in range(20)], "Cluster string, person string, user_id string")
    for column in ("person", "user_id"):
        with pytest.raises(ValueError):
            crosstab.safe_breakdown(df, "Cluster", column)


@pytest.mark.parametrize("hot", [False, True])
def test_transfer_by_key(spark, request, hot):
    if hot:
        request.getfixturevalue("tiny_hot")
    target = spark.createDataFrame([(i, float(i % 3) if i % 5 else None) for i in range(40)], "row int, k double")
    source = spark.createDataFrame([("0", "old", 1), (" 0.0 ", "new", 2), ("1", None, 3), (None, "never", 4)], "k string, v string, at int")
    got = transfer.transfer_by_key(target, source, "v", "k", "copied", order="at").orderBy("row").collect()
    assert [r["copied"] for r in got] == ["new" if i % 5 and i % 3 == 0 else None for i in range(40)]
    stats = transfer.match_stats(target, source, "k").first()
    assert stats["total"] == 40 and stats["matched"] == sum(i % 5 != 0 and i % 3 < 2 for i in range(40)) and not stats["source_unique"]


def test_transfer_by_order_needs_equal_counts(spark):
    a = spark.range(3).withColumnRenamed("id", "row_id").withColumn("v", F.col("row_id") * 2)
    assert [r["w"] for r in transfer.transfer_by_order(a, a, "v", "row_id", "w").orderBy("row_id").collect()] == [0, 2, 4]
    with pytest.raises(ValueError):
        transfer.transfer_by_order(a, a.limit(2), "v", "row_id", "w")


def test_probe_prefers_ids_then_variety(spark):
    a = spark.createDataFrame([(1, "x", 5, 0.1), (2, "x", 6, 0.2)], "`Person Id` int, g string, age int, PC1 double")
    assert transfer.probe_column(a, a) == "Person Id"
    assert transfer.probe_column(a.drop("Person Id"), a) == "age"
    assert transfer.probe_column(a.select("PC1"), a) is None


def test_search(spark):
    df = spark.createDataFrame([(1, "pca", "about variance"), (2, "eps", "dbscan radius variance"), (3, "k", "nothing")],
                               "i int, key string, body string")
    assert [r["i"] for r in search.search(df, "Variance & radius!", ["key", "body"], "i").collect()] == [2, 1]
    assert search.search(df, "a of", ["body"], "i").count() == 0
    got = search.search(df, "variance", ["body"], "i", topics=["k", "zzz"], key="key").collect()
    assert [r["i"] for r in got] == [3, 1, 2]


def test_search_index_finds_what_the_scan_finds(spark, tmp_path):
    rng = random.Random(3)
    letters = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    texts = [" ".join(rng.choice(letters) for _ in range(rng.randint(0, 6))) for _ in range(200)]
    rows = [(i, None if i % 41 == 0 else t.upper() if i % 3 else t, i % 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[5], (300, "m² of", 1)], "i int, body string, g int")
    index = search_index.build_index(df, str(tmp_path / "index"), ["body"], "i", buckets=8)
    for query in ["abc bca", "aaa abc abc cab, acb", "abcab", "m²", "zzz", "of", "", "abc zzz cccc", "bab abb cba bcc aac"]:
        want = [(r["i"], r["score"]) for r in search.search(df, query, ["body"], "i").collect()]
        assert [(r["i"], r["score"]) for r in index.search(query).collect()] == want, query
    assert index.search("abc").columns == [*df.columns, "score"]


def test_search_index_reads_the_postings_it_needs(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5)) for _ in range(150)]
    df = spark.createDataFrame([*enumerate(texts), (900, "needle xylophone")], "i int, body string")
    index = search_index.build_index(df, str(tmp_path / "index"), ["body"], "i", buckets=32)
    lookup = index.postings(["xyl"])
    assert [r["_key"] for r in lookup.collect()] == [900]
    scan = lookup._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    files = len(spark.read.parquet(f"{index.path}/postings").inputFiles())
    assert files >= 32 and scan.metrics().apply("numFiles").value() == 1
    assert [r["_most"] for r in index.candidates(["needle", "xylophone", "qqq"]).collect()] == [2]
    texts_read = index.texts(spark.createDataFrame([(900,)], "_key int"))
    assert [r["i"] for r in texts_read.collect()] == [900]


def test_search_index_stores_a_posting_for_many_rows(spark, tmp_path):
    """Rows of one batch that share a trigram are one posting, and a row is in it once."""
    df = spark.createDataFrame([(i, f"same WORDS\u00b2 same words\u00b2, x{i:03d}") for i in range(60)] + [(60, None), (61, "ab")], "i int, body string").coalesce(1)
    index = search_index.build_index(df, str(tmp_path / "index"), ["body"], "i", buckets=4)
    assert sorted(r["_key"] for r in index.postings(["ds\u00b2"]).collect()) == list(range(60))
    stored = index._read("postings").filter("gram = 'sam'")
    assert stored.count() <= index._read("texts").rdd.getNumPartitions() < 60
    assert index.postings(["x01"]).count() == 10 and index.postings(["e w", " sa"]).count() == 0


def test_search_index_needs_keys_and_its_own_names(spark, tmp_path):
    with pytest.raises(ValueError):
        search_index.build_index(spark.createDataFrame([(None, "abc")], "i int, body string"), str(tmp_path / "a"), ["body"], "i")
    with pytest.raises(ValueError):
        search_index.build_index(spark.createDataFrame([(1, "abc")], "score int, body string"), str(tmp_path / "b"), ["body"], "score")
    empty = search_index.build_index(spark.createDataFrame([], "i int, body string"), str(tmp_path / "c"), ["body"], "i")
    assert empty.search("abc").collect() == []


def test_view(spark):
    df = spark.createDataFrame([(i, float(i), f"c{i % 12}", None if i % 4 == 0 else f"s{i % 2}") for i in range(48)],
                               "id int, v double, c string, s string")
    rows = view.view_rows(df, ["v", "id"], "c", shape="s", keep=["id"]).orderBy("id").collect()
    assert rows[10]["color_index"] == 10 and rows[10]["palette"] == 0 and rows[0]["shape"] == "N/A" and rows[0]["shape_index"] == 0
    continuous = view.view_rows(df, ["v", "id"], "v", keep=["id"]).orderBy("id").first()
    assert continuous["color_index"] is None and (continuous["color_min"], continuous["color_max"]) == (0.0, 47.0)
    with pytest.raises(ValueError):
        view.visible_rows(df, "c", ["nope"])
    assert view.panned((0.0, 10.0), (0.0, 10.0), "left", 9) == ((-20.0, -10.0), (0.0, 10.0))


def test_copies_next_to_keyed_rows(spark):
    rows = [(1, "e", "up", None, None, "k"), (2, "e", "up", "", None, None), (3, "e", "up", None, "hi", None),
            (4, "e", "up", None, "hi", None), (5, None, "up", None, None, None), (6, None, "up", None, None, None)]
    df = spark.createDataFrame(rows, "id int, event_id string, rating string, reason string, user_message string, client_key string")
    assert sorted(r["id"] for r in feedback.without_copies(df, "id").collect()) == [1, 3, 5, 6]
