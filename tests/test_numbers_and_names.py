import pytest
from pyspark.sql import functions as F

from surveyloom.functions import names
from surveyloom.functions.numeric import as_number, key_text, number_text, round_half_up
from surveyloom.sources.cells import clean_cells, with_row_id


@pytest.mark.parametrize("text, value", [
    ("5", 5.0), (" 5.5 ", 5.5), ("-.5", -0.5), ("5.", 5.0), ("+1e3", 1000.0), (" 7\t", 7.0), ("1E-2", 0.01),
    ("", None), ("  ", None), ("5d", None), ("5f", None), ("inf", None), ("NaN", None), ("1e999", None),
    ("1,234", None), ("abc", None), (None, None), ("1 2", None), ("--3", None),
])
def test_number_rule(spark, text, value):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(as_number(df, "c")).first()[0] == value


def test_number_rule_on_typed_cells(spark):
    df = spark.sql("SELECT true AS b, 3 AS i, CAST('NaN' AS double) AS n, CAST('Infinity' AS float) AS f, "
                   "DATE'2020-01-02' AS d, 2.50 AS c")
    row = df.select(*[as_number(df, c).alias(c) for c in df.columns]).first()
    assert tuple(row) == (1.0, 3.0, None, None, None, 2.5)


def test_odd_column_names(spark):
    df = spark.createDataFrame([("4", 1)], "`a.b` string, `c``d` int")
    assert tuple(df.select(as_number(df, "a.b"), as_number(df, "c`d")).first()) == (4.0, 1.0)


def test_keys_meet_across_types(spark):
    df = spark.sql("SELECT 5 AS i, 5.0D AS d, ' 5 ' AS s, '5.0' AS t, 'x ' AS w, CAST(null AS string) AS n, 5.25D AS q, '5.250' AS r")
    row = df.select(*[key_text(df, c).alias(c) for c in df.columns]).first()
    assert row["i"] == row["d"] == row["s"] == row["t"] == "5"
    assert row["q"] == row["r"] == "5.25" and row["w"] == "x" and row["n"] is None


def test_number_text(spark):
    values = [5.0, -3.5, 1e7 + 0.25, 0.000125, 123456789012.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(number_text(F.col("v"))).collect()] == [
        "5", "-3.5", "10000000.25", "0.000125", "123456789012"]


def test_rounding_goes_up_on_halves(spark):
    df = spark.createDataFrame([(0.0625,), (-0.0625,), (1e300,)], "v double")
    assert [r[0] for r in df.select(round_half_up(F.col("v"), 3)).collect()] == [0.063, -0.062, 1e300]


@pytest.mark.parametrize("name, expected", [
    ("id", True), ("UUID", True), ("user_id", True), ("row-id", True), ("subjID", True), ("ID", True),
    ("VALID", False), ("GRID", False), ("identity", False), ("paid", False), ("Id", True),
])
def test_identifier_names(name, expected):
    assert names.is_identifier(name) is expected


def test_score_names():
    assert names.is_score_column("pc1") and names.is_score_column("PC12_x") and not names.is_score_column("PCA1")
    assert names.score_names("x", 1) == ["COMP_x"] and names.score_names("", 2) == ["PC1", "PC2"]
    assert names.owned_scores(["PC1", "PC1_x", "COMP_x", "PC1_xy", "PC2"], "x") == ["PC1_x", "COMP_x"]
    assert names.owned_scores(["PC1", "PC1_x", "PC2"], "") == ["PC1", "PC2"]


@pytest.mark.parametrize("given, label", [
    (["openness_1", "openness_2"], "openness"), (["Q1_Need", "Q2_Need"], "Need"), (["O1", "N1"], None), (["alone"], None),
])
def test_shared_label(given, label):
    assert names.shared_label(given) == label


def test_clean_cells(spark):
    df = spark.sql("SELECT ' x ' AS s, '  ' AS e, true AS b, TIMESTAMP_NTZ'2020-01-02 03:04:05.678' AS t, CAST('NaN' AS double) AS n")
    assert tuple(clean_cells(df).first()) == ("x", None, 1.0, "2020-01-02T03:04:05.678Z", None)


@pytest.mark.parametrize("parts", [1, 6])
def test_row_ids_are_contiguous(spark, parts):
    df = spark.range(0, 500, 5).select((F.col("id") * 7 % 500).alias("k")).repartition(parts)
    rows = with_row_id(df, order="k").orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(100))
    assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)
