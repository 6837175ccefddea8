"""Helpers shared by the registered queries and their check SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions.numeric import round_half_up
from surveyloom.sources.parquet_table import dealt_out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table dealt out over all cores, for queries heavy on every cell."""
    return dealt_out(table(spark, folder, name))


def rounded(name: str, places: int = 6) -> Column:
    return round_half_up(F.col(name), places).alias(name)


def sql_round(expression: str, places: int = 6) -> str:
    """The same rounding in SQL: halves toward +infinity."""
    scale = f"1e{places}::DOUBLE"
    return f"(floor(({expression}) * {scale} + 0.5) / {scale})"


# A survey-shaped view of the part table with missing-value codes written into
# it by formula; the same text runs on Spark and in the check.
SURVEY = """
SELECT p_partkey,
       CASE WHEN p_partkey % 23 = 0 THEN 9 ELSE p_size % 7 + 1 END AS item_a,
       CASE WHEN p_partkey % 23 = 0 THEN 9 WHEN p_partkey % 101 = 7 THEN NULL ELSE (p_size + 2) % 7 + 1 END AS item_b,
       CASE WHEN p_partkey % 15 = 0 THEN 99 ELSE p_size % 5 + 1 END AS item_c,
       CASE WHEN p_partkey % 10 = 3 THEN 9 ELSE p_size % 4 + 1 END AS item_d,
       CASE WHEN p_partkey % 40 = 0 THEN -99.0 ELSE p_retailprice * 1.0 END AS price,
       CASE WHEN p_partkey % 31 = 0 THEN ' 77 ' ELSE CAST(p_size % 6 AS VARCHAR(10)) END AS item_text,
       p_size, p_brand
FROM part
"""


def survey(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(SURVEY.replace("FROM part", "FROM {part}"), part=table(spark, folder, "part"))


SURVEY_NUMBERS = {
    "p_partkey": "CAST(p_partkey AS DOUBLE)", "item_a": "CAST(item_a AS DOUBLE)", "item_b": "CAST(item_b AS DOUBLE)",
    "item_c": "CAST(item_c AS DOUBLE)", "item_d": "CAST(item_d AS DOUBLE)", "price": "CAST(price AS DOUBLE)",
    "item_text": "TRY_CAST(trim(item_text) AS DOUBLE)", "p_size": "CAST(p_size AS DOUBLE)",
}
