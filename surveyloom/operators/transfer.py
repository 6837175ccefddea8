"""Copying a column between tables, with checks that the rows really correspond."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.functions import names
from surveyloom.functions.numeric import col, key_text
from surveyloom.operators.profile import scan_columns
from surveyloom.plans.skew import lookup

# The agreement below which copying by row order is refused.
MIN_AGREEMENT_PERCENT = 90


def transfer_name(column: str, source_name: str) -> str:
    return f"{column}·{source_name}"


def _without(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[col(c) for c in df.columns if c != name])


def transfer_by_key(
    target: DataFrame, source: DataFrame, column: str, key: str, new_name: str, order: str | None = None,
) -> DataFrame:
    """Bring ``column`` over by equal keys; unmatched rows get null.

    Keys compare as text with numbers written one way, so 5, 5.0 and "5" meet;
    null keys match nothing. When the source repeats a key the row with the
    largest ``order`` value wins, null orders last and ties by the larger value;
    without ``order`` a repeated key is an error.
    """
    value = F.struct(col(column).alias("v"))
    place = F.struct(col(order).isNotNull(), col(order), col(column)) if order else F.lit(1)
    keyed = source.withColumn("_key", key_text(source, key)).filter("_key is not null").groupBy("_key").agg(
        F.max_by(value, place).alias("_found"), F.count(F.lit(1)).alias("_n"))
    if order is None:
        clash = F.concat(F.lit("the source repeats key "), F.col("_key"), F.lit("; name an order"))
        keyed = keyed.filter(F.assert_true(F.col("_n") == 1, clash).isNull())
    right = keyed.select("_key", F.col("_found.v").alias(new_name))
    left = _without(target, new_name).withColumn("_key", key_text(target, key))
    return lookup(left, right, ["_key"]).drop("_key")


def transfer_by_order(target: DataFrame, source: DataFrame, column: str, row_id: str, new_name: str) -> DataFrame:
    """Bring ``column`` over by row position; both tables need the same row count."""
    counts = target.count(), source.count()
    if counts[0] != counts[1]:
        raise ValueError(f"row counts differ: {counts[0]} and {counts[1]}")
    right = source.select(col(row_id), col(column).alias(new_name))
    return _without(target, new_name).join(right, row_id, "left")


def probe_column(source: DataFrame, target: DataFrame) -> str | None:
    """The shared column that best shows whether two tables list the same rows."""
    shared = [c for c in source.columns if c in target.columns and not names.is_axis_like(c)]
    if not shared:
        return None
    by_name = next((c for c in shared if names.names_an_id(c)), None)
    if by_name:
        return by_name
    distinct = scan_columns(source, shared)
    # a missing cell counts as one more distinct value
    levels = F.col("n_unique") + (F.col("missing") > 0).cast("int")
    return distinct.orderBy(F.desc(levels), "position").first()["column"]


def alignment(source: DataFrame, target: DataFrame, row_id: str, column: str | None = None) -> DataFrame:
    """How many rows agree on the probe column when paired by position."""
    if column is None:
        drop = [row_id]
        column = probe_column(source.drop(*drop), target.drop(*drop))
    if column is None:
        raise ValueError("the tables share no column to compare")
    a = source.select(col(row_id), key_text(source, column).alias("_a"))
    b = target.select(col(row_id), key_text(target, column).alias("_b"))
    agree = F.count_if(F.col("_a").eqNullSafe(F.col("_b")))
    total = F.count(F.lit(1))
    percent = F.floor(agree * 100.0 / total + 0.5).cast("int")
    return (
        b.join(a, row_id, "left")
        .agg(agree.alias("agree"), total.alias("total"), percent.alias("percent"))
        .select(F.lit(column).alias("column"), "agree", "total", "percent",
                (F.col("percent") >= MIN_AGREEMENT_PERCENT).alias("accepted"))
    )


def match_stats(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Target rows whose key occurs in the source, and whether source keys are unique."""
    keys = source.select(key_text(source, key).alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    source_side = keys.agg(F.coalesce(F.max("_n") == 1, F.lit(True))).scalar()
    left = target.select(key_text(target, key).alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_rows"))
    found = left.join(keys.filter("_key is not null").select("_key", F.lit(1).alias("_hit")), "_key", "left")
    return found.agg(
        F.coalesce(F.sum(F.when(F.col("_hit") == 1, F.col("_rows"))), F.lit(0)).alias("matched"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total"),
    ).withColumn("source_unique", source_side)
