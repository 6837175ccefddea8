"""Load rules for cells and row identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions.numeric import cell_text, col, finite, strip
from surveyloom.plans.scratch import materialize


def clean_cell(c: Column, dtype: T.DataType) -> Column:
    """One cell under the load rules.

    Booleans and integers become doubles, NaN and infinities null, dates ISO
    text, and text is trimmed with blank text null.
    """
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        return c.cast("double")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return finite(c.cast("double"))
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return cell_text(c, dtype)
    if isinstance(dtype, T.StringType):
        return F.nullif(strip(c), F.lit(""))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def clean_cells(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Apply the load rules to every column except those in ``keep``."""
    keep = set(keep or ())
    return df.select(*[
        col(f.name) if f.name in keep else clean_cell(col(f.name), f.dataType).alias(f.name) for f in df.schema
    ])


def with_row_id(df: DataFrame, order: str | None = None, name: str = "row_id") -> DataFrame:
    """Number the rows 0, 1, 2 ... without gaps.

    By a unique ``order`` column if given, else in file order. Rows are laid out
    once in a stored table, so the number of a row can never change afterwards.
    """
    placed = df.repartitionByRange(col(order)).sortWithinPartitions(col(order)) if order else df
    stored = materialize(
        placed.withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id()),
        "numbered",
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")).select(
        "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    # one row per written partition
    return stored.join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
