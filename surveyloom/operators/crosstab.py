"""Clusters against groups: counts both ways, composition, safe breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions import names
from surveyloom.functions.numeric import label_of
from surveyloom.operators.profile import MIN_AGGREGATE_COUNT
from surveyloom.plans.ranking import dense_index
from surveyloom.plans.scratch import materialize, row_count
from surveyloom.plans.skew import lookup

# The label of missing cells, the label of unclustered rows, the
# length of a breakdown list.
MISSING_LABEL = "N/A"
NOISE = "Noise"
BREAKDOWN_TOP = 6
_LABELS_PER_BLOCK = 1000


def natural_order(label: Column) -> Column:
    """Sort key that reads digits as numbers and puts Noise last."""
    lowered = F.lower(label)
    text = F.regexp_extract(lowered, r"^([^0-9]*)", 1)
    digits = F.regexp_extract(lowered, r"^[^0-9]*([0-9]+)", 1).try_cast("decimal(38,0)")
    return F.struct((label == NOISE).alias("noise"), text.alias("text"), digits.alias("digits"),
                    lowered.alias("lowered"), label.alias("label"))


def category_index(df: DataFrame, name: str) -> DataFrame:
    """Each label of a column with its 0-based place in natural order."""
    levels = (
        df.select(F.coalesce(label_of(df, name), F.lit(MISSING_LABEL)).alias("label")).distinct()
        .withColumn("place", natural_order(F.col("label")))
    )
    return dense_index(levels, "place", "index").select(F.col("place.label").alias("label"), "index")


def pair_counts(df: DataFrame, cluster: str, group: str) -> DataFrame:
    return (
        df.select(
            F.coalesce(label_of(df, cluster), F.lit(MISSING_LABEL)).alias("cluster"),
            F.coalesce(label_of(df, group), F.lit(MISSING_LABEL)).alias("group"),
        )
        .groupBy("cluster", "group").agg(F.count(F.lit(1)).alias("n"))
    )


def crosstab(df: DataFrame, cluster: str, group: str) -> DataFrame:
    """Counts per cell with cluster totals and group totals.

    Rows of one cell collapse before the grouping sets are taken, so the
    expansion works on counts rather than on the table.
    """
    cells = pair_counts(df, cluster, group)
    return (
        cells.groupingSets(
            [[F.col("cluster"), F.col("group")], [F.col("cluster")], [F.col("group")]],
            F.col("cluster"), F.col("group"),
        )
        .agg(F.sum("n").alias("n"), F.grouping_id().alias("_level"))
        .select(
            "cluster", "group", "n",
            F.when(F.col("_level") == 0, "cell").when(F.col("_level") == 1, "cluster").otherwise("group").alias("level"),
        )
    )


def _grid(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """Every row of ``totals`` with every column label; the labels are a table of blocks of about a thousand."""
    labels = materialize(cells.select("column").distinct(), "labels")
    count = max(1, -(-row_count(labels) // _LABELS_PER_BLOCK))
    blocks = labels.groupBy(F.pmod(F.xxhash64("column"), F.lit(count)).alias("block")).agg(F.collect_list("column").alias("columns"))
    places = totals.select("row", "total", F.explode(F.expr(f"sequence(0L, {count - 1}L)")).alias("block"))
    return places.join(blocks, "block").select("row", "total", F.explode("columns").alias("column"))


def composition(df: DataFrame, cluster: str, group: str, direction: str = "cluster", zeros: bool = True) -> DataFrame:
    """Every row-column cell with its count and its percentage of the row section.

    ``direction`` "cluster" gives percentages of each cluster, "group" of each
    group. Combinations that never occur are listed with zero unless ``zeros``
    is false; the result has the same shape however many columns there are.
    """
    if direction not in ("cluster", "group"):
        raise ValueError("direction is 'cluster' or 'group'")
    row, column = ("cluster", "group") if direction == "cluster" else ("group", "cluster")
    cells = pair_counts(df, cluster, group).select(F.col(row).alias("row"), F.col(column).alias("column"), "n")
    if zeros:
        cells = materialize(cells, "cells")
    totals = cells.groupBy("row").agg(F.sum("n").alias("total"))
    if zeros:
        listed = _grid(cells, totals).join(cells, ["row", "column"], "left")
        listed = listed.withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    else:
        listed = lookup(cells, totals, ["row"])
    return listed.select("row", "column", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))


def cluster_sizes(df: DataFrame, cluster: str = "Cluster") -> DataFrame:
    return (
        df.groupBy(F.coalesce(label_of(df, cluster), F.lit(MISSING_LABEL)).alias("cluster"))
        .agg(F.count(F.lit(1)).alias("n")).orderBy(natural_order(F.col("cluster")))
    )


def safe_breakdown(df: DataFrame, cluster: str, group: str) -> DataFrame:
    """Largest values per cluster, naming only those that cover at least five rows.

    A column named like an identifier, or without any value of five rows, is
    refused: the breakdown would list individuals.
    """
    if names.is_identifier(group):
        raise ValueError(f"{group} is named like an identifier")
    cells = pair_counts(df, cluster, group)
    filled = df.select(label_of(df, group).alias("v")).filter("v is not null")
    if filled.groupBy("v").count().filter(F.col("count") >= MIN_AGGREGATE_COUNT).isEmpty():
        raise ValueError(f"no value of {group} covers {MIN_AGGREGATE_COUNT} rows")
    safe = F.col("n") >= MIN_AGGREGATE_COUNT
    totals = cells.groupBy("cluster").agg(F.sum("n").alias("total"), F.count_if(~safe).alias("withheld"))
    best = Window.partitionBy("cluster").orderBy(F.desc("n"), "group")
    top = cells.filter(safe).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= BREAKDOWN_TOP)
    return totals.join(top, "cluster", "left").select(
        "cluster", "total", "withheld", "rank", "group", "n",
        F.floor(F.col("n") * 100.0 / F.col("total") + 0.5).cast("int").alias("percent"),
    )
