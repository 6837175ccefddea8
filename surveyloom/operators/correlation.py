"""Pearson and Spearman correlation over pairwise-complete rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.numeric import as_number
from surveyloom.operators.missing import complete_cases
from surveyloom.plans.ranking import midranks
from surveyloom.plans.scratch import materialize
from surveyloom.plans.skew import find_hot, split_join
from surveyloom.plans.vectors import cross_products

_MIN_PAIRS = 3


def _ratio(n: Column, cross: Column, sx: Column, sy: Column) -> Column:
    defined = (n >= _MIN_PAIRS) & (sx > 0) & (sy > 0)
    return F.when(defined, cross / F.sqrt(F.when(defined, sx * sy).otherwise(1.0)))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """n and r; null with fewer than three pairs or a constant side."""
    x, y = F.col("x"), F.col("y")
    pairs = df.select(as_number(df, a).alias("x"), as_number(df, b).alias("y")).dropna()
    moments = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("c"),
        F.when(F.min(x) < F.max(x), F.var_pop(x)).otherwise(0.0).alias("vx"),
        F.when(F.min(y) < F.max(y), F.var_pop(y)).otherwise(0.0).alias("vy"),
    )
    return moments.select("n", _ratio(F.col("n"), F.col("c"), F.col("vx"), F.col("vy")).alias("pearson"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """n and rho: Pearson correlation of average ranks within the complete pairs.

    Equal pairs collapse to one weighted row before anything is shuffled, ranks
    come from range-partitioned distinct values, and the two rank lookups split
    any value that is hot.
    """
    pairs = materialize(
        df.select(as_number(df, a).alias("x"), as_number(df, b).alias("y")).dropna()
        .groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")),
        "pairs",
    )
    rx = midranks(pairs, "x", "n").withColumnRenamed("rank", "rx")
    ry = midranks(pairs, "y", "n").withColumnRenamed("rank", "ry")
    hot_x, hot_y = find_hot(pairs, ["x"]), find_hot(pairs, ["y"])
    ranked = split_join(split_join(pairs, rx, ["x"], hot_x), ry, ["y"], hot_y)
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dx, dy = F.col("rx") - (total + 1) / 2, F.col("ry") - (total + 1) / 2
    sums = ranked.agg(
        F.sum(F.col("n") * dx * dy).alias("c"), F.sum(F.col("n") * dx * dx).alias("vx"),
        F.sum(F.col("n") * dy * dy).alias("vy"),
    )
    n = F.lit(total).cast("bigint")
    return sums.select(n.alias("n"), _ratio(n, F.col("c"), F.col("vx"), F.col("vy")).alias("spearman"))


def correlate(df: DataFrame, a: str, b: str) -> DataFrame:
    rho = spearman(df, a, b).select("spearman").scalar()
    return pearson(df, a, b).withColumn("spearman", rho)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for every pair of columns over the rows complete in all of them.

    One pass for the means and one for the cross products, however many columns.
    """
    columns = list(columns)
    whole = complete_cases(df, columns).select(*[as_number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    views = [F.col(v) for v in whole.columns]
    stats = whole.agg(*[f(v).alias(f"{tag}{i}") for i, v in enumerate(views)
                        for tag, f in (("mean", F.avg), ("lo", F.min), ("hi", F.max))]).first()
    center = [stats[f"mean{i}"] or 0.0 for i in range(len(columns))]
    n, sums, gram = cross_products(whole, views, center)
    varies = [n >= _MIN_PAIRS and stats[f"lo{i}"] < stats[f"hi{i}"] for i in range(len(columns))]
    cov = gram - np.outer(sums, sums) / max(n, 1)
    rows = [
        (a, b, float(cov[i, j] / np.sqrt(cov[i, i] * cov[j, j])) if varies[i] and varies[j] else None)
        for i, a in enumerate(columns) for j, b in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")
