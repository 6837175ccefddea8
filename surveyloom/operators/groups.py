"""Comparison of a measure across groups, with effect sizes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.numeric import as_number, label_of

# When a group is too small to trust and when eta-squared is inflated.
UNSTABLE_BELOW = 30
INFLATED_ABOVE = 0.05


def group_stats(df: DataFrame, measure: str, group: str) -> DataFrame:
    """n, mean and sample sd per group, highest mean first; one shuffle of partials."""
    return (
        df.select(as_number(df, measure).alias("v"), label_of(df, group).alias("group"))
        .dropna()
        .groupBy("group")
        .agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"),
             F.var_pop("v").alias("_var"))
        .select("group", "n", "mean", "sd", (F.col("_var") * F.col("n")).alias("_within"))
    )


def effect_sizes(stats: DataFrame) -> DataFrame:
    """Overall moments, eta-squared and omega-squared from per-group statistics.

    The total sum of squares is the within-group part plus the between-group
    part, so the table itself is read only once.
    """
    overall = stats.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_groups"), F.min("n").alias("min_group_n"),
        F.count_if(F.col("n") == 1).alias("singleton_groups"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        F.sum("_within").alias("_ssw"),
    )
    center = overall.select("mean").scalar()
    apart = F.col("mean") - center
    between = stats.agg(F.sum(F.col("n") * apart * apart).alias("_ssb")).scalar()
    total = F.col("_ssw") + F.col("_ssb")
    free = F.col("n") - F.col("n_groups")
    within = F.when(free > 0, F.col("_ssw") / free)
    return overall.withColumn("_ssb", between).select(
        "n", "mean",
        F.when(F.col("n") > 1, F.sqrt(total / (F.col("n") - 1))).alias("sd"),
        F.when(total > 0, F.col("_ssb") / total).alias("eta_squared"),
        F.when(total + within > 0,
               (F.col("_ssb") - (F.col("n_groups") - 1) * within) / (total + within)).alias("omega_squared"),
        "n_groups", "min_group_n", "singleton_groups",
    )


def judged(effects: DataFrame) -> DataFrame:
    """Add a status that refuses identifier-like groupings, and the caveats to report."""
    status = (
        F.when(F.col("n").isNull() | (F.col("n") == 0), "no-observations")
        .when(F.col("n_groups") >= F.col("n"), "identifier")
        .when(F.col("n_groups") > F.col("n") / 2, "too-fine")
        .otherwise("ok")
    )
    caveats = F.array_compact(F.array(
        F.when(F.col("singleton_groups") > 0, "singleton groups have no sd"),
        F.when(F.col("min_group_n") < UNSTABLE_BELOW, "smallest group is unstable"),
        F.when(F.col("eta_squared") - F.col("omega_squared") > INFLATED_ABOVE,
               "eta-squared is inflated by the number of groups"),
    ))
    return effects.withColumn("status", status).withColumn("caveats", caveats)


@dataclass
class GroupComparison:
    groups: DataFrame
    effects: DataFrame


def compare_groups(df: DataFrame, measure: str, group: str) -> GroupComparison:
    stats = group_stats(df, measure, group)
    return GroupComparison(
        groups=stats.drop("_within").orderBy(F.desc("mean"), "group"),
        effects=judged(effect_sizes(stats)),
    )
