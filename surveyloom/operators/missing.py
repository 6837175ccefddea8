"""Missing cells: reports, imputation by the median, complete cases."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from surveyloom.functions.numeric import as_number, col
from surveyloom.plans.ranking import medians


def missing_report(df: DataFrame, columns: Sequence[str], mostly_missing: float = 50.0) -> DataFrame:
    """Cells without a usable number per column, worst first."""
    columns = list(columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(as_number(df, c)).alias(f"n{i}") for i, c in enumerate(columns)],
    )
    share = F.col("missing") * 100.0 / F.col("rows")
    return (
        counts.select("rows", F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                     (F.col("rows") - F.col(f"n{i}")).alias("missing"))
            for i, c in enumerate(columns)
        ])))
        .select("column", "position", "missing", "rows", share.alias("percent"),
                (share > mostly_missing).alias("mostly_missing"))
        .orderBy(F.desc("missing"), "position")
    )


def imputed_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Total cells a median fill would replace, out of all cells of the columns."""
    gaps = reduce(Column.__add__, [as_number(df, c).isNull().cast("bigint") for c in columns])
    return df.agg(
        F.coalesce(F.sum(gaps), F.lit(0)).alias("cells"),
        (F.count(F.lit(1)) * len(columns)).alias("total"),
    )


def unusable_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that hold no number at all and cannot serve as an axis."""
    counts = df.agg(*[F.count(as_number(df, c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if not counts[f"n{i}"]]


def require_numbers(df: DataFrame, columns: Sequence[str]) -> None:
    bad = unusable_columns(df, columns)
    if bad:
        raise ValueError("no numeric values in: " + ", ".join(bad))


def complete_test(df: DataFrame, columns: Sequence[str]) -> Column:
    """True on rows where every column holds a number."""
    return reduce(Column.__and__, [as_number(df, c).isNotNull() for c in columns])


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(complete_test(df, columns))


def median_fill(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Number views of the columns with gaps filled by the exact column median."""
    return _fill_views(df, {c: as_number(df, c) for c in columns})


def _fill_views(df: DataFrame, views: dict[str, Column]) -> dict[str, Column]:
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(v).alias(f"n{i}") for i, v in enumerate(views.values())]).first()
    return _fill_gaps(df, views, counts["rows"], {c: counts[f"n{i}"] for i, c in enumerate(views)})


def _fill_gaps(df: DataFrame, views: dict[str, Column], rows: int, have: dict[str, int]) -> dict[str, Column]:
    """Fill with exact medians, which are only looked for where something is missing."""
    empty = [c for c, n in have.items() if not n]
    if empty:
        raise ValueError("no numeric values in: " + ", ".join(empty))
    middle = medians(df, {c: v for c, v in views.items() if have[c] < rows})
    return {c: F.coalesce(v, F.lit(middle[c])) if c in middle else v for c, v in views.items()}


def distance_views(df: DataFrame, columns: Sequence[str], standardize: bool) -> list[Column]:
    """Coordinates for distances: z-scored first if asked, then filled by the median."""
    views = {c: as_number(df, c) for c in columns}
    if not standardize:
        return list(_fill_views(df, views).values())
    moments = _moments(df, views)
    have = {c: moments[f"n{i}"] for i, c in enumerate(views)}
    return list(_fill_gaps(df, _scaled(views, moments), moments["rows"], have).values())


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace gaps by the column median; other columns pass through."""
    filled = median_fill(df, columns)
    return df.select(*[filled[c].alias(c) if c in filled else col(c) for c in df.columns])


def _moments(df: DataFrame, views: dict[str, Column]) -> Row:
    return df.agg(F.count(F.lit(1)).alias("rows"), *[
        f(v).alias(f"{tag}{i}") for i, v in enumerate(views.values())
        for tag, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_pop), ("lo", F.min), ("hi", F.max))
    ]).first()


def _scaled(views: dict[str, Column], moments: Row) -> dict[str, Column]:
    scaled = {}
    for i, (c, v) in enumerate(views.items()):
        mean, sd = moments[f"mean{i}"], moments[f"sd{i}"]
        if mean is None:
            scaled[c] = v
        elif not sd or moments[f"lo{i}"] == moments[f"hi{i}"]:
            scaled[c] = F.when(v.isNotNull(), F.lit(0.0))
        else:
            scaled[c] = (v - F.lit(mean)) / F.lit(sd)
    return scaled


def zscore_views(df: DataFrame, views: dict[str, Column]) -> dict[str, Column]:
    """Standardize with the population sd, keeping nulls; a constant column becomes 0."""
    return _scaled(views, _moments(df, views))


def zscore(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    scaled = zscore_views(df, {c: as_number(df, c) for c in columns})
    return df.withColumns({f"{c}{suffix}": v for c, v in scaled.items()})
