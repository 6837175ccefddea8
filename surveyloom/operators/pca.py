"""Principal components: one moments pass, one cross-product pass, lazy scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions import names
from surveyloom.functions.numeric import as_number, col, round_half_up
from surveyloom.operators.impute import fit_iterative
from surveyloom.operators.missing import complete_test, median_fill, missing_report, require_numbers
from surveyloom.operators.profile import numeric_columns
from surveyloom.plans.vectors import cross_products, eigen

# Rows a run needs, and the length of a contributor list.
MIN_ROWS = 3
TOP_LOADINGS = 5

STRATEGIES = ("median", "complete", "iterative")


@dataclass
class PcaRun:
    table: DataFrame
    columns: list[str]
    replaced: list[str]
    label: str
    variables: list[str]
    k: int
    standardize: bool
    strategy: str
    loadings: DataFrame
    spectrum: DataFrame
    missing: DataFrame
    rows_used: int
    rows_dropped: int
    imputed_cells: int
    total_cells: int
    iterations: int | None = None
    converged: bool | None = None


def default_variables(df: DataFrame) -> list[str]:
    """Numeric columns that are neither identifiers nor scores of an earlier run."""
    return [c for c in numeric_columns(df) if not names.is_identifier(c) and not names.is_score_column(c)]


def linear_score(views: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted sum of columns, leaving out zero weights."""
    terms = [v * F.lit(float(w)) for v, w in zip(views, weights) if w != 0]
    if not terms:
        return F.lit(0.0)
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def run_pca(
    df: DataFrame,
    variables: Sequence[str] | None = None,
    k: int = 3,
    standardize: bool = True,
    label: str | None = "",
    missing: str = "median",
) -> PcaRun:
    """Decompose the variables and add score columns named after the run label.

    Without a label (None) the run is named after what the variables' names share.

    A re-run of a label replaces only its own columns. Under "complete" rows
    with a gap get null scores; the other strategies fill every gap first.
    """
    if missing not in STRATEGIES:
        raise ValueError(f"missing is one of {', '.join(STRATEGIES)}")
    variables = list(variables or default_variables(df))
    p = len(variables)
    if p < 2:
        raise ValueError("a PCA needs at least two numeric variables")
    require_numbers(df, variables)
    label = names.clean_label(names.shared_label(variables) or "" if label is None else label)
    report = missing_report(df, variables)
    n = df.count()
    gaps = report.agg(F.sum("missing")).first()[0]
    base, iterations, converged = df, None, None
    if missing == "iterative":
        fill = fit_iterative(df, variables, rank=max(1, min(k, p, n - 1)), standardize=standardize)
        iterations, converged = fill.iterations, fill.converged
        # fill copies, so the user's columns come out as they went in
        copies = {v: f"_filled{i}" for i, v in enumerate(variables)}
        base = fill.renamed(copies).fill(df.withColumns({c: as_number(df, v) for v, c in copies.items()}))
        views = {v: F.col(c) for v, c in copies.items()}
        rows = base
    elif missing == "median":
        views = median_fill(df, variables)
        rows = df
    else:
        whole = complete_test(df, variables)
        views = {v: F.when(whole, as_number(df, v)) for v in variables}
        rows = df.filter(whole)
    ordered = [views[v] for v in variables]

    # a first pass for the means keeps the second one free of cancellation
    means = rows.agg(F.count(F.lit(1)).alias("n"), *[
        f(v).alias(f"{tag}{i}") for i, v in enumerate(ordered)
        for tag, f in (("mean", F.avg), ("lo", F.min), ("hi", F.max))
    ]).first()
    used = means["n"]
    if used < MIN_ROWS:
        raise ValueError(f"only {used} usable rows, a PCA needs {MIN_ROWS}")
    center = np.array([means[f"mean{i}"] for i in range(p)])
    flat = [v for i, v in enumerate(variables) if means[f"lo{i}"] == means[f"hi{i}"]]
    if standardize and flat:
        raise ValueError("constant, cannot be standardized: " + ", ".join(flat))
    m, sums, gram = cross_products(rows, ordered, center)
    shift = sums / m
    cov = gram / m - np.outer(shift, shift)
    scale = np.sqrt(np.diag(cov)) if standardize else np.ones(p)
    values, vectors = eigen(cov / np.outer(scale, scale))
    k = max(1, min(k, p, used - 1))

    added = names.score_names(label, k)
    replaced = names.owned_scores(df.columns, label)
    centered = [v - F.lit(float(c)) for v, c in zip(ordered, center + shift)]
    scores = [linear_score(centered, vectors[c] / scale).alias(added[c]) for c in range(k)]
    scored = base.select(*[col(c) for c in df.columns if c not in replaced], *scores)

    return PcaRun(
        table=scored, columns=added, replaced=replaced, label=label, variables=variables, k=k,
        standardize=standardize, strategy=missing,
        loadings=_loadings(df, variables, vectors[:k], added),
        spectrum=_spectrum(df, values, k),
        missing=report.filter("missing > 0"), rows_used=used, rows_dropped=n - used,
        imputed_cells=0 if missing == "complete" else gaps, total_cells=n * p,
        iterations=iterations, converged=converged,
    )


def _loadings(df: DataFrame, variables, vectors, added) -> DataFrame:
    rows = [
        (added[c], c + 1, v, i, float(vectors[c][i]))
        for c in range(len(added)) for i, v in enumerate(variables)
    ]
    table = df.sparkSession.createDataFrame(
        rows, "component string, number int, variable string, position int, raw double")
    return rank_loadings(table)


def rank_loadings(table: DataFrame) -> DataFrame:
    """Loadings to three places, ranked by size inside each component."""
    table = table.withColumn("loading", round_half_up(F.col("raw"), 3))
    order = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "position")
    return table.withColumn("rank", F.row_number().over(order))


def top_loadings(loadings: DataFrame, limit: int = TOP_LOADINGS) -> DataFrame:
    return loadings.filter(F.col("rank") <= limit).orderBy("number", "rank")


def _spectrum(df: DataFrame, values: np.ndarray, k: int) -> DataFrame:
    positive = np.clip(values, 0, None)
    total = float(positive.sum()) or 1.0
    rows = [(i + 1, float(v), float(v) / total, i < k) for i, v in enumerate(positive)]
    running = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.sparkSession.createDataFrame(rows, "component int, eigenvalue double, share double, kept boolean")
        .withColumn("cumulative", F.sum("share").over(running))
    )


RUN_SCHEMA = (
    "label string, columns array<string>, variables array<string>, k int, standardize boolean, strategy string, "
    "saved_at timestamp, variance_explained array<double>, imputed_cells bigint, total_cells bigint, "
    "rows_used bigint, rows_dropped bigint"
)


def run_record(run: PcaRun, saved_at: datetime | None = None) -> DataFrame:
    """Provenance of a run as one row, for a registry table."""
    shares = [r["share"] for r in run.spectrum.filter("kept").orderBy("component").collect()]
    when = saved_at or datetime.now(timezone.utc)
    row = (run.label, run.columns, run.variables, run.k, run.standardize, run.strategy, when, shares,
           run.imputed_cells, run.total_cells, run.rows_used, run.rows_dropped)
    return run.table.sparkSession.createDataFrame([row], RUN_SCHEMA)


def latest_runs(registry: DataFrame) -> DataFrame:
    """The newest record of every label: a re-run replaces its predecessor."""
    newest = F.max_by(F.struct(*[col(c) for c in registry.columns]), F.col("saved_at"))
    return registry.groupBy("label").agg(newest.alias("r")).select("r.*")
