"""Scores from a ready-made table of component loadings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.numeric import as_number, can_hold_numbers, col, is_text
from surveyloom.operators.missing import median_fill, unusable_columns, zscore_views
from surveyloom.operators.pca import linear_score, rank_loadings

# The header a saved index column gets, and the components used.
INDEX_HEADER = "Unnamed: 0"
MAX_COMPONENTS = 3


@dataclass
class Projection:
    table: DataFrame
    columns: list[str]
    contributors: DataFrame
    matched: int
    listed: int
    fuzzy: int
    unreadable: int
    warnings: list[str] = field(default_factory=list)


def index_column(components: DataFrame) -> str:
    """The column of variable names: the saved index if present, else the first."""
    if INDEX_HEADER in components.columns:
        return INDEX_HEADER
    first = components.columns[0]
    if not is_text(components, first) and can_hold_numbers(components.schema[first].dataType):
        raise ValueError("the components table needs variable names in its first column")
    return first


def component_loadings(components: DataFrame) -> DataFrame:
    """Long form of a components table: (variable, component, position, loading)."""
    index = index_column(components)
    others = [c for c in components.columns if c != index]
    return components.select(
        col(index).cast("string").alias("variable"),
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("component"), F.lit(i).alias("position"), as_number(components, c).alias("loading"))
            for i, c in enumerate(others)
        ])),
    )


def match_variables(df: DataFrame, components: DataFrame) -> tuple[dict[str, str], int, int]:
    """Component variables found among the dataset columns: exact names first, then
    ignoring case and surrounding space. Returns the matches, how many needed the
    looser rule, and how many variables the components table lists."""
    index = index_column(components)
    loose: dict[str, str] = {}
    for c in df.columns:
        loose.setdefault(c.strip().lower(), c)
    named = components.select(col(index).cast("string").alias("v"))
    listed = named.count()
    known = named.filter(F.lower(F.trim("v")).isin(list(loose)))
    exact, fuzzy, matches = set(df.columns), 0, {}
    for row in known.distinct().collect():
        v = row["v"]
        matches[v] = v if v in exact else loose[v.strip().lower()]
        fuzzy += v not in exact
    return matches, fuzzy, listed


def project(df: DataFrame, components: DataFrame, max_components: int = MAX_COMPONENTS) -> Projection:
    """Median-fill and z-score the shared variables, then weigh them by the loadings.

    Loadings that are not numbers count as zero and are reported. A constant
    variable contributes nothing. Existing PC1.. columns are replaced.
    """
    matches, fuzzy, listed = match_variables(df, components)
    if not matches:
        raise ValueError("no variable of the components table is a column of the dataset")
    columns = list(dict.fromkeys(matches.values()))
    empty = unusable_columns(df, columns)
    if empty:
        raise ValueError("no usable numeric values in: " + ", ".join(empty))
    filled = median_fill(df, columns)
    scaled = zscore_views(df, filled)

    index = index_column(components)
    others = [c for c in components.columns if c != index]
    kept = others[:max_components]
    rows = components.filter(col(index).cast("string").isin(list(matches))).select(
        col(index).cast("string"), *[as_number(components, c) for c in others]).collect()
    unreadable = sum(v is None for row in rows for v in row[1:])
    added = [f"PC{i + 1}" for i in range(len(kept))]
    scores = [
        linear_score([scaled[matches[row[0]]] for row in rows], [row[1 + i] or 0.0 for row in rows]).alias(name)
        for i, name in enumerate(added)
    ]
    table = df.select(*[col(c) for c in df.columns if c not in added], *scores)
    place = {c: i for i, c in enumerate(df.columns)}
    long = [
        (name, i + 1, row[0], place[matches[row[0]]], row[1 + i] or 0.0)
        for i, name in enumerate(added) for row in rows
    ]
    contributors = rank_loadings(df.sparkSession.createDataFrame(
        long, "component string, number int, variable string, position int, raw double"))
    return Projection(table, added, contributors, len(matches), listed, fuzzy, unreadable,
                      _warnings(len(matches), listed, fuzzy, unreadable, added, max_components))


def _warnings(matched, listed, fuzzy, unreadable, added, max_components) -> list[str]:
    notes = []
    if matched < listed:
        notes.append(f"{listed - matched} of {listed} listed variables are missing, so scores are partial")
    if matched < listed / 2:
        notes.append("fewer than half of the listed variables were found")
    if fuzzy:
        notes.append(f"{fuzzy} variable names matched only after ignoring case and spaces")
    if unreadable:
        notes.append(f"{unreadable} loadings could not be read as numbers and count as 0")
    if len(added) < max_components:
        notes.append(f"the components table defines {len(added)} components")
    return notes
