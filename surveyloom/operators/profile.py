"""Column profiles: what each column of a table holds, in shared passes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions import names
from surveyloom.functions.numeric import (
    as_number, can_hold_numbers, col, finite, is_text, label_of, number_of_stripped, number_text, round_half_up,
    strip,
)
from surveyloom.operators.column_facts import gather_facts
from surveyloom.plans.ranking import nearest_rank, order_statistics

# Limits of the column kinds, the small-cell threshold and the
# sizes of the summary lists.
CONTINUOUS_ABOVE = 20
TOO_MANY_ABOVE = 50
MIN_AGGREGATE_COUNT = 5
TOP_CATEGORIES = 8
TOP_PROPORTIONS = 6
HISTOGRAM_BINS = 14
MAX_SHAPE_LEVELS = 6
MAX_COLOR_LEVELS = 20
SCALE_RATIO = 3

_COLUMNS_PER_JOB = 60


def present(df: DataFrame, name: str) -> Column:
    """The cell after load rules: blank text, NaN and infinities are missing."""
    dtype = df.schema[name].dataType
    if is_text(df, name):
        return F.nullif(strip(col(name)), F.lit(""))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return finite(col(name).cast("double"))
    return col(name)


def long_values(df: DataFrame, columns: Sequence[str], labels: bool = True) -> DataFrame:
    """One row per non-missing cell: column index, number or text, in one unpivot.

    Dates become ISO labels, or with ``labels=False`` any distinct text.
    """
    label = partial(label_of, df) if labels else (lambda name: col(name).cast("string"))
    entries = []
    for i, name in enumerate(columns):
        dtype = df.schema[name].dataType
        numeric = can_hold_numbers(dtype) and not is_text(df, name)
        number = as_number(df, name) if numeric else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if numeric else (
            present(df, name) if is_text(df, name) else label(name))
        entries.append(F.struct(F.lit(i).alias("idx"), number.alias("num"), text.alias("txt")))
    return df.select(F.inline(F.array(*entries))).filter("num is not null or txt is not null")


def value_counts(df: DataFrame, columns: Sequence[str], labels: bool = True) -> DataFrame:
    """(idx, num, txt, n): how often each distinct value occurs in each column."""
    return long_values(df, columns, labels).groupBy("idx", "num", "txt").agg(F.count(F.lit(1)).alias("n"))


def scan_columns(df: DataFrame, columns: Sequence[str] | None = None, exact_distinct: bool = True) -> DataFrame:
    """One row per column: missing, numeric or not, range, distinct values, kind.

    One pass finds all but the distinct counts above 50 with a bounded amount leaving each task; columns with
    more than that are counted in full in a second one, or with ``exact_distinct=False`` estimated from the
    sketch of the first. The kind is the same either way. Up to 50 texts are told apart by 64-bit hashes.
    """
    columns = list(columns or df.columns)
    parts = [
        _scan_batch(df, columns[i : i + _COLUMNS_PER_JOB], i, exact_distinct)
        for i in range(0, len(columns), _COLUMNS_PER_JOB)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _cells_to_scan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What ``gather_facts`` reads: numbers of number columns, hashes, numbers and flags of text, hashes of the rest.

    Text is stripped once here, and hashes leave the JVM in its place.
    """
    dtypes = [df.schema[c].dataType for c in columns]
    numbers = [can_hold_numbers(t) and not is_text(df, c) for c, t in zip(columns, dtypes)]
    cells = df.select(*[
        as_number(df, c).alias(f"m{i}") if numbers[i] else
        (present(df, c) if is_text(df, c) else col(c).cast("string")).alias(f"c{i}") for i, c in enumerate(columns)])
    views = []
    for i, c in enumerate(columns):
        if numbers[i]:
            views.append(F.col(f"m{i}"))
            continue
        cell = F.col(f"c{i}")
        views.append(F.when(cell.isNotNull(), F.xxhash64(cell)).alias(f"h{i}"))
        if is_text(df, c):
            views += [number_of_stripped(cell).alias(f"m{i}"), cell.isin("true", "false").alias(f"t{i}")]
    return cells.select(*views)


def _scan_batch(df, columns, first, exact_distinct):
    found = gather_facts(_cells_to_scan(df, columns), len(columns), TOO_MANY_ABOVE)
    rows, many = [], []
    for i, (name, facts) in enumerate(zip(columns, found)):
        exact, estimate = facts.distinct()
        if exact is None:
            many.append(name)
        able = can_hold_numbers(df.schema[name].dataType)
        numbers = able and not is_text(df, name)
        kind = ("continuous" if numbers and estimate > CONTINUOUS_ABOVE
                else "too-many" if not numbers and estimate > TOO_MANY_ABOVE else "categorical")
        rows.append((i, name, first + i, facts.rows - facts.present, facts.lo is not None, facts.lo, facts.hi, estimate, kind,
                     able and facts.present > 0 and facts.flag))
    scan = df.sparkSession.createDataFrame(
        rows, "idx int, column string, position int, missing bigint, is_numeric boolean, min double, max double, "
        "known bigint, kind string, boolean_like boolean")
    unique = F.col("known")
    if exact_distinct and many:
        scan, unique = scan.join(_distinct(df, columns, many), "idx", "left"), F.coalesce("exact", "known")
    return scan.select(
        "column", "position", "missing", "is_numeric", "min", "max", unique.alias("n_unique"), "kind", "boolean_like")


def _distinct(df, columns, counted):
    place = {name: i for i, name in enumerate(columns)}
    real = F.element_at(F.array(*[F.lit(place[c]) for c in counted]), F.col("idx") + 1)
    return (
        value_counts(df, counted, labels=False).groupBy("idx").agg(F.count(F.lit(1)).alias("exact"))
        .select(real.alias("idx"), "exact")
    )


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns holding at least one number; typed columns of text need a look at the data."""
    able = [c for c in df.columns if can_hold_numbers(df.schema[c].dataType)]
    if not able:
        return []
    counts = df.agg(*[F.count(as_number(df, c)).alias(f"c{i}") for i, c in enumerate(able)]).first()
    return [c for i, c in enumerate(able) if counts[f"c{i}"]]


def categorical_columns(df: DataFrame) -> list[str]:
    scan = scan_columns(df, exact_distinct=False).filter("kind = 'categorical'")
    return [r["column"] for r in scan.orderBy("position").collect()]


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Shape of each numeric column, rounded to four places.

    sd is the population form; quartiles are the value at position
    min(n-1, floor(share*n)) of the sorted column, not an interpolation.
    """
    columns = list(columns or numeric_columns(df))
    views = {c: as_number(df, c) for c in columns}
    totals = df.agg(*[
        f.alias(f"{tag}{i}")
        for i, c in enumerate(columns)
        for tag, f in (("present", F.count(present(df, c))), ("n", F.count(views[c])),
                       ("mean", F.avg(views[c])), ("sd", F.stddev_pop(views[c])),
                       ("min", F.min(views[c])), ("max", F.max(views[c])))
    ], F.count(F.lit(1)).alias("rows")).first()
    shares = [nearest_rank(s) for s in (0.25, 0.5, 0.75)]
    quartiles = order_statistics(df, views, lambda n: [at(n) for at in shares])
    rows = []
    for i, c in enumerate(columns):
        q1, median, q3 = quartiles[c]
        rows.append((c, i, totals["rows"] - totals[f"present{i}"], totals[f"n{i}"], totals[f"min{i}"],
                     totals[f"max{i}"], totals[f"mean{i}"], totals[f"sd{i}"], q1, median, q3))
    profile = df.sparkSession.createDataFrame(
        rows, "column string, position int, missing bigint, n bigint, min double, max double, "
              "mean double, sd double, q1 double, median double, q3 double")
    rounded = ["min", "max", "mean", "sd", "q1", "median", "q3"]
    return profile.select("column", "position", "missing", "n",
                          *[round_half_up(F.col(c), 4).alias(c) for c in rounded])


def categorical_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct and withheld values per column, and its most frequent safe values.

    A value covering fewer than five rows is counted but never named, and a
    column named like an identifier is withheld whole. Columns with nothing to
    name keep one row with a null value.
    """
    columns = list(columns)
    counts = value_counts(df, columns)
    guarded = F.array(*[F.lit(names.is_identifier(c)) for c in columns])
    safe = (F.col("n") >= MIN_AGGREGATE_COUNT) & ~F.element_at(guarded, F.col("idx") + 1)
    summary = counts.groupBy("idx").agg(
        F.count(F.lit(1)).alias("n_unique"), F.count_if(~safe).alias("withheld"), F.sum("n").alias("_present"))
    best = Window.partitionBy("idx").orderBy(F.desc("n"), F.col("txt"))
    top = (
        counts.filter(safe)
        .select("idx", F.coalesce("txt", number_text(F.col("num"))).alias("txt"), "n")
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= TOP_CATEGORIES)
    )
    described = df.sparkSession.createDataFrame(
        [(i, c) for i, c in enumerate(columns)], "idx int, column string")
    rows = df.agg(F.count(F.lit(1))).scalar()
    return (
        described.join(summary, "idx", "left")
        .join(top, "idx", "left")
        .select(
            "column",
            (rows - F.coalesce("_present", F.lit(0))).alias("missing"),
            F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
            F.coalesce("withheld", F.lit(0)).alias("withheld"),
            "rank", F.col("txt").alias("value"), F.col("n").alias("count"),
        )
    )


def histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fourteen equal bins from min to max, each also as a share of the tallest bin.

    A column with fewer than two numbers, or a constant one, gives no rows.
    """
    columns = list(columns)
    views = [as_number(df, c) for c in columns]
    edges = df.agg(*[
        f(v).alias(f"{tag}{i}") for i, v in enumerate(views)
        for tag, f in (("n", F.count), ("lo", F.min), ("hi", F.max))
    ]).first()
    entries, usable = [], []
    for i, v in enumerate(views):
        lo, hi = edges[f"lo{i}"], edges[f"hi{i}"]
        if edges[f"n{i}"] < 2 or lo == hi:
            continue
        usable.append(i)
        bin_no = F.least(F.lit(HISTOGRAM_BINS - 1), F.floor((v - lo) * (HISTOGRAM_BINS / (hi - lo))).cast("int"))
        entries.append(F.struct(F.lit(i).alias("idx"), bin_no.alias("bin")))
    spark = df.sparkSession
    if not usable:
        return spark.createDataFrame([], "column string, bin int, n bigint, height double")
    counts = (
        df.select(F.inline(F.array(*entries))).filter("bin is not null")
        .groupBy("idx", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    frame = spark.createDataFrame(
        [(i, columns[i], b) for i in usable for b in range(HISTOGRAM_BINS)], "idx int, column string, bin int")
    peak = F.max("n").over(Window.partitionBy("idx"))
    return (
        frame.join(counts, ["idx", "bin"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .select("column", "bin", "n", (F.col("n") / peak).alias("height"))
    )


def proportions(df: DataFrame, name: str) -> DataFrame:
    """Share of non-missing rows held by each of the six commonest values."""
    counts = (
        df.select(label_of(df, name).alias("value")).filter("value is not null")
        .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    )
    total = counts.agg(F.sum("n")).scalar()
    return (
        counts.orderBy(F.desc("n"), "value").limit(TOP_PROPORTIONS)
        .select("value", "n", (F.col("n") / total).alias("share"))
    )


def shape_levels(df: DataFrame, name: str) -> DataFrame:
    """Levels of a marker-shape column; no rows when there are more than six."""
    levels = df.select(F.coalesce(label_of(df, name), F.lit("N/A")).alias("level")).distinct()
    found = levels.limit(MAX_SHAPE_LEVELS + 1).collect()
    return df.sparkSession.createDataFrame(found if len(found) <= MAX_SHAPE_LEVELS else [], "level string")


def bounds(df: DataFrame, axes: Sequence[str], color: str | None = None, hidden: Sequence[str] = ()) -> DataFrame:
    """Range of each axis over the visible rows, and the floor under the last one."""
    rows = df
    if color and hidden:
        rows = df.filter(~F.coalesce(label_of(df, color), F.lit("N/A")).isin(*hidden))
    ranges = rows.agg(*[
        f(as_number(df, a)).alias(f"{axis}_{tag}")
        for axis, a in zip("xyz", axes) for tag, f in (("min", F.min), ("max", F.max))
    ])
    if len(axes) < 3:
        return ranges
    span = F.col("z_max") - F.col("z_min")
    return ranges.withColumn("floor", F.col("z_min") - F.when(span > 0, span * 0.08).otherwise(0.5))


def eps_range(df: DataFrame, axes: Sequence[str], standardize: bool) -> tuple[float, float]:
    """Largest sensible eps for the given axes and the step to adjust it by."""
    top = 5.0
    if not standardize:
        spans = df.agg(*[
            (F.max(as_number(df, a)) - F.min(as_number(df, a))).alias(f"s{i}") for i, a in enumerate(axes)
        ]).first()
        widest = max((s for s in spans if s), default=0)
        if widest > 0:
            top = max(1.0, float(int(widest / 2 + 0.5)))
    return top, max(0.001, int(top / 100 * 1000 + 0.5) / 1000)


def default_axes(df: DataFrame) -> tuple[str | None, str | None, str | None]:
    """Component scores when at least two exist, else the first measured columns."""
    scores = [c for c in ("PC1", "PC2", "PC3") if c in df.columns]
    if len(scores) < 2:
        numeric = numeric_columns(df)
        measured = [c for c in numeric if not names.is_identifier(c)]
        scores = measured if len(measured) >= 2 else numeric
    x, y, z = [*scores[:3], None, None, None][:3]
    return x, y, z


def default_color(df: DataFrame, current: str = "") -> str:
    """The short categorical column that makes the clearest first colouring."""
    if current and current in df.columns:
        return current
    if "Cluster" in df.columns:
        return "Cluster"
    candidates = [c for c in df.columns if not names.is_identifier(c)]
    if candidates:
        scan = scan_columns(df, candidates, exact_distinct=False)
        best = (
            scan.filter(F.col("n_unique").between(2, MAX_COLOR_LEVELS) & ~F.col("boolean_like"))
            .orderBy("n_unique", "position").first()
        )
        if best:
            return best["column"]
        return candidates[0]
    return df.columns[0] if df.columns else ""


def suggest_standardize(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether distances should be taken on z-scores: scales differ more than threefold."""
    if columns and all(names.is_score_column(c) for c in columns):
        return False
    spans = df.agg(*[
        (F.max(as_number(df, c)) - F.min(as_number(df, c))).alias(f"s{i}") for i, c in enumerate(columns)
    ]).first()
    spans = [s for s in spans if s is not None and s > 0]
    return len(spans) >= 2 and max(spans) / min(spans) > SCALE_RATIO
