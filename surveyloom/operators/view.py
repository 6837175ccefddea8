"""Rows prepared for a plot: visibility, viewport, colour and shape indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions.numeric import as_number, col, label_of
from surveyloom.operators.crosstab import MISSING_LABEL, category_index, natural_order
from surveyloom.operators.profile import scan_columns, shape_levels
from surveyloom.plans.skew import lookup

# Palette length and the limits of one pan step.
PALETTE = 10
PAN_LIMITS = (0.05, 2.0)

_FEW_LEVELS = 50


def visible_rows(df: DataFrame, column: str, hidden: Sequence[str]) -> DataFrame:
    """Drop the hidden categories; a name that is no category is an error."""
    label = F.coalesce(label_of(df, column), F.lit(MISSING_LABEL))
    if not hidden:
        return df
    known = {r[0] for r in df.select(label.alias("v")).filter(F.col("v").isin(*hidden)).distinct().collect()}
    unknown = [h for h in hidden if h not in known]
    if unknown:
        raise ValueError("no such categories: " + ", ".join(unknown))
    return df.filter(~label.isin(*hidden))


def zoomed(window: tuple[float, float], factor: float) -> tuple[float, float]:
    if not factor > 0:
        raise ValueError("zoom must be above 0")
    middle, half = (window[0] + window[1]) / 2, (window[1] - window[0]) / 2 / factor
    return middle - half, middle + half


def panned(x: tuple[float, float], y: tuple[float, float], direction: str, amount: float = 0.5):
    """Move the window by a fraction of its span, kept between 5 % and 200 %."""
    share = min(max(amount, PAN_LIMITS[0]), PAN_LIMITS[1])
    moves = {"left": (-1, 0), "right": (1, 0), "down": (0, -1), "up": (0, 1)}
    if direction not in moves:
        raise ValueError("pan left, right, up or down")
    dx, dy = moves[direction]
    shift = lambda w, s: (w[0] + s * share * (w[1] - w[0]), w[1] + s * share * (w[1] - w[0]))
    return shift(x, dx), shift(y, dy)


def viewport(df: DataFrame, x: str, y: str, x_window: tuple[float, float], y_window: tuple[float, float]) -> DataFrame:
    return df.filter(as_number(df, x).between(*x_window) & as_number(df, y).between(*y_window))


def _with_places(rows: DataFrame, df: DataFrame, name: str, label: str, index: str) -> DataFrame:
    """Add the place of each row's label in natural order.

    Few levels are sent to every task, after they have been counted; more are
    looked up in shuffled pieces.
    """
    levels = df.select(F.coalesce(label_of(df, name), F.lit(MISSING_LABEL)).alias(label)).distinct().limit(_FEW_LEVELS + 1).collect()
    if len(levels) > _FEW_LEVELS:
        return lookup(rows, category_index(df, name).select(F.col("label").alias(label), F.col("index").alias(index)), [label])
    known = df.sparkSession.createDataFrame(levels, f"{label} string")
    place = F.row_number().over(Window.orderBy(natural_order(F.col(label)))) - 1
    return rows.join(F.broadcast(known.select(label, place.cast("bigint").alias(index))), label, "left")


def view_rows(df: DataFrame, axes: Sequence[str], color: str, shape: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Coordinates with the colour and shape of each row.

    A categorical colour gets the place of its label in natural order and a
    palette slot; a continuous one keeps its value and the range of the column.
    A shape column with more than six levels is ignored.
    """
    z = as_number(df, axes[2]) if len(axes) > 2 else F.lit(0.0)
    kind = scan_columns(df, [color], exact_distinct=False).first()
    rows = df.select(
        *[col(k) for k in keep], as_number(df, axes[0]).alias("x"), as_number(df, axes[1]).alias("y"), z.alias("z"),
        F.coalesce(label_of(df, color), F.lit(MISSING_LABEL)).alias("color"), as_number(df, color).alias("color_value"),
        (F.coalesce(label_of(df, shape), F.lit(MISSING_LABEL)) if shape else F.lit(None).cast("string")).alias("shape"),
    )
    if kind["kind"] == "categorical":
        rows = _with_places(rows, df, color, "color", "color_index")
    else:
        rows = rows.withColumn("color_index", F.lit(None).cast("bigint"))
    if shape and not shape_levels(df, shape).isEmpty():
        rows = _with_places(rows, df, shape, "shape", "shape_index")
    else:
        rows = rows.withColumn("shape", F.lit(None).cast("string")).withColumn("shape_index", F.lit(None).cast("bigint"))
    continuous = kind["kind"] == "continuous"
    return rows.select(
        *[col(k) for k in keep], "x", "y", "z", "color", "color_index",
        F.pmod("color_index", F.lit(PALETTE)).alias("palette"),
        *[(e if continuous else F.lit(None).cast("double")).alias(n) for n, e in (
            ("color_value", F.col("color_value")), ("color_min", F.lit(kind["min"])), ("color_max", F.lit(kind["max"])))],
        "shape", "shape_index",
    )


def traces(rows: DataFrame) -> DataFrame:
    """One row per colour and shape combination, colour first."""
    return (
        rows.groupBy("color_index", "shape_index", "color", "shape").agg(F.count(F.lit(1)).alias("n"))
        .orderBy("color_index", "shape_index")
    )
