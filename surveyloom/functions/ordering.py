"""Orders for picking one row of many that do not depend on the layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.numeric import col


def row_text(df: DataFrame) -> Column:
    """All cells of a row as one text; equal rows have equal texts."""
    return F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"})


def earliest(df: DataFrame, at: str) -> Column:
    """The row with the least ``at`` as a struct; a null ``at`` comes last, ties go by the rows' contents."""
    return F.min_by(F.struct(*[col(c) for c in df.columns]), F.struct(col(at).isNull(), col(at), row_text(df)))


def latest(df: DataFrame, at: str) -> Column:
    """The row with the largest ``at`` as a struct; a null ``at`` comes last, ties go by the rows' contents."""
    return F.max_by(F.struct(*[col(c) for c in df.columns]), F.struct(col(at).isNotNull(), col(at), row_text(df)))
