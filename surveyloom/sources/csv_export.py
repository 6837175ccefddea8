"""CSV export safe to open in a spreadsheet."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions.numeric import NUMBER_PATTERN, cell_text, col, is_text, number_of

# Characters that start a formula, and the byte-order mark.
FORMULA_PATTERN = r"^[=+\-@\t\r]"
BOM = "\ufeff"


def guarded(c: Column) -> Column:
    """Prefix text that would open as a formula with an apostrophe, unless it is a number."""
    risky = c.rlike(FORMULA_PATTERN) & number_of(c, T.StringType()).isNull()
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def guarded_name(name: str) -> str:
    return "'" + name if re.match(FORMULA_PATTERN, name) and not re.match(NUMBER_PATTERN, name.strip()) else name


def export_view(df: DataFrame) -> DataFrame:
    """Every cell as export text: plain numbers, ISO dates, guarded strings, null as empty."""
    return df.select(*[
        F.coalesce(
            guarded(col(f.name)) if is_text(df, f.name) else cell_text(col(f.name), f.dataType), F.lit("")
        ).alias(f.name)
        for f in df.schema
    ])


def encoded(c: Column) -> Column:
    """RFC 4180 quoting of one text cell."""
    return F.when(
        c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(c)


def csv_lines(df: DataFrame) -> DataFrame:
    """One encoded line per row."""
    view = export_view(df)
    return view.select(F.concat_ws(",", *[encoded(col(c)) for c in view.columns]).alias("value"))


def header_line(df: DataFrame) -> str:
    cells = [guarded_name(c) for c in df.columns]
    return ",".join('"' + c.replace('"', '""') + '"' if re.search('[",\r\n]', c) else c for c in cells)


def write_csv(df: DataFrame, path: str) -> None:
    """Write a folder of CSV parts in parallel, each with the header and CRLF lines."""
    view = export_view(df).withColumnsRenamed({c: guarded_name(c) for c in df.columns})
    view.write.csv(path, header=True, escape='"', lineSep="\r\n", emptyValue="", nullValue="",
                   ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_single_csv(df: DataFrame, path: str) -> None:
    """One file with a byte-order mark, for tables meant to be opened by hand."""
    head = df.sparkSession.createDataFrame([(BOM + header_line(df),)], "value string")
    # coalescing a union keeps the order of its parts, so the header comes first
    head.coalesce(1).unionByName(csv_lines(df)).coalesce(1).write.text(path, lineSep="\r\n")
