"""The one rule for "is this cell a number", and number formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text forms that count as a finite decimal number, and the
# characters stripped around a cell before it is read.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
BLANK_CHARACTERS = (
    " \t\n\x0b\x0c\r\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

_BLANKS = "[" + BLANK_CHARACTERS + "]*"
_PADDED_NUMBER = "^" + _BLANKS + NUMBER_PATTERN[1:-1] + _BLANKS + "$"

_EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.BooleanType)
_FLOATING = (T.FloatType, T.DoubleType)


def col(name: str) -> Column:
    """Reference a column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK_CHARACTERS))


def finite(c: Column) -> Column:
    """Null out NaN and the infinities of a double."""
    # NaN sorts above infinity, so one comparison rules out both
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def number_of(c: Column, dtype: T.DataType) -> Column:
    """The cell as a double, or null when it is not a finite number.

    Text is guarded by a pattern first, because a cast alone would also accept
    '5d', 'inf' and 'NaN'. Dates and nested values are never numbers.
    """
    if isinstance(dtype, _EXACT):
        return c.cast("double")
    if isinstance(dtype, _FLOATING):
        return finite(c.cast("double"))
    if isinstance(dtype, T.StringType):
        return finite(F.when(c.rlike(_PADDED_NUMBER), strip(c).try_cast("double")))
    return F.lit(None).cast("double")


def number_of_stripped(c: Column) -> Column:
    """The same rule for text that has been stripped already."""
    return finite(F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double")))


def as_number(df: DataFrame, name: str) -> Column:
    return number_of(col(name), df.schema[name].dataType)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def can_hold_numbers(dtype: T.DataType) -> bool:
    return isinstance(dtype, _EXACT + _FLOATING + (T.StringType,))


def number_text(c: Column) -> Column:
    """A double written plainly: 5 rather than 5.0, no exponent for ordinary sizes."""
    magnitude = F.abs(c)
    whole = (c == F.floor(c).cast("double")) & (magnitude < 1e18)
    plain = F.rtrim(c.cast("string").try_cast("decimal(38,18)").cast("string"), F.lit("0"))
    return (
        F.when(whole, F.floor(c).cast("string"))
        .when((magnitude >= 1e-6) & (magnitude < 1e18), F.coalesce(plain, c.cast("string")))
        .otherwise(c.cast("string"))
    )


def cell_text(c: Column, dtype: T.DataType) -> Column:
    """How a cell reads as a label: numbers plainly, dates as ISO-8601 in UTC."""
    if isinstance(dtype, _FLOATING):
        return number_text(finite(c.cast("double")))
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("string")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        instant = c.cast("timestamp")
        if isinstance(dtype, T.TimestampType):
            instant = F.to_utc_timestamp(instant, F.current_timezone())
        return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return c.cast("string")


def label_of(df: DataFrame, name: str) -> Column:
    return cell_text(col(name), df.schema[name].dataType)


def key_text(df: DataFrame, name: str) -> Column:
    """A join key that treats 5, 5.0 and "5" alike; null stays null."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return F.coalesce(number_text(number_of(col(name), dtype)), strip(col(name)))
    return cell_text(col(name), dtype)


def round_half_up(c: Column, places: int) -> Column:
    """Round with halves toward +infinity, leaving values too large to scale alone."""
    scale = float(10**places)
    return F.when(F.abs(c) < 1e17 / scale, F.floor(c * scale + 0.5) / scale).otherwise(c)
