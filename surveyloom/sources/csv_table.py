"""CSV load and the audit of what the load had to change."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions.numeric import col, is_text, number_of, number_of_stripped, strip
from surveyloom.sources.csv_records import records

# Delimiters tried, characters no typed header contains, and the
# number formats recognised in text columns, strictest first.
DELIMITERS = (",", "\t", "|", ";")
BINARY_PATTERN = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\uFFFD]")
NUMERIC_TEXT_PATTERNS = (
    ("thousands separators", r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"),
    ("decimal commas", r"^-?\d+,\d+$"),
    ("percent signs", r"^-?[\d.]+\s*%$"),
)
NUMERIC_TEXT_SHARE = 0.8
SAMPLE_LINES = 3

AUDIT_SCHEMA = "kind string, n bigint, sample_lines array<bigint>, columns array<string>, detail string"


@dataclass
class Header:
    """The header line as read: original names, names given, and the delimiter."""

    fields: list[str]
    names: list[str | None]
    delimiter: str
    detected: bool

    @property
    def kept(self) -> list[str]:
        return [n for n in self.names if n is not None]

    @property
    def renamed(self) -> dict[str, str]:
        return {n: f for n, f in zip(self.names, self.fields) if n is not None and n != f}


@dataclass
class CsvTable:
    table: DataFrame
    header: Header
    audit: DataFrame


def _cells(line: str, delimiter: str) -> list[str]:
    return next(csv.reader(io.StringIO(line), delimiter=delimiter), [])


def _width(line: Column, delimiter: str) -> Column:
    """Cells of a line, quoted stretches aside."""
    bare = F.regexp_replace(line, r'"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1


def detect_delimiter(lines: DataFrame) -> tuple[str, bool]:
    """The candidate that splits all lines (``value``) most evenly into several cells, from one pass over them."""
    line = F.rtrim(F.col("value"), F.lit("\r"))
    widths = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _width(line, d).alias("width")) for i, d in enumerate(DELIMITERS)]))
    counts = lines.filter(strip(F.col("value")) != "").select(widths.alias("w")).groupBy("w.i", "w.width").agg(F.count(F.lit(1)).alias("n"))
    commonest = F.max(F.struct("n", "width"))
    found = counts.groupBy("i").agg(commonest.alias("top"), F.sum("n").alias("lines")).collect()
    scores = {r["i"]: (r["top"]["n"] / r["lines"], r["top"]["width"]) for r in found if r["top"]["width"] > 1}
    if not scores:
        return ",", False
    return DELIMITERS[max(scores, key=lambda i: (scores[i], -i))], True


def name_columns(fields: list[str]) -> list[str | None]:
    """Blank headers are dropped (None); a repeat gets the first free _1, _2 ... suffix."""
    taken, given = set(fields), []
    seen: set[str] = set()
    for f in fields:
        name = f
        if f.strip() == "":
            given.append(None)
            continue
        if f in seen:
            n = 1
            while f"{f}_{n}" in taken:
                n += 1
            name = f"{f}_{n}"
            taken.add(name)
        seen.add(f)
        given.append(name)
    return given


def read_header(spark: SparkSession, path: str, delimiter: str | None = None) -> Header:
    lines = [r["value"].rstrip("\r").lstrip("\ufeff") for r in spark.read.text(path).limit(1).collect()]
    if not lines:
        raise ValueError(f"{path}: the first line names no column")
    found, detected = (delimiter, True) if delimiter else detect_delimiter(spark.read.text(path))
    fields = _cells(lines[0], found)
    junk = [f for f in fields if BINARY_PATTERN.search(f)]
    if junk and len(junk) >= len(fields) / 2:
        raise ValueError(f"{path}: half of the header or more is binary, so this cannot be a table of text")
    names = name_columns(fields)
    if not any(names):
        raise ValueError(f"{path}: the first line names no column")
    return Header(fields, names, found, detected)


def read_csv(
    spark: SparkSession, path: str, delimiter: str | None = None, multi_line: bool = False, typed: bool = True,
) -> CsvTable:
    """Load a CSV file or folder whose files share one header.

    Names come from the header line itself, so repeats and blanks follow our
    own rules. Without ``delimiter`` all lines are looked at to find it. Blank
    rows are dropped. With ``typed`` a column whose every cell is a number
    becomes double. Quoted line breaks need ``multi_line``: files are still read
    in splits, line breaks inside cells become \\n, and the audit counts records
    instead of lines.
    """
    header = read_header(spark, path, delimiter)
    stored = [f"_c{i}" for i in range(len(header.fields))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in stored])
    options = {"sep": header.delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    if multi_line:
        body = records(spark, path, header.delimiter).filter("number > 1")
        raw = body.select(F.from_csv("text", schema.simpleString()[len("struct<"):-1].replace(":", " "), options).alias("r")).select("r.*")
    else:
        raw = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, **options)
    cells = {c: _csv_cell(F.col(c)) for c in stored}
    blank = F.coalesce(*[cells[c] for c in stored]).isNull()
    named = raw.filter(~blank).select(*[
        cells[c].alias(name) for c, name in zip(stored, header.names) if name is not None])
    table = _typed(named) if typed else named
    return CsvTable(table, header, audit_csv(spark, path, header, named, multi_line))


def _csv_cell(c: Column) -> Column:
    """Trimmed text, blank as null, and the words true and false as 1 and 0."""
    text = strip(c)
    return (
        F.when(text.isin("true", "TRUE"), "1").when(text.isin("false", "FALSE"), "0")
        .otherwise(F.nullif(text, F.lit("")))
    )


def _typed(df: DataFrame) -> DataFrame:
    """Columns whose non-blank cells are all numbers become double; one pass decides."""
    text = T.StringType()
    seen = df.agg(*[
        e for i, c in enumerate(df.columns)
        for e in (F.count(col(c)).alias(f"n{i}"), F.count(number_of(col(c), text)).alias(f"m{i}"))
    ]).first()
    return df.select(*[
        number_of(col(c), text).alias(c) if seen[f"n{i}"] and seen[f"n{i}"] == seen[f"m{i}"] else col(c)
        for i, c in enumerate(df.columns)
    ])


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): text lines with their input split and place in reading order."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")


def with_line_numbers(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Add the 1-based line number inside its file to some of the lines.

    Lines are counted per input split, and the splits of a file in order give
    each split its offset, so files are read in parallel.
    """
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    return rows.join(starts, ["file", "block"]).withColumn("line", F.col("at") - F.col("first") + F.col("skip") + 1)


def _fault(text: Column, header: Header) -> Column:
    """What is wrong with a line or record, if anything."""
    width = _width(text, header.delimiter)
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    blank = strip(F.replace(text, F.lit(header.delimiter), F.lit(""))) == ""
    kind = (
        F.when(quotes % 2 == 1, "open-quote")
        .when(width > len(header.fields), "too-many-cells")
        .when(width < len(header.fields), "too-few-cells")
    )
    return F.when(~blank, kind)


def _record_findings(spark: SparkSession, path: str, header: Header) -> DataFrame:
    """The same for records that may hold line breaks; the first three records instead of lines, the header being the first."""
    found = records(spark, path, header.delimiter, texts=False)
    kind = (
        F.when(F.col("marks") % 2 == 1, "open-quote")
        .when(F.col("cells") > len(header.fields), "too-many-cells")
        .when(F.col("cells") < len(header.fields), "too-few-cells")
    )
    bad = found.filter("number > 1 and filled").select("file", "number", kind.alias("kind")).filter("kind is not null")
    # The first three of each kind pass through a task; the others are counted where they are.
    place = Window.partitionBy("kind").orderBy("file", "number")
    shown = bad.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= SAMPLE_LINES)
    located = shown.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("number").alias("line")))).alias("places"))
    return (
        bad.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(located, "kind")
        .select("kind", "n", F.transform("places", lambda s: s["line"]).alias("sample_lines"),
                F.lit(None).cast("array<string>").alias("columns"), F.lit(None).cast("string").alias("detail"))
    )


def _line_findings(spark: SparkSession, path: str, header: Header) -> DataFrame:
    """Ragged rows and lines that leave a quotation mark open, with the first three lines.

    Only the three lines to show of each kind are numbered; the rest are counted.
    """
    value = F.rtrim(F.col("value"), F.lit("\r"))
    lines = split_lines(spark, path)
    bad = lines.select("file", "block", "at", _fault(value, header).alias("kind")).filter("kind is not null")
    first = Window.partitionBy("kind").orderBy("file", "block", "at")
    shown = bad.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= SAMPLE_LINES)
    located = with_line_numbers(shown, lines).groupBy("kind").agg(
        F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("places"))
    return (
        bad.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(located, "kind")
        .select("kind", "n", F.transform("places", lambda s: s["line"]).alias("sample_lines"),
                F.lit(None).cast("array<string>").alias("columns"), F.lit(None).cast("string").alias("detail"))
    )


def header_findings(header: Header) -> list[tuple]:
    found = []
    blank = sum(n is None for n in header.names)
    if not header.detected and len(header.kept) == 1:
        found.append(("no-delimiter", 1, None, header.kept, None))
    if blank:
        found.append(("blank-header", blank, None, None, None))
    if header.renamed:
        shown = ", ".join(f"{old} -> {new}" for new, old in header.renamed.items())
        found.append(("repeated-header", len(header.renamed), None, list(header.renamed), shown))
    names = header.kept
    if len(names) >= 2 and all(_is_number(n) for n in names):
        found.append(("headerless", len(names), None, names, None))
    junk = [n for n in names if BINARY_PATTERN.search(n)]
    if junk:
        found.append(("unreadable-header", len(junk), None, junk, None))
    return found


def _is_number(text: str) -> bool:
    try:
        return abs(float(text)) != float("inf") and text.strip().lower() != "nan"
    except ValueError:
        return False


def numeric_text(df: DataFrame) -> DataFrame:
    """Text columns that hold numbers in a format not read as numbers.

    A column without any plain number counts when at least 80 % of its cells
    match one format; the first matching format is named.
    """
    columns = [c for c in df.columns if is_text(df, c)]
    schema = "column string, format string, share double"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    texts = df.select(*[F.nullif(strip(col(c)), F.lit("")).alias(f"c{i}") for i, c in enumerate(columns)])
    shares = texts.agg(*[
        e for i in range(len(columns))
        for e in (
            F.count(number_of_stripped(F.col(f"c{i}"))).alias(f"plain{i}"),
            *[F.avg(F.col(f"c{i}").rlike(p).cast("double")).alias(f"share{i}_{j}")
              for j, (_, p) in enumerate(NUMERIC_TEXT_PATTERNS)],
        )
    ])
    formats = []
    for i, c in enumerate(columns):
        named = share = None
        for j, (label, _) in reversed(list(enumerate(NUMERIC_TEXT_PATTERNS))):
            hit = F.col(f"share{i}_{j}") >= NUMERIC_TEXT_SHARE
            named = F.when(hit, label) if named is None else F.when(hit, label).otherwise(named)
            share = F.when(hit, F.col(f"share{i}_{j}")) if share is None else F.when(hit, F.col(f"share{i}_{j}")).otherwise(share)
        formats.append(F.struct(
            F.lit(c).alias("column"), F.when(F.col(f"plain{i}") == 0, named).alias("format"), share.alias("share")))
    return shares.select(F.inline(F.array(*formats))).filter("format is not null")


def parse_numeric_text(df: DataFrame, column: str, style: str) -> DataFrame:
    """Opt-in conversion of a column named by ``numeric_text`` to double."""
    text = strip(col(column))
    if style == "thousands separators":
        plain = F.regexp_replace(text, ",", "")
    elif style == "decimal commas":
        plain = F.regexp_replace(text, ",", ".")
    elif style == "percent signs":
        plain = F.regexp_replace(text, r"\s*%$", "")
    else:
        raise ValueError(f"unknown number format {style}")
    return df.withColumn(column, number_of(plain, T.StringType()))


def _text_findings(df: DataFrame) -> DataFrame:
    return numeric_text(df).groupBy("format").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("column")).alias("columns"),
    ).select(F.lit("numeric-text").alias("kind"), "n", F.lit(None).cast("array<bigint>").alias("sample_lines"),
             "columns", F.col("format").alias("detail"))


def audit_csv(spark: SparkSession, path: str, header: Header, table: DataFrame, multi_line: bool = False) -> DataFrame:
    """Everything the load changed or found odd, one row per kind; runs only when read."""
    heads = spark.createDataFrame(header_findings(header), AUDIT_SCHEMA)
    rows = _record_findings(spark, path, header) if multi_line else _line_findings(spark, path, header)
    return heads.unionByName(rows).unionByName(_text_findings(table))


def audit_table(df: DataFrame) -> DataFrame:
    """Findings for an already typed table: no rows, and dates that can only be labels."""
    dates = [f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    found = []
    if df.isEmpty():
        found.append(("no-rows", 0, None, None, None))
    if dates:
        found.append(("dates-as-text", len(dates), None, dates, None))
    return df.sparkSession.createDataFrame(found, AUDIT_SCHEMA)


