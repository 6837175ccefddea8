"""Global positions without a single-partition window, and exact order statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.plans.scratch import materialize

_ACCURACY = 2000
_READ_OUT = 4096
_COLUMNS_PER_PASS = 16


def running_counts(counts: DataFrame, value: str, n: str) -> DataFrame:
    """Add ``before``: how much weight lies strictly below each distinct value.

    ``counts`` has one row per distinct value, so a value shared by a third of
    the input is one row here. Rows are range-partitioned once; the per-range
    totals (one row per partition) give each range its starting offset.
    """
    ranged = materialize(
        counts.select(F.col(value), F.col(n))
        .repartitionByRange(F.col(value))
        .withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.sum(n).alias("_sum")).select(
        "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(n).over(within), F.lit(0)))
        .join(F.broadcast(offsets), "_range")  # one row per partition
        .select(value, n, (F.col("_offset") + F.col("_inside")).alias("before"))
    )


def midranks(df: DataFrame, value: str, n: str) -> DataFrame:
    """Average rank of each distinct value; ``n`` is the weight of a row."""
    counts = df.groupBy(value).agg(F.sum(n).alias("_n"))
    ranked = running_counts(counts, value, "_n")
    return ranked.select(value, (F.col("before") + (F.col("_n") + 1) / 2).alias("rank"))


def dense_index(df: DataFrame, value: str, name: str) -> DataFrame:
    """Number the distinct values of a column 0, 1, 2 ... in ascending order."""
    counts = df.select(value).distinct().withColumn("_n", F.lit(1).cast("bigint"))
    return running_counts(counts, value, "_n").select(value, F.col("before").cast("bigint").alias(name))


def order_statistics(
    df: DataFrame,
    values: dict[str, Column],
    ranks: Callable[[int], Sequence[int]],
) -> dict[str, list[float | None]]:
    """Exact values at given 0-based positions of each column's sorted numbers.

    A quantile sketch brackets every position, exact counts say where it lies
    between the ends of the bracket, and brackets of few rows are read out. Each
    round leaves about 4 / ``_ACCURACY`` of a bracket's rows, whatever the
    values, so even 10^12 rows take three rounds of two passes; nothing is sorted
    or shuffled but sketches and counts. ``ranks`` maps a column's count of
    non-null values to positions; a column without values yields Nones.
    """
    names = list(values)
    found: dict[str, list[float | None]] = {}
    for start in range(0, len(names), _COLUMNS_PER_PASS):
        batch = {name: values[name] for name in names[start : start + _COLUMNS_PER_PASS]}
        found.update(_order_statistics(df, batch, ranks))
    return found


@dataclass
class _Place:
    """A position sought strictly between two values (None: no bound), with the counts up to them."""

    column: int
    slot: int
    rank: int
    below: int
    upto: int
    low: float | None = None
    high: float | None = None

    def inside(self) -> Column:
        v = F.col(f"v{self.column}")
        test = v.isNotNull()
        if self.low is not None:
            test = test & (v > F.lit(self.low))
        return test if self.high is None else test & (v < F.lit(self.high))

    def settle(self, low: float, high: float, counts: Sequence[int]) -> float | None:
        """Take over exact counts of rows below and at both ends; the value if it is one of them."""
        below_low, at_low, below_high, at_high = counts
        if self.rank < below_low:
            self.upto, self.high = below_low, low
        elif self.rank < below_low + at_low:
            return low
        elif self.rank < below_high:
            self.below, self.upto, self.low, self.high = below_low + at_low, below_high, low, high
        elif self.rank < below_high + at_high:
            return high
        else:
            self.below, self.low = below_high + at_high, high
        return None


def _order_statistics(df, values, ranks):
    names = list(values)
    view = df.select(*[values[name].alias(f"v{i}") for i, name in enumerate(names)])
    counts = view.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))]).first()
    result, open_ = {}, []
    for i, name in enumerate(names):
        n = counts[f"n{i}"]
        positions = list(ranks(n or 1))
        result[name] = [None] * len(positions)
        open_ += [_Place(i, slot, rank, 0, n) for slot, rank in enumerate(positions) if n]
    while open_:
        few = [p for p in open_ if p.upto - p.below <= _READ_OUT]
        many = [p for p in open_ if p.upto - p.below > _READ_OUT]
        for place, value in [*_read_out(view, few), *_bracket(view, many)]:
            if value is not None:
                result[names[place.column]][place.slot] = value
        open_ = [p for p in many if result[names[p.column]][p.slot] is None]
    return result


def _read_out(view: DataFrame, places: list[_Place]) -> list[tuple[_Place, float]]:
    """The values of brackets with at most ``_READ_OUT`` rows each."""
    brackets = sorted({(p.column, p.low, p.high): p for p in places}.items(), key=lambda kv: repr(kv[0]))
    if not brackets:
        return []
    entries = [F.struct(F.when(p.inside(), t).alias("t"), F.col(f"v{p.column}").alias("v")) for t, (_, p) in enumerate(brackets)]
    rows = view.select(F.inline(F.array(*entries))).filter("t is not null").collect()
    held = {key: sorted(r["v"] for r in rows if r["t"] == t) for t, (key, _) in enumerate(brackets)}
    return [(p, held[(p.column, p.low, p.high)][p.rank - p.below]) for p in places]


def _bracket(view: DataFrame, places: list[_Place]) -> list[tuple[_Place, float | None]]:
    """One pass for sketches, one for exact counts at the ends they name."""
    if not places:
        return []
    # One sketch for each bracket, however many positions it holds.
    brackets: dict[tuple, list[int]] = {}
    for i, p in enumerate(places):
        brackets.setdefault((p.column, p.low, p.high), []).append(i)
    sketches, ends = [], {}
    for t, held in enumerate(brackets.values()):
        around = []
        for i in held:
            p = places[i]
            share, slack = (p.rank - p.below) / (p.upto - p.below), 1.5 / _ACCURACY
            around += [max(0.0, share - slack), min(1.0, share + slack)]
        first = places[held[0]]
        sketches.append(F.percentile_approx(F.when(first.inside(), F.col(f"v{first.column}")), around, _ACCURACY).alias(f"e{t}"))
    named = view.agg(*sketches).first()
    for t, held in enumerate(brackets.values()):
        ends |= {i: named[f"e{t}"][2 * j:2 * j + 2] for j, i in enumerate(held)}
    tests = []
    for i, p in enumerate(places):
        v = F.col(f"v{p.column}")
        for j, end in enumerate(ends[i]):
            tests += [F.count_if(v < F.lit(end)).alias(f"b{i}_{j}"), F.count_if(v == F.lit(end)).alias(f"a{i}_{j}")]
    counted = view.agg(*tests).first()
    return [(p, p.settle(*ends[i], [counted[f"{t}{i}_{j}"] for j in (0, 1) for t in "ba"])) for i, p in enumerate(places)]


def medians(df: DataFrame, values: dict[str, Column]) -> dict[str, float | None]:
    """Exact median of each column: the mean of the middle two for an even count."""
    middle = order_statistics(df, values, lambda n: ((n - 1) // 2, n // 2))
    return {name: None if lo is None else (lo + hi) / 2 for name, (lo, hi) in middle.items()}


def nearest_rank(share: float) -> Callable[[int], int]:
    """Position min(n-1, floor(share*n)) of a sorted column."""
    return lambda n: min(n - 1, int(share * n))
