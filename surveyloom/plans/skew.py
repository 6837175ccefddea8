"""Equi-joins against a unique-key side that stay even when one key is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.numeric import col
from surveyloom.plans.scratch import row_count

# A key is hot when it alone exceeds a quarter of an average shuffle partition.
# At most 4 x partitions keys can do that, which bounds the table of hot keys.
_SLICES_PER_PARTITION = 4
_MIN_HOT_ROWS = 200_000


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str, total: int) -> DataFrame | None:
    """Keys of ``counts`` too large for one task, with the pieces to cut each into.

    ``counts`` holds one row per key. The result is None when nothing is hot and
    never has more than 4 x shuffle-partitions rows, so it is safe to broadcast.
    """
    slices = _SLICES_PER_PARTITION * _partitions(counts)
    limit = max(total / slices, _MIN_HOT_ROWS)
    if total <= limit:
        return None
    hot = (
        counts.filter((F.col(n) > limit) & _present(keys))
        .select(*[col(k) for k in keys], F.ceil(F.col(n) / limit).cast("int").alias("_pieces"))
    )
    rows = hot.collect()
    return counts.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def _present(keys: Sequence[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & col(k).isNotNull()
    return test


def find_hot(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame | None:
    """Hot keys of a table, counted with a map-side combine.

    ``rows`` is an upper bound on its rows when the caller knows one; a table
    too small to have a hot key is not looked at.
    """
    total = row_count(df) if rows is None else rows
    if total <= _MIN_HOT_ROWS:
        return None
    return hot_keys(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, "_n", total)


def lookup(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", rows: int | None = None,
) -> DataFrame:
    """Join ``left`` to ``right`` on ``keys``, splitting keys that are hot on the left."""
    return split_join(left, right, keys, find_hot(left, keys, rows), how)


def split_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame | None, how: str = "left",
) -> DataFrame:
    """The same join with the hot keys already known.

    The rows of a hot key are dealt over several tasks by a hash of all their
    cells and only those keys of ``right`` are repeated. Null keys are dealt out too: they match nothing and
    need not meet in one task.
    """
    keys = list(keys)
    if hot is None:
        return left.join(right, keys, how)
    # A place drawn from the row itself: a task run again deals its rows the same way.
    plain = [col(c) for c, t in left.dtypes if not t.startswith(("map", "variant"))]
    spread = F.xxhash64(*plain)
    dealt = (
        left.join(F.broadcast(hot), keys, "left")
        .withColumn(
            "_piece",
            F.when(~_present(keys), F.pmod(spread, F.lit(_partitions(left))))
            .when(F.col("_pieces").isNotNull(), F.pmod(spread, F.col("_pieces")))
            .otherwise(0)
            .cast("int"),
        )
        .drop("_pieces")
    )
    repeated = (
        right.join(F.broadcast(hot), keys, "left")
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1)))
        .drop("_pieces")
    )
    return dealt.join(repeated, [*keys, "_piece"], how).drop("_piece")
