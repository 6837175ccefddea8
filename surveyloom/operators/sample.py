"""Seeded samples and decimation, addressed by row id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.numeric import col
from surveyloom.operators.missing import complete_test

SAMPLE_SEED = 7
# Fixed value: about how many rows a background layer shows.
SHADOW_ROWS = 4000


def draw_order(row_id: str, seed: int = SAMPLE_SEED) -> Column:
    """A random order of the rows that only their id and the seed decide."""
    return F.md5(F.concat(col(row_id).cast("string"), F.lit(f"-{seed}")).cast("binary"))


def seeded_sample(df: DataFrame, columns: Sequence[str], row_id: str, cap: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """Up to ``cap`` rows complete in the columns, the same ones on every run and layout.

    Rows are drawn at random and not by stride, which on ordered files would
    land on one stratum. Every task keeps its own first ``cap`` rows of the
    random order, so nothing is sorted as a whole.
    """
    return df.filter(complete_test(df, columns)).orderBy(draw_order(row_id, seed), col(row_id)).limit(cap)


def decimate(df: DataFrame, row_id: str, target: int = SHADOW_ROWS) -> DataFrame:
    """Every stride-th row by id, about ``target`` rows, for a background layer."""
    stride = max(1, -(-df.count() // target))
    return df.filter(F.pmod(col(row_id), F.lit(stride)) == 0)
