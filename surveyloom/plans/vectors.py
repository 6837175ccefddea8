"""Sums of vectors and cross products over a whole table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EXPRESSION_COLUMNS = 12
_FAN_IN = 64
PARTIAL_SCHEMA = "key int, vec array<double>"


def partial_batch(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    keys = sorted(sums)
    return pa.RecordBatch.from_pydict({
        "key": pa.array(keys, pa.int32()),
        "vec": pa.array([sums[k] for k in keys], pa.list_(pa.float64())),
    })


def _add_up(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for key, vec in zip(batch.column("key").to_pylist(), batch.column("vec")):
            values = vec.values.to_numpy(zero_copy_only=False)
            sums[key] = sums[key] + values if key in sums else values.copy()
    yield partial_batch(sums)


def tree_sum(partials: DataFrame, plain_scan: bool = False) -> dict[int, np.ndarray]:
    """Add partial vectors by key in levels, so no task or driver sees them all at once.

    Over a plain table scan the number of partials is known beforehand and a
    few go straight to the driver; otherwise one level of adding always runs.
    """
    if plain_scan:
        width = partials.rdd.getNumPartitions()
    else:
        width = _FAN_IN
        partials = partials.repartition(width).mapInArrow(_add_up, PARTIAL_SCHEMA)
    while width > _FAN_IN:
        width = -(-width // _FAN_IN)
        partials = partials.repartition(width).mapInArrow(_add_up, PARTIAL_SCHEMA)
    sums: dict[int, np.ndarray] = {}
    for row in partials.collect():
        vec = np.asarray(row["vec"])
        sums[row["key"]] = sums[row["key"]] + vec if row["key"] in sums else vec
    return sums


def matrix_of(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Columns of an Arrow batch as a dense matrix, nulls as NaN."""
    columns = [batch.column(name).to_numpy(zero_copy_only=False).astype(float, copy=False) for name in names]
    return np.column_stack(columns) if columns else np.empty((batch.num_rows, 0))


def cross_products(df: DataFrame, views: Sequence[Column], center: Sequence[float]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, sums and cross products of the centered columns.

    Narrow inputs are plain aggregate expressions; wide ones accumulate one
    matrix per partition with BLAS and add the matrices up in a tree.
    """
    p = len(views)
    centered = df.select(*[(v - F.lit(float(c))).alias(f"x{i}") for i, (v, c) in enumerate(zip(views, center))])
    if p <= _EXPRESSION_COLUMNS:
        cells = [(i, j) for i in range(p) for j in range(i, p)]
        row = centered.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(f"x{i}").alias(f"s{i}") for i in range(p)],
            *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}_{j}") for i, j in cells],
        ).first()
        if not row["n"]:
            return 0, np.zeros(p), np.zeros((p, p))
        gram = np.zeros((p, p))
        for i, j in cells:
            gram[i, j] = gram[j, i] = row[f"c{i}_{j}"]
        return row["n"], np.array([row[f"s{i}"] for i in range(p)]), gram

    names = centered.columns

    def accumulate(batches):
        total = np.zeros(1 + p + p * p)
        for batch in batches:
            x = matrix_of(batch, names)
            total[0] += len(x)
            total[1 : 1 + p] += x.sum(axis=0)
            total[1 + p :] += (x.T @ x).ravel()
        yield partial_batch({0: total})

    total = tree_sum(centered.mapInArrow(accumulate, PARTIAL_SCHEMA)).get(0, np.zeros(1 + p + p * p))
    return int(total[0]), total[1 : 1 + p], total[1 + p :].reshape(p, p)


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues descending; each row of vectors has its first largest entry positive."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors.T[::-1].copy()
    for v in vectors:
        size = np.abs(v)
        if v[np.argmax(size >= size.max() * (1 - 1e-9))] < 0:
            v *= -1
    return values, vectors
