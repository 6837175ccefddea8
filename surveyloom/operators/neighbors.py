"""Exact distance of every row to its k-th nearest other row, on a grid that widens where rows are sparse."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.plans.ranking import running_counts
from surveyloom.plans.scratch import materialize

# A grid over these many axes tells which rows can be near; distances use all axes.
_GRID_AXES = 3
_CROWD = 256
_PACK = 1024

_NEAR = "id long, near array<struct<d:double,w:long>>"


def _cells(points: DataFrame, axes: Sequence[str], low: dict[str, float], side: float) -> DataFrame:
    return points.withColumns({f"c_{a}": F.floor((F.col(a) - F.lit(low[a])) / F.lit(side)) for a in axes})


def _first_side(points: DataFrame, axes: Sequence[str], low: dict[str, float], width: float) -> float:
    """The widest of halved sides at which a row's cell holds few others on average."""
    side = width
    for _ in range(40):
        crowd = _cells(points, axes, low, side).groupBy(*[f"c_{a}" for a in axes]).count().agg(
            F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0]
        if crowd is None or crowd <= _CROWD:
            break
        side /= 2.0 if crowd < 8 * _CROWD else 4.0
    return side


def _packs(cells: DataFrame, axes: Sequence[str], names: Sequence[str], tag: str) -> DataFrame:
    """Rows of a cell in arrays of bounded size."""
    keys = [f"c_{a}" for a in axes]
    sizes = cells.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / _PACK).cast("int").alias("parts"))
    return (
        cells.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        .groupBy(*keys, "part").agg(F.collect_list(F.struct("id", "w", *names)).alias(tag)).drop("part")
    )


def _matrix(rows: pa.StructArray, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([rows.field(n).to_numpy(zero_copy_only=False) for n in names])


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        total += (x[:, j, None] - y[None, :, j]) ** 2
    return total


def _pack_pairs(asking: DataFrame, held: DataFrame, axes: Sequence[str], names: Sequence[str], low: dict[str, float], side: float) -> DataFrame:
    """(a, b): every pack of ``asking`` with every pack of ``held`` in its own cell and those around it."""
    keys = [f"c_{a}" for a in axes]
    around = F.array(*[F.struct(*[(F.col(c) + o).alias(c) for c, o in zip(keys, offset, strict=True)])
                       for offset in product((-1, 0, 1), repeat=len(axes))])
    left = _packs(_cells(asking, axes, low, side), axes, names, "a").select("a", F.explode(around).alias("n")).select("a", "n.*")
    return left.join(_packs(_cells(held, axes, low, side), axes, names, "b"), keys).select("a", "b")


def _nearest(names: Sequence[str], k: int):
    """For each row of a pack the k nearest of another pack, with their weights."""
    def measure(batches):
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                a, b = left.values, right.values
                squared, w = _squared(_matrix(a, names), _matrix(b, names)), b.field("w").to_numpy()
                kept = min(k, len(w))
                best = np.argpartition(squared, kept - 1, axis=1)[:, :kept]
                d = np.sqrt(np.take_along_axis(squared, best, axis=1))
                entries = pa.StructArray.from_arrays([pa.array(d.ravel()), pa.array(w[best].ravel())], names=["d", "w"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(squared) + 1) * kept, pa.int32()), entries)
                yield pa.RecordBatch.from_arrays([a.field("id"), lists], names=["id", "near"])
    return measure


def _kth(near: Column, k: int) -> Column:
    """The distance at which the weights of the sorted entries reach k; null if they never do."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("at"))
    return F.aggregate(F.array_sort(near), start, lambda a, e: F.struct(
        (a["seen"] + e["w"]).alias("seen"), F.coalesce(a["at"], F.when(a["seen"] + e["w"] >= k, e["d"])).alias("at")))["at"]


def places_of(points: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row for each distinct place: its coordinates, how many rows are there (w) and the least row_id (id)."""
    return materialize(points.groupBy(*names).agg(F.count(F.lit(1)).alias("w"), F.min("row_id").alias("id")), "places")


def grid_axes(places: DataFrame, names: Sequence[str]) -> tuple[list[str], dict[str, float], float]:
    """The widest axes, where they begin, and the width of the widest."""
    ends = places.agg(*[f(n).alias(f"{t}_{n}") for n in names for t, f in (("lo", F.min), ("hi", F.max))]).first()
    width = {n: (ends[f"hi_{n}"] or 0.0) - (ends[f"lo_{n}"] or 0.0) for n in names}
    axes = sorted(names, key=lambda n: -width[n])[:_GRID_AXES]
    return axes, {a: ends[f"lo_{a}"] or 0.0 for a in axes}, max(width[a] for a in axes)


def kth_distances(points: DataFrame, names: Sequence[str], kth: int) -> DataFrame:
    """(d, w): the distance to the kth other row, and how many rows have it, for each distinct place.

    Rows in the same place are one place with a weight. A place is settled when
    its k-th distance is no more than the side of a cell, for then no row outside
    the cells around it can be nearer; the others go on with cells twice as
    wide. ``points`` needs ``row_id`` and finite coordinates.
    """
    places = places_of(points, names)
    axes, low, widest = grid_axes(places, names)
    side = _first_side(places, axes, low, widest) if widest > 0 else 1.0
    open_, settled = places, []
    while True:
        near = _pack_pairs(open_, places, axes, names, low, side).mapInArrow(_nearest(names, kth + 1), _NEAR)
        # Each entry list holds at most kth + 1 places, one list for each pack around.
        found = near.groupBy("id").agg(_kth(F.flatten(F.collect_list("near")), kth + 1).alias("d"))
        judged = materialize(open_.join(found, "id"), "kth")
        sure = F.lit(True) if side >= widest else F.coalesce(F.col("d") <= side, F.lit(False))
        settled.append(judged.filter(sure).select("d", "w"))
        left = judged.filter(~sure).drop("d")
        if side >= widest or left.isEmpty():
            break
        open_, side = left, side * 2
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def percentiles(distances: DataFrame, n: int, shares: Sequence[int]) -> dict[str, float]:
    """Values at min(n - 1, floor(share n)) of the weighted distances, and the largest."""
    counts = distances.groupBy("d").agg(F.sum("w").alias("w"))
    places = {f"p{p}": min(n - 1, int(p / 100 * n)) for p in shares} | {"max": n - 1}
    ranked = running_counts(counts, "d", "w")
    held = [F.max(F.when((F.col("before") <= at) & (at < F.col("before") + F.col("w")), F.col("d"))).alias(name)
            for name, at in places.items()]
    return ranked.agg(*held).first().asDict()


def forest(ids: np.ndarray, others: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the hits connect: each row to its first hit, and hits of one row to each other."""
    left, right = np.nonzero(hit)
    nodes, place = np.unique(np.concatenate([ids[left], others[right]]), return_inverse=True)
    u, v = place[:len(left)], place[len(left):]
    label = np.arange(len(nodes))
    while len(u):
        least = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, least)
        np.minimum.at(label, v, least)
        label = label[label]
        if np.array_equal(label, before):
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]
