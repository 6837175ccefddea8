"""Exact DBSCAN on many axes, where the cells around a cell are too many to list.

Rows fall into cells of all axes, narrower than eps/sqrt(d), so that what shares
a cell is within eps of each other whatever the number of axes. On many axes a
grid tells few rows apart, so the work is kept from growing with the square of
the rows by asking only while an answer is open:

* a cell of ``min_samples`` rows or more is core as a whole;
* the other places ask in rounds, of a few places first and at last of all of them. A
  place leaves as soon as a round shows it enough neighbours, which later rounds could
  not take back, so only places of thin regions, or none, are left to ask them all;
* core rows of a cell are one node. Nodes ask in the same rounds whether they link, each
  for one of its places; what has joined the largest cluster asks no more, and packs of one
  cluster never meet. Where boxes leave it open after the last round, the rows decide
  that are within reach of the other's box.

Which packs of rows can be near at all is told by a coarse grid over the widest axes and
their boxes on all axes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.neighbors import forest, grid_axes, places_of
from surveyloom.plans.components import components
from surveyloom.plans.ranking import dense_index
from surveyloom.plans.scratch import materialize, row_count
from surveyloom.plans.skew import lookup

_MARGIN = 1e-9
_PACK = 1024
# Packs follow further axes while those they share hold this many rows on average.
_FILLED = 256
# Places asked in the first round, at least so many for each row a place needs, and how many times more in each further one.
_FIRST = 4096
_EACH = 256
_MORE = 4
# The packs of a cell are dealt over this many tasks.
_DEALT = 4


def _columns(rows: pa.StructArray, names: Sequence[str]) -> np.ndarray:
    if not names:
        return np.zeros((len(rows), 0))
    return np.column_stack([rows.field(n).to_numpy(zero_copy_only=False) for n in names])


def _gap(a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> np.ndarray:
    """Smallest squared distance between the boxes of a and those of b."""
    total = np.zeros((len(a_lo), len(b_lo)))
    for j in range(a_lo.shape[1]):
        total += np.maximum(np.maximum(b_lo[None, :, j] - a_hi[:, j, None], a_lo[:, j, None] - b_hi[None, :, j]), 0.0) ** 2
    return total


def within(x: np.ndarray, y: np.ndarray, eps2: float) -> np.ndarray:
    """Which rows of x and y have a squared distance, summed axis by axis, of at most eps2.

    A matrix product settles all pairs but those its rounding leaves open."""
    middle = (x.mean(axis=0) + y.mean(axis=0)) / 2
    p, q = x - middle, y - middle
    own, others = (p * p).sum(axis=1), (q * q).sum(axis=1)
    off = own[:, None] + others[None, :] - 2 * (p @ q.T) - eps2
    slack = 1e-14 * (x.shape[1] + 4) * (own.max() + others.max() + eps2)
    hit = off <= slack
    i, j = np.nonzero(hit & (off >= -slack))
    exact = np.zeros(len(i))
    for n in range(x.shape[1]):
        exact += (x[i, n] - y[j, n]) ** 2
    hit[i, j] = exact <= eps2
    return hit


def _folded(fold: Callable[[pa.StructArray, pa.StructArray], tuple[np.ndarray, np.ndarray]]):
    """(id, v) rows that ``fold`` makes of every pair of packs (columns a and b)."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                ids, values = fold(left.values, right.values)
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.int64())], names=["id", "v"])
    return measure


def _rounds(rows: int, first: int) -> list[int]:
    """Which part of the rows each round asks, as 1/k: few rows first, all at last."""
    parts, k = [], rows // first
    while k >= _MORE:
        parts.append(k)
        k //= _MORE
    return [*parts, 1]


def _part(rows: DataFrame, k: int) -> DataFrame:
    return rows if k == 1 else rows.filter(F.pmod(F.xxhash64("id"), F.lit(k)) == 0)


class WideGrid:
    """Places, cells, core places and the links of their nodes."""

    def __init__(self, points: DataFrame, names: Sequence[str], eps: float, min_samples: int):
        self.names, self.eps, self.eps2, self.min_samples = list(names), eps, eps * eps, min_samples
        self.low, self.high = [f"lo_{x}" for x in names], [f"hi_{x}" for x in names]
        found = places_of(points, names)
        self.axes, self.origin, _ = grid_axes(found, names)
        self.side = eps / math.sqrt(len(names)) * (1 - _MARGIN)
        celled = found.withColumn("cell", F.array(*[F.floor(F.col(x) / F.lit(self.side)).cast("bigint") for x in names]))
        cells = celled.groupBy("cell").agg(F.min("id").alias("node"), F.sum("w").alias("n"))
        self.places = materialize(lookup(celled, cells, ["cell"], rows=found.stored_rows).drop("cell"), "wide-places")
        self.core = materialize(self._core_places(), "wide-core")

    def _boxes(self) -> list:
        return [f(x).alias(f"{t}_{x}") for x in self.names for t, f in (("lo", F.min), ("hi", F.max))]

    def _packs(self, rows: DataFrame, columns: Sequence[str], side: float, boxed: bool, tag: str) -> DataFrame:
        """Rows near each other, of one large cluster or of none, in arrays of about ``_PACK`` with the box of each array.

        Boxes are told by their least corner. The grid's axes are keys; further axes part the rows of a crowd."""
        low, high = (self.low, self.high) if boxed else (self.names, self.names)
        corner = dict(zip(self.names, low, strict=True))
        order = [*self.axes, *[x for x in self.names if x not in self.axes]]
        cell = {x: F.floor((F.col(corner[x]) - F.lit(self.origin.get(x, 0.0))) / F.lit(side)) for x in order}
        celled = rows.withColumns({f"c_{x}": c for x, c in cell.items()})
        big = F.col("big") if "big" in rows.columns else F.lit(None).cast("bigint")
        celled = celled.withColumn("lone", big.isNull()).withColumn("big", F.coalesce(big, F.lit(0)))
        spans = range(len(self.axes) + 1, len(order) + 1)
        kept = list(self.axes)
        if spans:
            seen = celled.agg(F.count(F.lit(1)), *[
                F.approx_count_distinct(F.xxhash64(*[f"c_{x}" for x in order[:k]])) for k in spans]).first()
            for k, cells in zip(spans, seen[1:], strict=True):
                if cells * _FILLED <= seen[0]:
                    kept = order[:k]
        keys = ["lone", "big", *[f"c_{x}" for x in kept]]
        sizes = celled.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / _PACK).alias("parts"))
        dealt = celled.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        ends = [f(F.col(c)).alias(f"{tag}_{t}_{x}") for t, f, ends in (("lo", F.min, low), ("hi", F.max, high))
                for x, c in zip(self.names, ends, strict=True)]
        grid = [f"c_{a}" for a in self.axes]
        packs = dealt.groupBy(*keys, "part").agg(F.collect_list(F.struct(*columns)).alias(tag), *ends)
        return packs.select(*grid, F.when(~F.col("lone"), F.col("big")).alias(f"{tag}_big"), tag, *[f"{tag}_{t}_{x}" for x in self.names for t in ("lo", "hi")])

    def _pairs(self, asking: DataFrame, ask: Sequence[str], held: DataFrame, hold: Sequence[str], boxed: bool = False) -> DataFrame:
        """(a, b): every pack of ``asking`` with every pack of ``held`` that can be within eps and is not of the same cluster."""
        # A place is told by itself, a box by its least corner, which is up to a side away.
        side = (self.eps + (self.side if boxed else 0.0)) * (1 + _MARGIN)
        keys = [f"c_{a}" for a in self.axes]
        around = F.array(*[F.struct(*[(F.col(c) + o).alias(c) for c, o in zip(keys, offset, strict=True)])
                           for offset in product((-1, 0, 1), repeat=len(self.axes))])
        a, b = self._packs(asking, ask, side, boxed, "a"), self._packs(held, hold, side, boxed, "b")
        few, many = (a, b) if row_count(asking) <= row_count(held) else (b, a)
        # The packs with fewer rows go to all cells around and all tasks of a cell, the others to one.
        few = few.withColumn("n", F.explode(around)).drop(*keys).select("*", "n.*").drop("n").withColumn(
            "deal", F.explode(F.array(*[F.lit(i) for i in range(_DEALT)])))
        many = many.withColumn("deal", F.pmod(F.xxhash64(*[c for c in many.columns if "_lo_" in c]), F.lit(_DEALT)).cast("int"))
        tasks = int(asking.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = many.repartition(tasks, *keys, "deal").join(few.repartition(tasks, *keys, "deal"), [*keys, "deal"])
        return met.filter((self._box_gap() <= self.eps2 * (1 + _MARGIN))
                          & ~F.coalesce(F.col("a_big") == F.col("b_big"), F.lit(False))).select("a", "b")

    def _box_gap(self) -> Column:
        beyond = [F.greatest(F.col(f"b_lo_{x}") - F.col(f"a_hi_{x}"), F.col(f"a_lo_{x}") - F.col(f"b_hi_{x}"), F.lit(0.0)) for x in self.names]
        return sum((g * g for g in beyond), F.lit(0.0))

    def _core_places(self) -> DataFrame:
        """(id, w, node, coordinates) of the places with enough rows within eps; node is that of their cell."""
        names, eps2, enough = self.names, self.eps2, self.min_samples

        def counted(a: pa.StructArray, b: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
            hit, w = within(_columns(a, names), _columns(b, names), eps2), b.field("w").to_numpy()
            # floats add whole numbers up to 2^53 exactly
            v = np.count_nonzero(hit, axis=1) if (w == 1).all() else (hit @ w.astype(float)).astype(np.int64)
            return a.field("id").to_numpy()[v > 0], v[v > 0]

        kept = ["id", "w", "node", *names]
        core = self.places.filter(F.col("n") >= enough).select(*kept)
        open_ = materialize(self.places.filter(F.col("n") < enough).select(*kept), "wide-open")
        for k in _rounds(self.places.stored_rows, max(_FIRST, _EACH * enough)):
            if not open_.stored_rows:
                break
            pairs = self._pairs(open_, ["id", *names], _part(self.places, k), ["w", *names])
            found = pairs.mapInArrow(_folded(counted), "id long, v long").groupBy("id").agg(F.sum("v").alias("v"))
            judged = materialize(open_.join(found, "id", "left").withColumn("core", F.coalesce(F.col("v") >= enough, F.lit(False))), "wide-judged")
            core = core.unionByName(judged.filter("core").select(*kept))
            open_ = judged.filter("not core").select(*kept)
            if k > 1:
                open_ = materialize(open_, "wide-open")
        return core

    def nodes(self) -> DataFrame:
        """(node, corner and place columns): the core places of each cell as one, by the least id among them and its place."""
        return self.core.groupBy("node").agg(F.min("id").alias("first"), *self._boxes(), *[F.min_by(x, "id").alias(x) for x in self.names])

    def _joined(self, parted: DataFrame, links: DataFrame) -> DataFrame:
        """Nodes with the root of their cluster once ``links`` (u, v) between roots count; ``big`` is the root of a large cluster."""
        rooted = components(parted.select(F.col("root").alias("node")).distinct(), links)
        moved = materialize(lookup(parted.drop("big").withColumnRenamed("root", "was"), rooted.withColumnRenamed("node", "was"), ["was"],
                                   rows=row_count(parted)).drop("was"), "wide-moved")
        large = moved.groupBy("root").count().filter(F.col("count") >= _PACK).select("root", F.col("root").alias("big"))
        return materialize(lookup(moved, large, ["root"], rows=moved.stored_rows), "wide-rooted")

    def _asking(self, parted: DataFrame) -> DataFrame:
        """All nodes but those of the largest cluster: of two clusters at least one asks."""
        largest = parted.filter("big is not null").groupBy("big").count().orderBy(F.desc("count"), "big").first()
        return parted if largest is None else materialize(parted.filter(~F.col("big").eqNullSafe(F.lit(largest["big"]))), "wide-asking")

    def clusters(self) -> DataFrame:
        """(id, root) for every core place; root is the least core id of its cluster."""
        names, low, high, eps2 = self.names, self.low, self.high, self.eps2
        nodes = materialize(self.nodes(), "wide-nodes")

        def linked(a: pa.StructArray, b: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
            roots, others = a.field("root").to_numpy(), b.field("root").to_numpy()
            return forest(roots, others, within(_columns(a, names), _columns(b, names), eps2) & (roots[:, None] != others[None, :]))

        def possible(a: pa.StructArray, b: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
            ids, others = a.field("id").to_numpy(), b.field("id").to_numpy()
            near = _gap(_columns(a, low), _columns(a, high), _columns(b, low), _columns(b, high)) <= eps2
            left, right = np.nonzero(near & (a.field("root").to_numpy()[:, None] != b.field("root").to_numpy()[None, :]))
            return np.minimum(ids[left], others[right]), np.maximum(ids[left], others[right])

        parted = materialize(nodes.select(F.col("first").alias("id"), *names, *low, *high, F.col("first").alias("root"),
                                          F.lit(None).cast("bigint").alias("big")), "wide-rooted")
        asked = ["root", *names]
        for k in _rounds(nodes.stored_rows, _FIRST):
            asking = self._asking(parted)
            if not row_count(asking):
                break
            links = materialize(self._pairs(asking, asked, _part(parted, k), asked).mapInArrow(
                _folded(linked), "u long, v long").distinct(), "wide-links")
            if links.stored_rows:
                parted = self._joined(parted, links)
        boxes, asking = ["id", *low, *high, "root"], self._asking(parted)
        pairs = materialize(self._pairs(asking, boxes, parted, boxes, boxed=True).mapInArrow(
            _folded(possible), "u long, v long").distinct(), "wide-pairs") if row_count(asking) else None
        if pairs is not None and pairs.stored_rows:
            met, root = self._met(pairs, nodes), parted.select("id", "root")
            parted = self._joined(parted, met.join(root.toDF("u", "ru"), "u").join(root.toDF("v", "rv"), "v").select(
                F.col("ru").alias("u"), F.col("rv").alias("v")))
        return self.core.join(nodes.select("node", "first"), "node").select("id", F.col("first").alias("node")).join(
            parted.select(F.col("id").alias("node"), "root"), "node").select("id", "root")

    def borders(self, rest: DataFrame, labelled: DataFrame) -> DataFrame:
        """(id, cluster): the least cluster of the labelled places within eps of each place of ``rest``."""
        names, eps2 = self.names, self.eps2

        def least(a: pa.StructArray, b: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
            labels = b.field("cluster").to_numpy()
            i, j = np.nonzero(within(_columns(a, names), _columns(b, names), eps2))
            found = np.full(len(a), np.iinfo(np.int64).max)
            np.minimum.at(found, i, labels[j])
            reached = np.unique(i)
            return a.field("id").to_numpy()[reached], found[reached]

        return self._pairs(rest, ["id", *names], labelled, ["cluster", *names]).mapInArrow(_folded(least), "id long, v long").groupBy(
            "id").agg(F.min("v").alias("cluster"))

    def _met(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Of pairs of nodes (u, v) those with places within eps of each other."""
        names, eps2 = self.names, self.eps2
        placed = materialize(self.core.join(nodes.select("node", "first"), "node").select("id", F.col("first").alias("node"), *names), "wide-placed")
        boxes = nodes.select(F.col("first").alias("other"), *self.low, *self.high)

        def side(own: str, other: str, tag: str) -> DataFrame:
            asked = pairs.withColumn("node", F.col(own)).withColumn("other", F.col(other)).join(boxes, "other")
            beyond = sum((F.pow(F.greatest(F.col(f"lo_{x}") - F.col(x), F.col(x) - F.col(f"hi_{x}"), F.lit(0.0)), 2) for x in names), F.lit(0.0))
            reach = placed.join(asked, "node").filter(beyond <= eps2 * (1 + _MARGIN)).select("u", "v", "id", *names)
            sizes = reach.groupBy("u", "v").agg(F.ceil(F.count(F.lit(1)) / _PACK).alias("parts"))
            dealt = reach.join(sizes, ["u", "v"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
            return dealt.groupBy("u", "v", "part").agg(F.collect_list(F.struct(*names)).alias(tag)).drop("part")

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = [bool(within(x, y, eps2).any()) for x, y in (
                    (_columns(a.values, names), _columns(b.values, names)) for a, b in zip(batch.column(2), batch.column(3), strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(hit, pa.bool_()))

        both = side("u", "v", "a").join(side("v", "u", "b"), ["u", "v"]).select("u", "v", "a", "b")
        return materialize(both.mapInArrow(met, "u long, v long").distinct(), "wide-met")


def wide_labels(points: DataFrame, names: Sequence[str], eps: float, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """Core row ids, and (row_id, cluster) with cluster null for noise, on any number of axes."""
    grid = WideGrid(points, names, eps, min_samples)
    rooted = materialize(grid.clusters(), "wide-roots")
    numbered = dense_index(rooted, "root", "cluster")
    clusters = materialize(lookup(rooted, numbered, ["root"], rows=rooted.stored_rows).select("id", "cluster"), "wide-clusters")
    labelled = materialize(grid.core.join(clusters, "id").select("id", "cluster", *grid.names), "wide-labelled")
    rest = materialize(grid.places.select("id", *grid.names).join(clusters, "id", "left_anti"), "wide-rest")
    found = clusters.unionByName(grid.borders(rest, labelled)) if rest.stored_rows else clusters
    rows = materialize(lookup(points, grid.places.select(*grid.names, "id"), list(grid.names), "inner").select("row_id", "id"), "wide-rows")
    return rows.join(clusters.select("id"), "id", "left_semi").select("row_id"), lookup(
        rows, found, ["id"], rows=rows.stored_rows).select("row_id", "cluster")
