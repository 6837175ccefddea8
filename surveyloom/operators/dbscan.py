"""Exact DBSCAN on a grid, with work linear in the rows even where points pile up.

The grid side is just under eps/sqrt(d), so two points of one cell are always
neighbours. A cell of at least min_samples points is *dense*: all its points
are core and in one cluster, and no pair inside it is ever looked at. The other
cells hold fewer than min_samples points, so comparing them with their
surroundings costs a bounded number of pairs per row. Whether two dense cells
touch is decided from the bounding boxes of ever smaller sub-cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.numeric import col
from surveyloom.operators.missing import distance_views
from surveyloom.operators.wide_grid import wide_labels
from surveyloom.plans.components import components
from surveyloom.plans.ranking import dense_index
from surveyloom.plans.scratch import materialize, row_count
from surveyloom.plans.skew import hot_keys, lookup, split_join

_MARGIN = 1e-9
_MAX_OFFSETS = 20_000
_REFINE = 4
_DIRECT = 64


def _cell(names: Sequence[str], side: float) -> Column:
    return F.array(*[F.floor(F.col(x) / F.lit(side)).cast("bigint") for x in names])


def _around(cells: DataFrame, d: int, eps: float, side: float, ahead: bool = False) -> DataFrame:
    """Each cell with every other cell position that can hold a point within eps.

    ``ahead`` keeps one of the two directions between a pair of cells.
    """
    reach = int(math.sqrt(d) * (1 + _MARGIN)) + 1
    steps = [f"_o{i}" for i in range(d)]
    for o in steps:
        cells = cells.withColumn(o, F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    here = F.struct(*[F.lit(0).alias(o) for o in steps])
    there = F.struct(*[F.col(o) for o in steps])
    gap = reduce(Column.__add__, [
        F.pow(F.greatest(F.abs(o) - 1, F.lit(0)) * F.lit(side), F.lit(2.0)) for o in steps])
    return (
        cells.filter((there > here if ahead else there != here) & (gap <= eps * eps * (1 + 1e-6)))
        .withColumn("other", F.array(*[F.col("cell")[i] + F.col(o) for i, o in enumerate(steps)]))
        .drop(*steps)
    )


def _squared(names: Sequence[str], left: str, right: str) -> Column:
    total = F.lit(0.0)
    for x in names:
        step = F.col(f"{left}{x}") - F.col(f"{right}{x}")
        total = total + step * step
    return total


def _boxes(names: Sequence[str]) -> list[Column]:
    return [f(x).alias(f"{tag}_{x}") for x in names for tag, f in (("lo", F.min), ("hi", F.max))]


def _box_range(names: Sequence[str]) -> tuple[Column, Column]:
    """Smallest and largest squared distance between the boxes of sides a and b."""
    least, most = F.lit(0.0), F.lit(0.0)
    for x in names:
        a_lo, a_hi, b_lo, b_hi = (F.col(f"{s}_{t}_{x}") for s in "ab" for t in ("lo", "hi"))
        near = F.greatest(b_lo - a_hi, a_lo - b_hi, F.lit(0.0))
        far = F.greatest(b_hi - a_lo, a_hi - b_lo)
        least, most = least + near * near, most + far * far
    return least, most


def _side_of(df: DataFrame, side: str, keep: Sequence[str]) -> DataFrame:
    """Prefix box columns (and the count) with a or b for a pair join."""
    return df.select(*[col(c) if c in keep else col(c).alias(f"{side}_{c}") for c in df.columns])


class Grid:
    """Points, cells and the neighbour facts shared by the steps below."""

    def __init__(self, points: DataFrame, names: Sequence[str], eps: float, min_samples: int):
        self.names, self.min_samples = list(names), min_samples
        self.eps2 = eps * eps
        self.side = eps / math.sqrt(len(names)) * (1 - _MARGIN)
        self.eps = eps
        celled = points.withColumn("cell", _cell(names, self.side))
        self.cells = materialize(
            celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *_boxes(names)), "cells")
        dense = F.col("n") >= min_samples
        facts = self.cells.agg(F.sum("n").alias("rows"), F.count_if(dense).alias("dense"),
                               F.count_if(~dense).alias("sparse")).first()
        self.rows = facts["rows"] or 0
        self.any_dense, self.any_sparse = facts["dense"] > 0, facts["sparse"] > 0
        self.hot = hot_keys(self.cells, ["cell"], "n", self.rows)
        self.points = materialize(self.by_cell(celled, self.cells.select("cell", "n"), ["cell"]), "celled")
        self.dense, self.sparse = self.cells.filter(dense), self.cells.filter(~dense)
        self._count_neighbours()

    def by_cell(self, left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
        """Join points to facts about their cell, with the grid's own hot cells split."""
        return split_join(left, right, keys, self.hot, how)

    def _near(self) -> DataFrame:
        """What each point of a sparse cell has within eps in other cells.

        (p, cell, q, n): for a dense cell the number of its points and q null,
        for a sparse cell one row per point q.
        """
        occupied = (
            _around(self.sparse.select("cell"), len(self.names), self.eps, self.side)
            .join(self.cells.select(F.col("cell").alias("other")), "other")
        )
        mine = self.points.filter(F.col("n") < self.min_samples).select(
            F.col("row_id").alias("p"), "cell", *[F.col(x).alias(f"p{x}") for x in self.names])
        asking = mine.join(occupied, "cell").select("p", F.col("other").alias("cell"), *[f"p{x}" for x in self.names])
        theirs = self.points.select(
            F.when(F.col("n") < self.min_samples, F.col("row_id")).alias("q"), "cell",
            *[F.col(x).alias(f"q{x}") for x in self.names])
        # the points of a hot cell are dealt over several tasks, its few askers repeated
        pairs = self.by_cell(theirs, asking, ["cell"], how="inner")
        return (
            pairs.filter(_squared(self.names, "p", "q") <= self.eps2)
            .groupBy("p", "cell", "q").agg(F.count(F.lit(1)).alias("n"))
        )

    def _count_neighbours(self) -> None:
        if self.any_sparse:
            self.near = materialize(self._near(), "near")
        else:
            self.near = self.points.sparkSession.createDataFrame([], "p bigint, cell array<bigint>, q bigint, n bigint")
        reached = self.near.groupBy("p").agg(F.sum("n").alias("reached"))
        mine = self.points.filter(F.col("n") < self.min_samples).select(F.col("row_id").alias("p"), "cell", "n")
        self.sparse_points = materialize(
            mine.join(reached, "p", "left").select(
                "p", "cell", (F.col("n") + F.coalesce("reached", F.lit(0)) >= self.min_samples).alias("core")),
            "sparse-points",
        )
        # neighbours that are core: every point of a dense cell, and the core points of sparse ones
        core_q = self.sparse_points.filter("core").select(F.col("p").alias("q"))
        self.near_core = self.near.filter("q is null").select("p", "cell").unionByName(
            self.near.join(core_q, "q", "left_semi").select("p", "cell"))

    def core_points(self) -> DataFrame:
        dense = self.points.filter(F.col("n") >= self.min_samples).select("row_id", "cell")
        return dense.unionByName(self.sparse_points.filter("core").select(F.col("p").alias("row_id"), "cell"))

    def core_links(self) -> DataFrame:
        """Pairs of cells (a, b) joined by two core points within eps."""
        core = self.sparse_points.filter("core").select("p", F.col("cell").alias("a"))
        beside = self.near_core.join(core, "p").select("a", F.col("cell").alias("b"))
        return beside.unionByName(self._dense_links()) if self.any_dense else beside

    def _dense_links(self) -> DataFrame:
        """Pairs of dense cells with points within eps of each other."""
        a = _side_of(_around(self.dense, len(self.names), self.eps, self.side, ahead=True), "a", ("cell", "other"))
        a = a.withColumnsRenamed({"cell": "a", "other": "b"})
        b = _side_of(self.dense, "b", ("cell",)).withColumnRenamed("cell", "b")
        least, most = _box_range(self.names)
        pairs = a.join(b, "b")
        judged = materialize(
            pairs.select("a", "b", F.col("a").alias("a_sub"), F.col("b").alias("b_sub"), "a_n", "b_n",
                         (most <= self.eps2).alias("linked"), (least <= self.eps2).alias("possible"))
            .filter("possible"),
            "cell-pairs",
        )
        linked = [judged.filter("linked").select("a", "b")]
        if not judged.stored_rows:
            return linked[0]
        open_pairs, side = judged.filter("not linked").drop("linked", "possible"), self.side
        while not open_pairs.isEmpty():
            small = (F.col("a_n") <= _DIRECT) & (F.col("b_n") <= _DIRECT)
            direct = self._direct(open_pairs.filter(small), side)
            judged = materialize(self._refined(open_pairs.filter(~small), side, side / _REFINE), "refined")
            hits = materialize(direct.unionByName(judged.filter("linked").select("a", "b")).distinct(), "hits")
            linked.append(hits)
            if not judged.stored_rows:
                break
            open_pairs = materialize(
                judged.filter("not linked").drop("linked").join(hits, ["a", "b"], "left_anti"), "open")
            side /= _REFINE
        return reduce(DataFrame.unionByName, linked)

    def _sub_points(self, pairs: DataFrame, which: str, side: float) -> DataFrame:
        """Points of the sub-cells still in question on one side of the pairs.

        Only the sub-cells' keys meet the points, one match each, so a hot cell
        is split like any other lookup."""
        keys = pairs.select(F.col(which).alias("cell"), F.col(f"{which}_sub").alias("sub")).distinct()
        dense = self.points.filter(F.col("n") >= self.min_samples).withColumn(
            "sub", F.col("cell") if side == self.side else _cell(self.names, side))
        return self._asked(dense, keys)

    def _asked(self, points: DataFrame, keys: DataFrame) -> DataFrame:
        return lookup(points, keys, ["cell", "sub"], how="inner", rows=self.rows)

    def _direct(self, pairs: DataFrame, side: float) -> DataFrame:
        """Pairs of sub-cells of at most 64 points each, compared point by point."""
        sides = []
        for which, other in (("a", "b"), ("b", "a")):
            sides.append(self._sub_points(pairs, which, side).select(
                F.col("cell").alias(which), F.col("sub").alias(f"{which}_sub"),
                *[F.col(x).alias(f"{which}{x}") for x in self.names]))
        met = pairs.select("a", "b", "a_sub", "b_sub").join(sides[0], ["a", "a_sub"]).join(sides[1], ["b", "b_sub"])
        return met.filter(_squared(self.names, "a", "b") <= self.eps2).select("a", "b").distinct()

    def _refined(self, pairs: DataFrame, side: float, finer: float) -> DataFrame:
        """Split both sides of each pair into finer sub-cells and judge their boxes again."""
        parts = []
        for which in "ab":
            points = self._sub_points(pairs, which, side).withColumn("fine", _cell(self.names, finer))
            boxes = points.groupBy("cell", "sub", "fine").agg(F.count(F.lit(1)).alias("n"), *_boxes(self.names))
            parts.append(_side_of(boxes, which, ())
                         .withColumnRenamed(f"{which}_cell", which).withColumnRenamed(f"{which}_fine", f"{which}_next"))
        least, most = _box_range(self.names)
        return (
            pairs.select("a", "b", "a_sub", "b_sub")
            .join(parts[0], ["a", "a_sub"]).join(parts[1], ["b", "b_sub"])
            .filter(least <= self.eps2)
            .select("a", "b", F.col("a_next").alias("a_sub"), F.col("b_next").alias("b_sub"), "a_n", "b_n",
                    (most <= self.eps2).alias("linked"))
        )


def _labels(grid: Grid) -> DataFrame:
    """(row_id, cluster) with cluster null for noise.

    Clusters are numbered by their smallest core row id; a border point joins
    the lowest-numbered cluster among its core neighbours.
    """
    core = grid.core_points()
    nodes = materialize(core.groupBy("cell").agg(F.min("row_id").alias("node")), "nodes")
    edges = (
        grid.core_links()
        .join(nodes.select(F.col("cell").alias("a"), F.col("node").alias("u")), "a")
        .join(nodes.select(F.col("cell").alias("b"), F.col("node").alias("v")), "b")
    )
    rooted = components(nodes, edges.select("u", "v"))
    numbered = dense_index(rooted, "root", "cluster")
    clusters = materialize(
        lookup(nodes.join(rooted, "node"), numbered, ["root"], rows=nodes.stored_rows).select("cell", "cluster"),
        "clusters",
    )

    own = grid.by_cell(grid.points.select("row_id", "cell", "n"), clusters, ["cell"])
    reached = lookup(grid.near_core, clusters, ["cell"], rows=row_count(grid.near))
    border = reached.groupBy("p").agg(F.min("cluster").alias("beside"))
    rest = grid.sparse_points.join(border, "p", "left").select(F.col("p").alias("row_id"), "core", "beside")
    in_dense = F.col("n") >= grid.min_samples
    settled = own.filter(in_dense).select("row_id", "cluster")
    # a sparse cell's own cluster also reaches its non-core points: the cell is narrower than eps
    loose = own.filter(~in_dense).join(rest, "row_id").select(
        "row_id",
        F.when(F.col("core"), F.col("cluster")).otherwise(F.least("cluster", "beside")).alias("cluster"),
    )
    return settled.unionByName(loose)


def _points(df: DataFrame, columns: Sequence[str], eps: float, row_id: str, standardize: bool) -> tuple[DataFrame, list[str]]:
    columns = list(columns)
    if not eps > 0:
        raise ValueError("eps must be above 0")
    names = [f"x{i}" for i in range(len(columns))]
    views = distance_views(df, columns, standardize)
    return df.select(col(row_id).cast("bigint").alias("row_id"), *[v.alias(x) for v, x in zip(views, names)]), names


def _few_axes(names: Sequence[str]) -> bool:
    return (2 * (int(math.sqrt(len(names)) * (1 + _MARGIN)) + 1) + 1) ** len(names) <= _MAX_OFFSETS


def core_points(
    df: DataFrame, columns: Sequence[str], eps: float, min_samples: int, row_id: str, standardize: bool = False,
) -> DataFrame:
    """Row ids with at least ``min_samples`` rows within eps, themselves included."""
    points, names = _points(df, columns, eps, row_id, standardize)
    if not _few_axes(names):
        return wide_labels(points, names, float(eps), int(min_samples))[0]
    return Grid(points, names, float(eps), int(min_samples)).core_points().select("row_id")


def dbscan_labels(
    df: DataFrame, columns: Sequence[str], eps: float, min_samples: int, row_id: str, standardize: bool = False,
) -> DataFrame:
    """(row_id, label): "Cluster i" or "Noise" for every row, on any number of axes."""
    points, names = _points(df, columns, eps, row_id, standardize)
    if _few_axes(names):
        labels = _labels(Grid(points, names, float(eps), int(min_samples)))
    else:
        labels = wide_labels(points, names, float(eps), int(min_samples))[1]
    name = F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))
    return labels.select("row_id", F.coalesce(name, F.lit("Noise")).alias("label"))


def dbscan(
    df: DataFrame, columns: Sequence[str], eps: float, min_samples: int, row_id: str,
    standardize: bool = False, label: str = "Cluster",
) -> DataFrame:
    """The table with a cluster label column, matched by its unique integer row id."""
    found = dbscan_labels(df, columns, eps, min_samples, row_id, standardize)
    kept = df.select(*[col(c) for c in df.columns if c != label])
    return kept.join(found.select(F.col("row_id").alias(row_id), F.col("label").alias(label)), row_id)
