"""Diagnostics of clusterings: silhouettes and k-distances of all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.numeric import as_number, col, label_of
from surveyloom.operators.kmeans import SEEDS, Fit, best_fit, fit_all, nearest
from surveyloom.operators.missing import zscore_views
from surveyloom.operators.neighbors import kth_distances, percentiles
from surveyloom.operators.sample import draw_order
from surveyloom.plans.scratch import materialize, row_count
from surveyloom.plans.skew import lookup
from surveyloom.plans.vectors import PARTIAL_SCHEMA, matrix_of, partial_batch, tree_sum

# The smallest usable input and the percentiles shown.
MIN_SILHOUETTE_ROWS = 10
PERCENTILES = (50, 75, 90, 95)
# Statistics of up to this many labels are gathered for every task; more stay a table.
GATHERED_LABELS = 1024
# Euclidean silhouettes of all rows look at every pair of rows; above this many they are refused.
EXACT_ROWS = 2_000_000
# Rows of a block that meets other blocks, how many of them are compared at once, and the blocks of a task that splits them by place.
_BLOCK_ROWS = 2048
_AT_ONCE = 64
_BLOCKS_AT_ONCE = 32
# Numbers of the accounts that a task holds at once.
_HELD_SUMS = 1 << 22
# Distances between blocks at least so many of their sides apart go through so many nodes on each axis, which leaves an error
# below 1e-12 of a distance; on more axes the nodes would be more than the rows.
_FAR_SIDES = 1.5
_FAR_AXES = 2
_NODES = 14
# The search for the nearest of many clusters: rows and clusters of a block, rows that are ruled out together,
# and the axes of the curve that puts neighbours into one block, with the ranks each axis is cut into.
_ROWS_AT_ONCE = 8192
_CLUSTERS_AT_ONCE = 256
_PART_ROWS = 256
_CURVE_AXES = 4
_CURVE_RANKS = 256


def _points(df: DataFrame, columns: Sequence[str], row_id: str, standardize: bool, label: str | None = None, rows: int | None = None):
    """Complete rows as row_id, x0, x1 ... (and label), in the units of the whole table; all of them unless ``rows`` says fewer."""
    views = {c: as_number(df, c) for c in columns}
    if standardize:
        views = zscore_views(df, views)
    names = [f"x{i}" for i in range(len(columns))]
    labels = [] if label is None else [F.coalesce(label_of(df, label), F.lit("")).alias("label")]
    carried = df.select(col(row_id).cast("bigint").alias("row_id"), *[views[c].alias(x) for c, x in zip(columns, names)], *labels)
    whole = carried.dropna(subset=names)
    if rows is not None:
        whole = whole.orderBy(draw_order("row_id"), "row_id").limit(rows)
    return materialize(whole, "points"), names


def _matrix(sample: DataFrame, names: Sequence[str]) -> tuple[list, np.ndarray]:
    """A sample of the size the caller asked for, in row-id order."""
    rows = sample.orderBy("row_id").collect()
    return rows, np.array([[r[x] for x in names] for r in rows], dtype=float).reshape(-1, len(names))


def _squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return total


def sample_silhouettes(sample: DataFrame, names: Sequence[str], points: np.ndarray, labelings: dict[int, np.ndarray]) -> DataFrame:
    """Mean Euclidean silhouette of each labeling of a sample.

    Every task holds the sample and scores its own rows against it; the
    distance matrix never exists as a whole. A singleton scores 0, and a
    labeling with one cluster scores 0 throughout.
    """
    coded = {key: np.unique(labels, return_inverse=True)[1] for key, labels in labelings.items()}
    sizes = {key: np.bincount(codes) for key, codes in coded.items()}

    def score(batches):
        for pdf in batches:
            at = pdf["at"].to_numpy()
            away = np.sqrt(_squared_distances(points[at], points))
            for key, codes in coded.items():
                size, own = sizes[key], codes[at]
                value = np.zeros(len(at))
                if len(size) > 1:
                    sums = np.stack([np.bincount(codes, weights=row, minlength=len(size)) for row in away])
                    rows = np.arange(len(at))
                    a = sums[rows, own] / np.maximum(size[own] - 1, 1)
                    means = sums / size
                    means[rows, own] = np.inf
                    b = means.min(axis=1)
                    top = np.maximum(a, b)
                    alone = (size[own] == 1) | (top == 0)
                    value = np.where(alone, 0.0, (b - a) / np.where(top == 0, 1.0, top))
                yield pd.DataFrame({"k": key, "s": value})

    spark = sample.sparkSession
    rows = spark.range(len(points)).select(F.col("id").alias("at"))
    return (
        rows.mapInPandas(score, "k int, s double").groupBy("k")
        .agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n"))
    )


def _score_values(inside: np.ndarray, outside: np.ndarray, alone: np.ndarray) -> np.ndarray:
    top = np.maximum(inside, outside)
    flat = alone | (top == 0) | ~np.isfinite(outside)
    return np.where(flat, 0.0, (outside - inside) / np.where(flat, 1.0, top))


def _scores_of_sums(total: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Silhouettes of rows from their summed distances to every cluster; 0 in a cluster of one, or where there is no other."""
    rows = np.arange(len(total))
    inside = total[rows, own] / np.maximum(sizes[own] - 1, 1)
    mean = np.where(sizes > 0, total / np.maximum(sizes, 1), np.inf)
    mean[rows, own] = np.inf
    return _score_values(inside, mean.min(axis=1), sizes[own] == 1)


def _scores(x: np.ndarray, own: np.ndarray, sizes: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Silhouettes in squared distance of rows, from the size, vector sum and sum of squares of every cluster.

    The squared distances of x to a cluster's n rows add up to
    n |x|^2 - 2 x.S + Q, so no pair of rows is looked at.
    """
    total = np.maximum((x * x).sum(axis=1)[:, None] * sizes - 2 * x @ sums.T + squares, 0)
    return _scores_of_sums(total, own, sizes)


_PARTS_SCHEMA = "k int, s double, n bigint"


def _part(k: int, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k], pa.int32()), pa.array([float(scores.sum())]), pa.array([len(scores)], pa.int64())], names=["k", "s", "n"])


_BLOCK_SCHEMA = "block bigint, x binary, tags binary"


def _by_place(x: np.ndarray) -> list[np.ndarray]:
    """Rows in parts of up to _BLOCK_ROWS, halved along their widest axis."""
    parts, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= _BLOCK_ROWS:
            parts.append(rows)
            continue
        inside = x[rows]
        order = np.argpartition(inside[:, np.argmax(np.ptp(inside, axis=0))], len(rows) // 2)
        todo += [rows[order[len(rows) // 2:]], rows[order[:len(rows) // 2]]]
    return parts


def _blocks(df: DataFrame, names: Sequence[str], tags, split: bool) -> DataFrame:
    """Rows of ``df`` in stored blocks: a matrix of doubles and, with ``tags(batch, x)``, a matrix of whole numbers.

    With ``split`` a task's rows are put into blocks by place, else as they come.
    """
    def pack(batches):
        block = TaskContext.get().partitionId() << 32

        def stored(x, marks):
            nonlocal block
            block += 1
            return pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int64()), "x": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()),
                "tags": pa.array([np.ascontiguousarray(marks).tobytes()], pa.binary())})

        held, count = [], 0
        for batch in batches:
            x = matrix_of(batch, names)
            marks = np.asarray(tags(batch, x), dtype=np.int64).reshape(len(x), -1)
            if not split:
                for i in range(0, len(x), _BLOCK_ROWS):
                    yield stored(x[i:i + _BLOCK_ROWS], marks[i:i + _BLOCK_ROWS])
                continue
            held.append((x, marks))
            count += len(x)
            if count >= 2 * _BLOCKS_AT_ONCE * _BLOCK_ROWS:
                whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                held, count = [], 0
                for rows in _by_place(whole[0]):
                    yield stored(whole[0][rows], whole[1][rows])
        if count:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            for rows in _by_place(whole[0]):
                yield stored(whole[0][rows], whole[1][rows])

    return materialize(df.mapInArrow(pack, _BLOCK_SCHEMA), "blocks")


_TURNS = (2 * np.arange(_NODES) + 1) * np.pi / (2 * _NODES)
_AT = np.cos(_TURNS)
_WEIGHTS = (-1.0) ** np.arange(_NODES) * np.sin(_TURNS)


class _Block:
    """Rows, their cluster in each labeling as one-hot columns, and the box around them."""

    def __init__(self, x: np.ndarray, columns: np.ndarray, width: int):
        self.x = x
        self.member = np.zeros((len(x), width))
        self.member[np.arange(len(x))[:, None], columns] = 1.0
        self.lo, self.hi = x.min(axis=0), x.max(axis=0)
        self.middle, self.half = (self.lo + self.hi) / 2, (self.hi - self.lo) / 2
        self.sums = self.far = self.seen = None

    def beyond(self, other: _Block) -> bool:
        """Whether distances to the other block go through nodes."""
        if self.x.shape[1] > _FAR_AXES:
            return False
        gap = np.maximum(np.maximum(other.lo - self.hi, self.lo - other.hi), 0.0)
        side = 2 * max(self.half.max(initial=0.0), other.half.max(initial=0.0))
        return bool((gap * gap).sum() > max(_FAR_SIDES * side, 0.0) ** 2)

    def basis(self) -> np.ndarray:
        """What each row gives to each node of the box, so that functions smooth on the box are interpolated between the nodes."""
        found = np.ones((len(self.x), 1))
        for j in range(self.x.shape[1]):
            place = (self.x[:, j] - self.middle[j]) / (self.half[j] if self.half[j] > 0 else 1.0)
            away = place[:, None] - _AT
            on = away == 0
            share = _WEIGHTS / np.where(on, 1.0, away)
            share = np.where(on.any(axis=1)[:, None], on, share / share.sum(axis=1)[:, None])
            found = (found[:, :, None] * share[:, None, :]).reshape(len(self.x), -1)
        return found

    def by_node(self) -> np.ndarray:
        """The rows of each cluster, handed to the nodes."""
        if self.seen is None:
            self.seen = self.basis().T @ self.member
        return self.seen

    def add(self, other: _Block) -> None:
        """Enter the summed distances to the other block's rows of each cluster."""
        if self.sums is None:
            self.sums, self.far = np.zeros_like(self.member), np.zeros((_NODES ** self.x.shape[1] if self.x.shape[1] <= _FAR_AXES else 0, self.member.shape[1]))
        if not self.beyond(other):
            for i in range(0, len(self.x), _AT_ONCE):
                self.sums[i:i + _AT_ONCE] += np.sqrt(_squared_distances(self.x[i:i + _AT_ONCE], other.x)) @ other.member
            return
        total = np.zeros((1, 1))
        for j in range(self.x.shape[1]):
            # From the difference of the middles, so that boxes far from zero keep their digits.
            apart = (self.middle[j] - other.middle[j]) + (self.half[j] * _AT)[:, None] - other.half[j] * _AT
            total = (total[:, None, :, None] + (apart * apart)[None, :, None, :]).reshape(len(total) * _NODES, -1)
        self.far += np.sqrt(total) @ other.by_node()

    def total(self) -> np.ndarray:
        return self.sums + self.basis() @ self.far if len(self.far) else self.sums


def _meet(blocks: DataFrame, count: int, read: Callable, score: Callable) -> DataFrame:
    """(k, s, n): every block meets every block once, and its rows are scored from what they add up to.

    ``read(x, tags)`` makes a block and ``score(block, tags)`` gives (k, scores) pairs. Blocks are dealt out over
    ``count`` groups; a task holds a group's accounts while all blocks pass one by one, so blocks are copied for
    each group, not for each block.
    """
    dealt = F.pmod(F.xxhash64("block"), F.lit(count)).cast("int").alias("g")
    held = blocks.select(dealt, F.lit(False).alias("passes"), "x", "tags")
    passing = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("g"), F.lit(True).alias("passes"), "x", "tags")
    stream = held.unionByName(passing).repartition(count, "g").sortWithinPartitions("g", "passes")

    def compare(batches):
        at, accounts = None, []

        def done():
            for account, tags in accounts:
                yield from (_part(k, s) for k, s in score(account, tags))

        for batch in batches:
            columns = [batch.column(c) for c in ("g", "passes", "x", "tags")]
            for i in range(batch.num_rows):
                if columns[0][i].as_py() != at:
                    yield from done()
                    at, accounts = columns[0][i].as_py(), []
                block, tags = read(columns[2][i], columns[3][i])
                if not columns[1][i].as_py():
                    accounts.append((block, tags))
                else:
                    for account, _ in accounts:
                        account.add(block)
        yield from done()

    return stream.mapInArrow(compare, _PARTS_SCHEMA)


def _euclidean_scores(points: DataFrame, names: Sequence[str], sizes: dict[int, np.ndarray], codes) -> DataFrame:
    """(k, silhouette, n) of labelings in Euclidean distance, over every pair of rows, each distance taken once for all labelings.

    On up to _FAR_AXES axes blocks hold neighbours, and two blocks far apart meet in the nodes of their boxes: a row's
    distances to the other block's rows are summed there, to the digits that rounding leaves. Other blocks meet row
    by row. Work still grows with the square of the rows, so more than EXACT_ROWS are refused. A row's account holds
    one sum for each cluster of each labeling.
    """
    rows = row_count(points)
    if rows > EXACT_ROWS:
        raise ValueError(f"Euclidean silhouettes of all rows are for up to {EXACT_ROWS} rows; take the squared ones, or sample_rows")
    ks, d = sorted(sizes), len(names)
    starts = np.cumsum([0, *[len(sizes[k]) for k in ks]])
    split = 0 < d <= _FAR_AXES and rows > _BLOCK_ROWS

    def tags(batch, x):
        own = codes(batch, x)
        return np.column_stack([own[k] for k in ks])

    def read(x, marks):
        own = np.frombuffer(marks.as_buffer(), dtype=np.int64).reshape(-1, len(ks))
        return _Block(np.frombuffer(x.as_buffer(), dtype=float).reshape(len(own), d), starts[:-1] + own, starts[-1]), own

    def score(block, own):
        total = block.total()
        for j, k in enumerate(ks):
            yield k, _scores_of_sums(total[:, starts[j]:starts[j + 1]], own[:, j], sizes[k])

    if split:
        points = _along_curve(points.withColumn("code", F.col("row_id")), names, -(-rows // (_BLOCKS_AT_ONCE * _BLOCK_ROWS)))
    blocks = _blocks(points, names, tags, split)
    n = row_count(blocks)
    each = max(1, min(n // int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), _HELD_SUMS // int(_BLOCK_ROWS * starts[-1])))
    parts = _meet(blocks, max(1, -(-n // each)), read, score)
    return parts.groupBy("k").agg((F.sum("s") / F.sum("n")).alias("silhouette"), F.sum("n").alias("n"))


def _along_curve(df: DataFrame, axes: Sequence[str], tasks: int | None = None) -> DataFrame:
    """``df`` dealt out and sorted along a Z-curve over the widest axes, so that a stretch of it lies close together.

    The curve runs over ranks among sampled quantiles; they settle how good the order is and nothing else. It is
    dealt over ``tasks`` tasks where given.
    """
    spread = df.agg(*[F.stddev_pop(a).alias(a) for a in axes]).first()
    wide = sorted(axes, key=lambda a: -(spread[a] or 0.0))[:2 * _CURVE_AXES]
    ranks = dict(zip(wide, df.approxQuantile(
        wide, [i / _CURVE_RANKS for i in range(1, _CURVE_RANKS)], 1 / (4 * _CURVE_RANKS)), strict=True))
    # Between the first and the last tenth, so that a few rows far away do not make an axis wide.
    width = {a: e[-(_CURVE_RANKS // 10)] - e[_CURVE_RANKS // 10] if e else 0.0 for a, e in ranks.items()}
    led = sorted(wide, key=lambda a: -width[a])[:_CURVE_AXES]
    led = [a for a in led if 8 * width[a] >= width[led[0]]]
    edges = [np.array(ranks[a]) for a in led]
    bits = _CURVE_RANKS.bit_length() - 1

    def place(batches):
        for batch in batches:
            code = np.zeros(batch.num_rows, np.int64)
            for i, (a, e) in enumerate(zip(led, edges, strict=True)):
                rank = np.searchsorted(e, batch.column(a).to_numpy(zero_copy_only=False)).astype(np.int64)
                for bit in range(bits):
                    code |= (rank >> bit & 1) << (bit * len(led) + i)
            yield pa.RecordBatch.from_arrays([pa.array(code), *batch.columns], names=["curve", *batch.schema.names])

    schema = ", ".join(["curve bigint", *[f"{c} {k}" for c, k in df.dtypes]])
    order = ("curve", led[0], "code")
    dealt = order if tasks is None else (tasks, *order)
    return df.mapInArrow(place, schema).repartitionByRange(*dealt).sortWithinPartitions(*order)


def _curve_blocks(df: DataFrame, names: Sequence[str], axes: Sequence[str], size: int, squared: str | None = None) -> DataFrame:
    """Stored blocks of up to ``size`` neighbours on the curve: the matrix of ``names``, the codes, and the box of ``axes``.

    The box is their least values, their greatest values, and the number of rows. Of an axis in squared units the
    curve takes the root.
    """
    at = [names.index(a) for a in axes]

    def pack(batches):
        block = TaskContext.get().partitionId() << 32
        held, count = [], 0

        def rows(x, code):
            nonlocal block
            box = np.concatenate([x[:, at].min(axis=0), x[:, at].max(axis=0), [len(x)]])
            block += 1
            return pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int64()), "x": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()),
                "tags": pa.array([np.ascontiguousarray(code).tobytes()], pa.binary()), "box": pa.array([box.tobytes()], pa.binary())})

        for batch in batches:
            held.append((matrix_of(batch, names), batch.column("code").to_numpy(zero_copy_only=False)))
            count += batch.num_rows
            if count >= size:
                x, code = (np.concatenate(parts) for parts in zip(*held, strict=True))
                whole = count - count % size
                for i in range(0, whole, size):
                    yield rows(x[i:i + size], code[i:i + size])
                held, count = [(x[whole:], code[whole:])], count - whole
        if count:
            yield rows(*(np.concatenate(parts) for parts in zip(*held, strict=True)))

    rooted = df if squared is None else df.withColumn("root", F.sqrt(squared))
    placed = _along_curve(rooted, [*[a for a in axes if a != squared], *(["root"] if squared else [])])
    return materialize(placed.mapInArrow(pack, f"{_BLOCK_SCHEMA}, box binary"), "curve-blocks")


def _box_gaps(lo: np.ndarray, hi: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray) -> np.ndarray:
    """Least squared distance between each box and each other box."""
    total = np.zeros((len(lo), len(other_lo)))
    for j in range(lo.shape[1]):
        total += np.maximum(np.maximum(other_lo[None, :, j] - hi[:, j, None], lo[:, j, None] - other_hi[None, :, j]), 0.0) ** 2
    return total


def _reachable(left: DataFrame, right: DataFrame, d: int) -> DataFrame:
    """(block, other, at): the blocks of clusters that can hold the nearest other cluster of a row of a block.

    A row is as far from a cluster as from its mean, squared, and its variance beside. A block of two clusters or
    more holds one that is not the row's own, so the farthest corner of its box bounds the distance searched for;
    blocks whose box begins beyond the least such bound cannot hold the nearest. Boxes meet boxes in packs.
    """
    def packed(blocks: DataFrame, size: int) -> DataFrame:
        def pack(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, size):
                    part = batch.slice(i, size)
                    yield pa.RecordBatch.from_pydict({
                        "ids": pa.array([part.column("block").to_numpy().tobytes()], pa.binary()),
                        "boxes": pa.array([b"".join(part.column("box").to_pylist())], pa.binary())})
        parts = max(1, -(-row_count(blocks) // size))
        return blocks.select("block", "box").repartition(parts).mapInArrow(pack, "ids binary, boxes binary")

    asking = materialize(packed(left, 64), "row-boxes")
    held = materialize(packed(right, 4096), "cluster-boxes")
    both = asking.crossJoin(held.select(F.col("ids").alias("other_ids"), F.col("boxes").alias("other_boxes")))

    def read(ids, boxes, width):
        return np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(boxes.as_buffer(), float).reshape(-1, width)

    def farthest(batches):
        for batch in batches:
            for ids, boxes, other_ids, other_boxes in zip(*[batch.column(c) for c in ("ids", "boxes", "other_ids", "other_boxes")], strict=True):
                (block, a), (_, b) = read(ids, boxes, 2 * d + 1), read(other_ids, other_boxes, 2 * d + 3)
                far = np.zeros((len(a), len(b)))
                for j in range(d):
                    far += np.maximum(b[None, :, d + 1 + j] - a[:, j, None], a[:, d + j, None] - b[None, :, j]) ** 2
                far += b[None, :, 2 * d + 1]
                far[:, b[:, 2 * d + 2] < 2] = np.inf
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(far.min(axis=1))], names=["block", "most"])

    most = materialize(both.mapInArrow(farthest, "block bigint, most double").groupBy("block").agg(F.min("most").alias("most")), "reach")

    def near(batches):
        for batch in batches:
            for block, most, box, other_ids, other_boxes in zip(
                    *[batch.column(c) for c in ("block", "most", "box", "other_ids", "other_boxes")], strict=True):
                a = np.frombuffer(box.as_buffer(), float)[None, :]
                others, b = read(other_ids, other_boxes, 2 * d + 3)
                gap = _box_gaps(a[:, :d], a[:, d:2 * d], b[:, :d], b[:, d + 1:2 * d + 1])[0] + b[:, d]
                middle = (a[:, :d] + a[:, d:2 * d]) / 2
                at = _box_gaps(middle, middle, b[:, :d], b[:, d + 1:2 * d + 1])[0] + b[:, d]
                kept = np.flatnonzero(gap <= most.as_py() + _slack(a[:, :2 * d], b[:, [*range(d), *range(d + 1, 2 * d + 1)]]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(kept), block.as_py())), pa.array(others[kept]), pa.array(at[kept])], names=["block", "other", "at"])

    bounded = left.select("block", "box").join(most, "block").crossJoin(
        held.select(F.col("ids").alias("other_ids"), F.col("boxes").alias("other_boxes")))
    return bounded.mapInArrow(near, "block bigint, other bigint, at double")


def _slack(a: np.ndarray, b: np.ndarray) -> float:
    """What rounding can add to a squared distance between values of these sizes."""
    return 1e-9 * (float(np.abs(a).max(initial=0.0)) + float(np.abs(b).max(initial=0.0))) ** 2


def _nearest_other(batches, d: int):
    """(k, s, n) of each block of rows; the blocks of clusters that follow it come nearest first.

    A row takes part in a comparison only while the block's box begins within the distance it has found so far.
    """
    state = None

    def done():
        return _part(0, _score_values(state["inside"], state["best"], np.zeros(len(state["best"]), dtype=bool)))

    for batch in batches:
        columns = [batch.column(c) for c in ("at", "x", "tags")]
        for i in range(batch.num_rows):
            code = np.frombuffer(columns[2][i].as_buffer(), np.int64)
            x = np.frombuffer(columns[1][i].as_buffer(), float).reshape(len(code), -1)
            if columns[0][i].as_py() < 0:
                if state is not None:
                    yield done()
                y, starts = x[:, :d], np.arange(0, len(x), _PART_ROWS)
                state = {"y": y, "code": code, "inside": x[:, d], "best": np.full(len(x), np.inf), "starts": starts,
                         "lo": np.minimum.reduceat(y, starts), "hi": np.maximum.reduceat(y, starts), "worst": np.full(len(starts), np.inf)}
                continue
            mean, variance, per_row = x[:, :d], x[:, d], x[:, d + 1]
            lo, hi, least = mean.min(axis=0)[None, :], mean.max(axis=0)[None, :], variance.min()
            slack = _slack(np.concatenate([state["lo"], state["hi"]]), mean)
            gap = _box_gaps(state["lo"], state["hi"], lo, hi)[:, 0] + least
            order = np.argsort(code)
            for part in np.flatnonzero(gap <= state["worst"] + slack):
                here = slice(state["starts"][part], state["starts"][part] + _PART_ROWS)
                best, y, own = state["best"][here], state["y"][here], state["code"][here]
                rows = np.flatnonzero(_box_gaps(y, y, lo, hi)[:, 0] + least <= best + slack)
                if not len(rows):
                    continue
                y, own = y[rows], own[rows]
                away = (y * y).sum(axis=1)[:, None] - 2 * y @ mean.T + per_row
                place = order[np.minimum(np.searchsorted(code, own, sorter=order), len(code) - 1)]
                mine = np.flatnonzero(code[place] == own)
                away[mine, place[mine]] = np.inf
                best[rows] = np.minimum(best[rows], np.maximum(away.min(axis=1), 0))
                state["worst"][part] = best.max()
    if state is not None:
        yield done()


def _scores_by_table(points: DataFrame, names: Sequence[str], center: np.ndarray, clusters: DataFrame) -> DataFrame:
    """(squared_silhouette, n) where the labels are too many to gather: their statistics, a stored table, meet the rows in blocks.

    A row's mean squared distance to a cluster is that to the cluster's mean and the cluster's variance, so the
    nearest other cluster is searched for by place: blocks of rows meet only blocks of clusters near enough. Rows
    of clusters of one score 0 and meet nothing.
    """
    d = len(names)
    means = [f"m{j}" for j in range(d)]
    held = clusters.withColumn("code", F.monotonically_increasing_id()).select(
        "label", "code", "n", (F.col("q") / F.col("n")).alias("q"), *[(F.col("s")[j] / F.col("n")).alias(m) for j, m in enumerate(means)])
    coded = materialize(held.withColumn("v", F.greatest(
        F.col("q") - sum((F.col(m) * F.col(m) for m in means), F.lit(0.0)), F.lit(0.0))), "clusters")
    rows = row_count(points)
    own = lookup(points, coded.filter("n > 1").select("label", "code", "n", "q", *means), ["label"], rows=rows).filter("code is not null")
    moved = [F.col(x) - F.lit(float(c)) for x, c in zip(names, center)]
    total = sum((m * m - 2 * m * F.col(c) for m, c in zip(moved, means)), F.col("q"))
    inside = (F.greatest(total, F.lit(0.0)) * F.col("n") / (F.col("n") - 1)).alias("inside")
    shared = materialize(own.select(*[m.alias(x) for m, x in zip(moved, names)], inside, "code"), "own-cluster")
    left = _curve_blocks(shared, [*names, "inside"], names, _ROWS_AT_ONCE)
    right = _curve_blocks(coded.select(*means, "v", "q", "code"), [*means, "v", "q"], [*means, "v"], _CLUSTERS_AT_ONCE, "v")
    pairs = _reachable(left, right, d)
    met = pairs.join(right.select(F.col("block").alias("other"), "x", "tags"), "other").select("block", "at", "x", "tags")
    tasks = max(1, min(row_count(left), int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    stream = left.select("block", F.lit(-1.0).alias("at"), "x", "tags").unionByName(met).repartition(tasks, "block")
    parts = stream.sortWithinPartitions("block", "at").mapInArrow(lambda batches: _nearest_other(batches, d), _PARTS_SCHEMA)
    total = F.lit(rows).cast("bigint")
    return parts.agg((F.coalesce(F.sum("s"), F.lit(0.0)) / total).alias("squared_silhouette")).select("squared_silhouette", total.alias("n"))


def _mean_scores(points: DataFrame, names: Sequence[str], center: np.ndarray, clusters: dict[int, tuple], codes) -> DataFrame:
    """(k, squared_silhouette, n) of labelings; ``codes(batch, x)`` gives each labeling's cluster numbers."""
    def score(batches):
        for batch in batches:
            x = matrix_of(batch, names)
            for k, own in codes(batch, x).items():
                yield _part(k, _scores(x - center, own, *clusters[k]))

    parts = points.mapInArrow(score, _PARTS_SCHEMA)
    return parts.groupBy("k").agg((F.sum("s") / F.sum("n")).alias("squared_silhouette"), F.sum("n").alias("n"))


def silhouette_of(
    df: DataFrame, columns: Sequence[str], label: str, row_id: str, standardize: bool = False, sample_rows: int | None = None,
    euclidean: bool = False,
) -> DataFrame:
    """Mean silhouette of labels the table already carries, over all complete rows, in squared distance.

    A missing label is a cluster of its own; labels may be as many as rows. With ``euclidean`` the distance is
    Euclidean, over all pairs of rows, for up to EXACT_ROWS rows and GATHERED_LABELS labels; with ``sample_rows``
    it is that of a seeded sample.
    """
    points, names = _points(df, columns, row_id, standardize, label, sample_rows)
    if sample_rows is not None:
        rows, matrix = _matrix(points, names)
        labels = np.array([r["label"] for r in rows])
        return sample_silhouettes(points, names, matrix, {0: labels}).select("silhouette", "n")
    center = _center(points, names)
    moved = [F.col(x) - F.lit(float(c)) for x, c in zip(names, center)]
    clusters = materialize(points.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(m) for m in moved]).alias("s"),
        F.sum(sum((m * m for m in moved), F.lit(0.0))).alias("q")), "cluster-sums")
    if row_count(clusters) > GATHERED_LABELS:
        if euclidean:
            raise ValueError(f"Euclidean silhouettes of all rows are for up to {GATHERED_LABELS} labels")
        return _scores_by_table(points, names, center, clusters)
    found = clusters.orderBy("label").collect()
    known = pa.array([r["label"] for r in found], pa.string())
    sizes = np.array([float(r["n"]) for r in found])
    stats = (sizes, np.array([r["s"] for r in found]).reshape(-1, len(names)), np.array([r["q"] for r in found]))

    def codes(batch, x):
        return {0: pc.index_in(batch.column("label"), value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)}

    if euclidean:
        return _euclidean_scores(points, names, {0: sizes}, codes).select("silhouette", "n")
    return _mean_scores(points, names, center, {0: stats}, codes).select("squared_silhouette", "n")


def _center(points: DataFrame, names: Sequence[str]) -> np.ndarray:
    """The mean of all rows; sums of squares taken from it keep their digits."""
    means = points.agg(*[F.avg(x).alias(x) for x in names]).first()
    return np.array([means[x] or 0.0 for x in names])


def silhouette_by_k(
    df: DataFrame, columns: Sequence[str], max_k: int, row_id: str, standardize: bool = False, sample_rows: int | None = None,
    cluster: Callable[[DataFrame, Sequence[str], Sequence[tuple[int, int]]], list[Fit]] = fit_all, euclidean: bool = False,
) -> DataFrame:
    """Mean silhouette for k = 2 up to min(max_k, rows/3), clustering all complete rows for each k.

    Distances are squared. With ``euclidean`` they are Euclidean, over all pairs of rows, for up to EXACT_ROWS
    rows; with ``sample_rows`` a seeded sample of that many rows is clustered and scored in Euclidean distance.
    """
    points, names = _points(df, columns, row_id, standardize, rows=sample_rows)
    n, measure = row_count(points), "silhouette" if euclidean or sample_rows is not None else "squared_silhouette"
    distinct = points.select(*names).distinct().limit(max_k).count()
    ks = range(2, min(max_k, n // 3, distinct) + 1)
    if n < MIN_SILHOUETTE_ROWS or not ks:
        return df.sparkSession.createDataFrame([], f"k int, {measure} double, n bigint")
    fits = cluster(points, names, [(k, seed) for k in ks for seed in SEEDS])
    centers = {k: best_fit([f for f in fits if f.k == k]).centers for k in ks}
    if sample_rows is not None:
        _, matrix = _matrix(points, names)
        return sample_silhouettes(points, names, matrix, {k: nearest(matrix, centers[k])[0] for k in ks}).orderBy("k")
    middle, d = _center(points, names), len(names)

    def add_up(batches):
        totals = {k: np.zeros(k * (d + 2)) for k in ks}
        for batch in batches:
            x = matrix_of(batch, names)
            for k in ks:
                own, y = nearest(x, centers[k])[0], x - middle
                totals[k] += np.concatenate([
                    np.bincount(own, minlength=k), *[np.bincount(own, y[:, j], k) for j in range(d)],
                    np.bincount(own, (y * y).sum(axis=1), k)])
        yield partial_batch(totals)

    sums = tree_sum(points.select(*names).mapInArrow(add_up, PARTIAL_SCHEMA), plain_scan=True)
    clusters = {}
    for k in ks:
        part = sums[k].reshape(d + 2, k)
        clusters[k] = (np.maximum(part[0], 1), part[1:-1].T, part[-1])

    def codes(batch, x):
        return {k: nearest(x, centers[k])[0] for k in ks}

    if euclidean:
        return _euclidean_scores(points, names, {k: sums[k].reshape(d + 2, k)[0] for k in ks}, codes).orderBy("k")
    return _mean_scores(points.select(*names), names, middle, clusters, codes).orderBy("k")


def suggest_k(by_k: DataFrame) -> int | None:
    """The k with the highest silhouette, the smallest one on ties."""
    row = by_k.orderBy(F.desc(by_k.columns[1]), "k").first()
    return None if row is None else row["k"]


def k_distance(df: DataFrame, columns: Sequence[str], min_samples: int, row_id: str, standardize: bool = False) -> DataFrame:
    """Percentiles over all complete rows of the distance to the (min_samples - 1)-th other row.

    The rank leaves the row itself out because DBSCAN counts it in. Empty when
    min_samples is below 2 or there are too few rows.
    """
    spark, kth = df.sparkSession, int(min_samples) - 1
    names = [f"p{p}" for p in PERCENTILES] + ["max"]
    schema = "n bigint, kth_neighbor int, " + ", ".join(f"{c} double" for c in names)
    if kth < 1:
        return spark.createDataFrame([], schema)
    points, axes = _points(df, columns, row_id, standardize)
    n = row_count(points)
    if n < kth + 1:
        return spark.createDataFrame([], schema)
    found = percentiles(kth_distances(points, axes, kth), n, PERCENTILES)
    return spark.createDataFrame([(n, kth, *[found[c] for c in names])], schema)
