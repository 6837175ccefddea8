"""Exact inner-product top-k by a KD-tree for each shard of the vectors.

Rows are dealt over shards by a hash of their own number. Each shard becomes one stored
row: its vectors in the order of a KD-tree with median splits, and the tight
bounding box of every node. Queries go through in blocks, each block against
each shard of the same dimension. A shard is walked best first, by all queries of a
block that can still find something in a node: the node whose box allows the highest
score comes next, and a query goes on into those boxes only that can still beat
the k-th score it knows. Queries first meet their home shard; the k-th score found
there travels with them to all others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.meetings import Best, groups, matrix, meet, narrow, numbers
from surveyloom.plans.scratch import materialize

SHARD_ROWS = 4096
BLOCK_QUERIES = 1024
LEAF_ROWS = 64
SCALE = 1024

_SHARD = "shard long, dim int, rows binary, ids binary, vectors binary, nodes binary, boxes binary"
_BLOCK = "home_group int, dim int, rows binary, ids binary, vectors binary, homes binary, least binary"
_FOUND = "query_row long, query_id long, vec_id long, score long"


def integer_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row_id, vec_id, v): each component x as floor(1024 * x), x as double.

    Left out: null ids, null vectors, and vectors with a null or non-finite
    component. Each row has a number of its own (row_id).
    """
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    sound = (F.col(vec_id).isNotNull() & F.col(vector).isNotNull()
             & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    scaled = F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE))))
    return table.filter(F.coalesce(sound, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row_id"), F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("v"))


def _build(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row order, nodes (begin, end, left child or -1) and boxes (low, high) of a KD-tree."""
    order, nodes, boxes = np.arange(len(vectors)), [], []
    todo = [(0, len(vectors), -1)]
    while todo:
        begin, end, parent = todo.pop()
        inside = vectors[order[begin:end]]
        low, high = inside.min(axis=0), inside.max(axis=0)
        number = len(nodes)
        nodes.append([begin, end, -1])
        boxes.append(np.concatenate([low, high]))
        if parent >= 0 and nodes[parent][2] < 0:
            nodes[parent][2] = number
        elif parent >= 0:
            nodes[parent].append(number)
        if end - begin > LEAF_ROWS and (high > low).any():
            axis, middle = int(np.argmax(high.astype(np.float64) - low)), (end - begin) // 2
            order[begin:end] = order[begin:end][np.argpartition(inside[:, axis], middle)]
            todo += [(begin + middle, end, number), (begin, begin + middle, number)]
    table = np.array([[*n, *[-1] * (4 - len(n))] for n in nodes], np.int64)
    return order, table, np.array(boxes, np.int64)


def _one(values: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x], kinds[t]) for x, (_, t) in zip(values, fields, strict=True)], names=[c for c, _ in fields])


def _by_length(lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) for each length of the lists."""
    dims, values = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    begin = np.cumsum(dims) - dims
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, values[begin[at][:, None] + np.arange(dim)]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A tree for each shard and length; the rows of a shard follow each other."""
    held: dict[int, list] = {}
    at = None

    def built() -> Iterator[pa.RecordBatch]:
        for dim, parts in held.items():
            rows, ids, vectors = (np.concatenate(c) for c in zip(*parts, strict=True))
            first = np.lexsort((rows, ids))
            order, nodes, boxes = _build(vectors[first])
            order = first[order]
            yield _one([at, dim, rows[order].tobytes(), ids[order].tobytes(), narrow(vectors[order]).tobytes(), nodes.tobytes(),
                        narrow(boxes).tobytes()], _SHARD)

    for batch in batches:
        shards = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for i, j in zip(edges, edges[1:]):
            if i == j:
                continue
            if at != int(shards[i]):
                yield from built()
                held, at = {}, int(shards[i])
            rows, ids = (batch.column(c).to_numpy()[i:j] for c in (1, 2))
            for dim, here, vectors in _by_length(batch.column(3).slice(i, j - i)):
                held.setdefault(dim, []).append((rows[here], ids[here], vectors))
    yield from built()


def _pack(size: int):
    """Queries in blocks of one home group and one length; those of a group follow each other."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        at = None

        def packed(dim: int) -> Iterator[pa.RecordBatch]:
            whole = [np.concatenate(c) for c in zip(*held.pop(dim), strict=True)]
            for i in range(0, len(whole[0]), size):
                rows, ids, homes, known, least, vectors = (c[i:i + size] for c in whole)
                yield _one([at, dim, rows.tobytes(), ids.tobytes(), narrow(vectors).tobytes(), homes.tobytes(),
                            np.where(known, least, np.iinfo(np.int64).min).tobytes()], _BLOCK)

        for batch in batches:
            places = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(places)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if at != int(places[i]):
                    for dim in list(held):
                        yield from packed(dim)
                    at = int(places[i])
                rows, ids, homes = (batch.column(c).to_numpy()[i:j] for c in (1, 2, 3))
                least = batch.column(4).slice(i, j - i)
                known, least = least.is_valid().to_numpy(zero_copy_only=False), least.fill_null(0).to_numpy(zero_copy_only=False)
                for dim, here, vectors in _by_length(batch.column(5).slice(i, j - i)):
                    parts = held.setdefault(dim, [])
                    parts.append((rows[here], ids[here], homes[here], known[here], least[here], vectors))
                    if sum(len(p[0]) for p in parts) >= size:
                        yield from packed(dim)
        for dim in list(held):
            yield from packed(dim)
    return pack


def _most(x: np.ndarray) -> int:
    """The greatest absolute value, at least 1."""
    return max(-int(x.min(initial=0)), int(x.max(initial=0)), 1)


def _length(x: np.ndarray) -> float:
    """The greatest Euclidean length of the rows, rounded up."""
    return float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0)) * (1 + 1e-9)


class _Tree:
    def __init__(self, row: dict):
        self.shard, self.dim = row["shard"].as_py(), row["dim"].as_py()
        self.rows, self.ids = numbers(row["rows"]), numbers(row["ids"])
        self.nodes = numbers(row["nodes"]).reshape(-1, 4)
        boxes = matrix(row["boxes"], len(self.nodes), 2 * self.dim).astype(np.int64)
        self.exact = matrix(row["vectors"], len(self.rows), self.dim).astype(np.int64), boxes[:, :self.dim], boxes[:, self.dim:]
        self.most = _most(boxes)
        self.longest = _length(np.maximum(*(np.abs(x.astype(np.float64)) for x in self.exact[1:])))
        self.floats: dict[type, tuple] = {}

    def numbers(self, queries: np.ndarray) -> tuple:
        """Floats while every sum of products is exact in them, else integers.

        The products of a query and a vector or a corner of a box, and so all sums of some of them, stay below the
        product of their lengths.
        """
        if self.most * _most(queries) * self.dim >= 2**63:
            raise ValueError("inner products leave 64 bits")
        largest = self.longest * _length(queries)
        kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64
        if kind is np.int64:
            return queries, *self.exact
        if kind not in self.floats:
            self.floats[kind] = tuple(np.ascontiguousarray(x, kind) for x in self.exact)
        return queries.astype(kind), *self.floats[kind]

    def search(self, query_rows: np.ndarray, queries: np.ndarray, places: np.ndarray, best: Best) -> None:
        """Enter the rows that can be among the best of the queries, which have these ``places`` in ``best``."""
        q, vectors, low, high = self.numbers(queries)
        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        heap = [(-bound[:, 0].max(initial=0), 0, np.arange(len(q)))]
        while heap:
            _, node, alive = heapq.heappop(heap)
            alive = alive[bound[alive, node] >= best.floor[places[alive]]]
            if not len(alive):
                continue
            begin, end, left, right = self.nodes[node].tolist()
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(heap, (-bound[alive, child].max(), child, alive))
                continue
            scores = (q if len(alive) == len(q) else q[alive]) @ vectors[begin:end].T
            hits = np.flatnonzero(scores >= best.floor[places[alive]].astype(scores.dtype)[:, None])
            asked, row = np.divmod(hits, end - begin)
            other = begin + row
            own = self.rows[other] == query_rows[alive[asked]]
            if own.any():
                asked, row, other = asked[~own], row[~own], other[~own]
            best.add(places[alive[asked]], scores[asked, row].astype(np.int64), self.ids[other])


def _ask(k: int, at_home: bool):
    """A block's best rows in the shards that are, or are not, the homes of its queries."""
    def ask(trees: list[_Tree], block: dict) -> pa.RecordBatch:
        dim, rows, ids, homes = block["dim"].as_py(), numbers(block["rows"]), numbers(block["ids"]), numbers(block["homes"])
        queries = matrix(block["vectors"], len(rows), dim).astype(np.int64)
        best = Best(len(rows), k, numbers(block["least"]))
        for tree in trees:
            if tree.dim == dim:
                places = np.flatnonzero((homes == tree.shard) == at_home)
                if len(places):
                    tree.search(rows[places], queries[places], places, best)
        key, score, other = best.settle()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (rows[key], ids[key], other, score)], names=["query_row", "query_id", "vec_id", "score"])
    return ask


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(table: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row whose id is divisible by ``every``.

    The score is the inner product of the integer vectors; ties go to the
    smaller id. A query is not its own candidate; rows that repeat an id, or repeat
    altogether, are rows of their own, as queries and as candidates. Vectors meet only vectors of
    their own length; empty ones score 0. With fewer
    than k candidates all are returned, with none no row. Products that leave
    64 bits raise an error.
    """
    spark = table.sparkSession
    rows = materialize(integer_vectors(table, vec_id, vector).withColumn("dim", F.size("v")), "vectors")
    shards = max(1, -(-rows.stored_rows // SHARD_ROWS))
    home = F.pmod(F.xxhash64("row_id"), F.lit(shards))
    trees = materialize(
        rows.select(home.alias("shard"), "row_id", "vec_id", "v").repartition("shard").sortWithinPartitions("shard").mapInArrow(_shards, _SHARD),
        "trees")
    widest = rows.agg(F.max("dim")).first()[0] or 0
    count = groups(shards, SHARD_ROWS * widest, int(spark.conf.get("spark.sql.shuffle.partitions")))
    group = F.pmod(F.col("shard"), F.lit(count))
    queries = rows.filter(F.col("vec_id") % every == 0).select("row_id", "vec_id", home.alias("home"), "v")

    near = queries.select(F.pmod("home", F.lit(count)).cast("int").alias("home_group"), "row_id", "vec_id", "home", F.lit(None).cast("long").alias("least"), "v")
    first = near.repartition(count, "home_group").sortWithinPartitions("home_group").mapInArrow(_pack(BLOCK_QUERIES), _BLOCK)
    at_home = materialize(meet(trees, first, group, count, _Tree, _ask(k, True), _FOUND, F.col("home_group")), "home")
    kth = at_home.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).select(
        F.col("query_row").alias("row_id"), F.when(F.col("n") >= k, F.col("s")).alias("least"))
    onward = queries.join(kth, "row_id", "left").select(F.lit(-1).alias("home_group"), "row_id", "vec_id", "home", "least", "v")
    per_block = max(1, -(-rows.stored_rows // (every * BLOCK_QUERIES)))
    blocks = materialize(onward.repartition(per_block).mapInArrow(_pack(BLOCK_QUERIES), _BLOCK), "blocks")
    elsewhere = meet(trees, blocks, group, count, _Tree, _ask(k, False), _FOUND)
    return _best(at_home.unionByName(elsewhere), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
