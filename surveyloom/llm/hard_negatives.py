"""Hard negatives by exact inner products of packed integers.

Rows are stored once and packed into chunks where they are read; anchors are
packed into blocks as well. Every block of anchors meets every chunk: a task
holds the chunks of one group, and the blocks pass one by one. Within a chunk the components of several rows, biased to be
zero or more, lie in separate fields of one wide integer; an anchor's biased
component is multiplied with it once for all of them, the sums never leave
their fields, and the bias is taken out again when the fields are read. While
the fields fit into 53 bits the wide integers are doubles, in which such sums are
exact, and a chunk is one matrix product; beyond, they are integers of any width.

The first round finds the anchors' positives in chunks that share a label with
the block, the second the best rows of other labels under each positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.meetings import Best, groups, matrix, meet, narrow, numbers
from surveyloom.plans.scratch import materialize

SCALE = 256
CHUNK_ROWS = 4096
BLOCK_ANCHORS = 1024
LEAST, MOST = 80, 100  # a negative's score in hundredths of the positive's

_EXACT_BITS = 53
_LARGEST = np.iinfo(np.int64).max
_WIDE_FIELDS = 16
_STRIPE = 1 << 20  # scores held at once
_PACKED_BITS = 33
_PACKED = "pack long, dim int, low long, high long, row_ids binary, ids binary, labels binary, vectors binary"
_POSITIVES = "anchor_row long, anchor_id long, vec_id long, score long"
_NEGATIVES = "anchor_row long, place int, vec_id long, score long"


class Fields:
    """Candidates (rows of integers) packed so that one product gives several scores."""

    def __init__(self, candidates: np.ndarray, least: int, most: int):
        """``least`` and ``most`` bound the components of the anchors."""
        self.n, self.dim = candidates.shape
        self.least, self.most = least, most
        self.bias = int(candidates.min(initial=0))
        biased = candidates - self.bias
        self.sums = candidates.sum(axis=1)
        bits = max(1, (self.dim * int(biased.max(initial=0)) * (most - least)).bit_length())
        largest = self.dim * max(abs(least), abs(most), 1) * max(int(np.abs(candidates).max(initial=0)), 1)
        if largest >= 2**63:
            raise ValueError("inner products leave 64 bits")
        self.bits, self.exact = bits, bits <= _EXACT_BITS
        self.fields = _EXACT_BITS // bits if self.exact else _WIDE_FIELDS
        words = -(-self.n // self.fields)
        filled = np.zeros((words * self.fields, self.dim), np.int64)
        filled[:self.n] = biased
        kind = np.float64 if self.exact else object
        self.words = np.zeros((self.dim, words), kind)
        for k in range(self.fields):  # candidate i lies in word i mod words
            shift = float(1 << k * bits) if self.exact else 1 << k * bits
            self.words += filled[k * words:(k + 1) * words].T.astype(kind) * shift

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products, a row for each anchor."""
        biased = anchors - self.least
        product = biased.astype(self.words.dtype) @ self.words
        mask, words = (1 << self.bits) - 1, product.shape[1]
        found = np.empty((len(anchors), words * self.fields), np.int64)
        if self.exact:
            product = product.astype(np.int64)
        for k in range(self.fields):
            found[:, k * words:(k + 1) * words] = (product >> (k * self.bits)) & mask
        found = found[:, :self.n]
        # sum (a - least)(c - bias) = score - least sum c - bias sum (a - least)
        found += self.least * self.sums
        found += self.bias * biased.sum(axis=1)[:, None]
        return found


def _pack(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << _PACKED_BITS
        held: dict[int, list] = {}

        def packed(dim: int, rows: list) -> pa.RecordBatch:
            nonlocal number
            row, ids, labels, vectors = (np.concatenate([r[i] for r in rows]) for i in range(4))
            made = [number, dim, int(labels.min()), int(labels.max()), row.tobytes(), ids.tobytes(), labels.tobytes(), narrow(vectors).tobytes()]
            number += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(made, kinds, strict=True)], names=[c.split()[0] for c in _PACKED.split(", ")])

        for batch in batches:
            row, ids, labels = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(3)
            dims, values = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            begin = np.cumsum(dims) - dims
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                vectors = values[begin[at][:, None] + np.arange(dim)]
                rows = held.setdefault(dim, [])
                while len(at):
                    room = size - sum(len(r[0]) for r in rows)
                    now, at = at[:room], at[room:]
                    rows.append((row[now], ids[now], labels[now], vectors[:room]))
                    vectors = vectors[room:]
                    if sum(len(r[0]) for r in rows) == size:
                        yield packed(dim, rows)
                        rows.clear()
        for dim, rows in held.items():
            if rows:
                yield packed(dim, rows)
    return pack


class _Chunk:
    """A chunk of candidates, and their fields for the anchors met so far."""

    def __init__(self, row: dict):
        self.dim, self.low, self.high = (row[c].as_py() for c in ("dim", "low", "high"))
        self.rows, self.ids, self.labels = (numbers(row[c]) for c in ("row_ids", "ids", "labels"))
        self.vectors = matrix(row["vectors"], len(self.rows), self.dim)
        self.fields: Fields | None = None

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        least, most = int(anchors.min(initial=0)), int(anchors.max(initial=0))
        fields = self.fields
        if fields is None or least < fields.least or most > fields.most:
            candidates = self.vectors.astype(np.int64)
            if fields is not None:
                fields = Fields(candidates, min(least, fields.least), max(most, fields.most))
            if fields is None or not fields.exact:
                fields = Fields(candidates, least, most)
            if fields.exact:
                self.fields = fields
        return fields.scores(anchors)


class _Block:
    """A block of anchors."""

    def __init__(self, row: dict):
        self.dim, self.low, self.high = (row[c].as_py() for c in ("dim", "low", "high"))
        self.rows, self.ids, self.labels = (numbers(row[c]) for c in ("row_ids", "ids", "labels"))
        self.vectors = matrix(row["vectors"], len(self.rows), self.dim).astype(np.int64)


def _hits(scores: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, candidate, score) where the score is not below the anchor's least."""
    found = np.flatnonzero(scores >= least[:, None])
    anchor, candidate = np.divmod(found, scores.shape[1])
    return anchor, candidate, scores.ravel()[found]


def _stripes(chunk: _Chunk, block: _Block, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchors, scores) of the anchors ``at``, a few at a time."""
    step = max(1, _STRIPE // max(1, len(chunk.rows)))
    for i in range(0, len(at), step):
        yield at[i:i + step], chunk.scores(block.vectors[at[i:i + step]])


def _table(columns: list, kinds: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])


def _positives(k: int):
    """A block's best rows of its anchors' labels in some chunks."""
    def positives(chunks: list[_Chunk], row: dict) -> pa.RecordBatch:
        block = _Block(row)
        best = Best(len(block.rows), k)
        for chunk in chunks:
            at = np.flatnonzero((block.labels >= chunk.low) & (block.labels <= chunk.high))
            if chunk.dim != block.dim or not len(at):
                continue
            for anchors, scores in _stripes(chunk, block, at):
                fits = (chunk.labels == block.labels[anchors, None]) & (chunk.rows != block.rows[anchors, None])
                scores = np.where(fits, scores, -_LARGEST)
                floor = np.maximum(best.floor[anchors], 1 - _LARGEST)
                if (floor == 1 - _LARGEST).any() and scores.shape[1] > k:
                    floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
                anchor, other, score = _hits(scores, floor)
                best.add(anchors[anchor], score, chunk.ids[other])
        key, score, ids = best.settle()
        return _table([block.rows[key], block.ids[key], ids, score], [pa.int64()] * 4, _POSITIVES)
    return positives


def _negatives(k: int, positives: int, least: int, most: int):
    """A block's best rows of other labels under each positive in some chunks."""
    def negatives(chunks: list[_Chunk], row: dict) -> pa.RecordBatch:
        block = _Block(row)
        n = len(block.rows)
        # least * p <= 100 s <= most * p, in integers wide enough; a place without a positive has none.
        wanted = numbers(row["wanted"]).reshape(n, positives)
        if int(np.abs(wanted).max(initial=0)) * max(abs(least), abs(most)) >= _LARGEST:
            wanted = wanted.astype(object)
        empty = np.arange(positives) >= numbers(row["wanted_counts"])[:, None]
        low = np.where(empty, _LARGEST, np.clip(-(-least * wanted // 100), -_LARGEST, _LARGEST)).astype(np.int64)
        high = np.where(empty, -_LARGEST, np.clip(most * wanted // 100, -_LARGEST, _LARGEST)).astype(np.int64)
        best = Best(n * positives, k, low.ravel())
        for chunk in chunks:
            if chunk.dim != block.dim or block.low == block.high == chunk.low == chunk.high:
                continue
            for anchors, scores in _stripes(chunk, block, np.arange(n)):
                floor = best.floor.reshape(n, positives)[anchors]
                anchor, other, score = _hits(scores, floor.min(axis=1))
                kept = chunk.labels[other] != block.labels[anchors[anchor]]
                anchor, other, score = anchors[anchor[kept]], other[kept], score[kept]
                for place in range(positives):
                    fits = np.flatnonzero((score >= low[anchor, place]) & (score <= high[anchor, place]))
                    best.add(anchor[fits] * positives + place, score[fits], chunk.ids[other[fits]])
        key, score, ids = best.settle()
        anchor, place = np.divmod(key, positives)
        return _table([block.rows[anchor], place + 1, ids, score], [pa.int64(), pa.int32(), pa.int64(), pa.int64()], _NEGATIVES)
    return negatives


def _wanted(k: int):
    """Adds to each block its anchors' positive scores, k numbers for each, and how many there are."""
    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                anchors = numbers(row.column(batch.schema.get_field_index("row_ids"))[0])
                known = {p["anchor_row"]: p["scores"] for p in row.column(batch.schema.get_field_index("positives"))[0].as_py() or []}
                scores, counts = np.zeros((len(anchors), k), np.int64), np.zeros(len(anchors), np.int64)
                for i, anchor in enumerate(anchors.tolist()):
                    mine = known.get(anchor, [])
                    counts[i] = len(mine)
                    scores[i, :len(mine)] = mine
                columns = [row.column(i) for i in range(row.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([scores.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())],
                    names=[*row.schema.names[:-1], "wanted", "wanted_counts"])
    return wanted


def integer_rows(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(row_id, vec_id, label, v): rows that take part, each component x as floor(256 * x), x as double.

    Left out: rows with a null id, label or vector, and vectors with a null or
    non-finite component. Where the id is divisible by 7 the label becomes
    (label + 1) % 10.
    """
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    sound = (F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()
             & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    own, moved = F.col(label).cast("long"), (F.col(label).cast("long") + 1) % 10
    return table.filter(F.coalesce(sound, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row_id"), F.col(vec_id).cast("long").alias("vec_id"),
        F.when(F.col(vec_id) % 7 == 0, moved).otherwise(own).alias("label"),
        F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE)))).alias("v"))


def mine(table: DataFrame, positives: int = 5, negatives: int = 5, least: int = LEAST, most: int = MOST, every: int = 100,
         vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows whose id is divisible by ``every``. An anchor's
    positives are the ``positives`` other rows of its label with the highest inner
    product; a positive's negatives the ``negatives`` rows of other labels with
    the highest score s of those with least * p <= 100 * s <= most * p, p being the
    positive's score. Ties go to the smaller id. With fewer rows all are taken, with
    none there is no row; a negative positive score has none. Rows are told apart
    by themselves, not by id: rows that repeat an id, or repeat altogether, are rows of
    their own, and an anchor that stands twice is answered twice. Vectors meet only
    vectors of their own length; empty ones score 0. Other columns are not looked at; an empty table gives no
    rows. Products that could leave 64 bits raise an error.

    Blocks of 1,024 anchors pass groups of chunks of 4,096 rows, so anchors are copied once for each group.
    """
    spark = table.sparkSession
    rows = materialize(integer_rows(table, vec_id, vector, label), "vectors")
    order = rows.select("row_id", "vec_id", "label", "v")
    chunks = materialize(order.sortWithinPartitions("label").mapInArrow(_pack(CHUNK_ROWS), _PACKED), "chunks")
    few = max(1, -(-rows.stored_rows // (every * BLOCK_ANCHORS)))
    anchors = order.filter(F.col("vec_id") % every == 0).repartition(few).sortWithinPartitions("label")
    blocks = materialize(anchors.mapInArrow(_pack(BLOCK_ANCHORS), _PACKED), "blocks")
    widest = chunks.agg(F.max("dim")).first()[0] or 0
    count = groups(chunks.stored_rows, CHUNK_ROWS * widest, int(spark.conf.get("spark.sql.shuffle.partitions")))
    group = F.pmod(F.xxhash64("pack"), F.lit(count))
    by_score = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "vec_id")
    found = meet(chunks, blocks, group, count, _Chunk, _positives(positives), _POSITIVES).withColumn("place", F.row_number().over(by_score))
    best = materialize(found.filter(F.col("place") <= positives), "positives")

    # A block has at most BLOCK_ANCHORS anchors, so what it is handed is bounded.
    of_block = blocks.select("pack", "row_ids").mapInArrow(_anchor_rows, "pack long, anchor_row long")
    scores = best.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("s")).select(
        "anchor_row", F.col("s.score").alias("scores"))
    handed = of_block.join(scores, "anchor_row").groupBy("pack").agg(F.collect_list(F.struct("anchor_row", "scores")).alias("positives"))
    asking = materialize(blocks.join(handed, "pack").select(*blocks.columns, "positives").mapInArrow(
        _wanted(positives), f"{_PACKED}, wanted binary, wanted_counts binary"), "asking-blocks")
    by_score = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "vec_id")
    under = meet(chunks, asking, group, count, _Chunk, _negatives(negatives, positives, least, most), _NEGATIVES)
    ranked = under.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= negatives)
    return ranked.withColumnRenamed("score", "negative_score").join(
        best.select("anchor_row", "place", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
        ["anchor_row", "place"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", "negative_score")


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = numbers(rows)
            yield _table([np.full(len(ids), pack), ids], [pa.int64(), pa.int64()], "pack long, anchor_row long")
