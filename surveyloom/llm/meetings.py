"""Blocks of asking rows that meet every stored pack of rows, and the best each of them finds.

Packs are dealt out over groups. A task reads the packs of a group once and keeps them, then the
blocks follow one by one, so blocks are copied to each group, not to each pack, and a pack never
is. A task holds one group's packs and one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numbers of the packs that a task holds at once.
GROUP_VALUES = 1 << 22
_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest signed type that holds them all."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return np.ascontiguousarray(x, kind)


def numbers(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int64)


def matrix(value: pa.Scalar, rows: int, dim: int) -> np.ndarray:
    """What ``narrow`` made of a matrix, read back from its bytes."""
    stored = value.as_buffer()
    kind = np.dtype(f"i{len(stored) // (rows * dim)}") if rows * dim else np.int8
    return np.frombuffer(stored, kind).reshape(rows, dim)


def groups(packs: int, pack_values: int, partitions: int) -> int:
    """Over how many groups to deal packs: no more than ``partitions`` while a group's packs stay small enough to be held."""
    each = max(1, min(packs // max(1, partitions), GROUP_VALUES // max(1, pack_values)))
    return max(1, -(-packs // each))


def meet(packs: DataFrame, blocks: DataFrame, group: Column, count: int, hold: Callable, ask: Callable, schema: str,
         own: Column | None = None) -> DataFrame:
    """What ``ask(held, block)`` returns for each block in each group, ``held`` being what ``hold(pack)`` made of the group's packs.

    Packs and blocks are handed over as dictionaries of Arrow scalars. ``group`` deals packs over ``count`` groups;
    blocks go to all of them, or to their ``own`` alone.
    """
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    held = packs.select(group.cast("int").alias("group"), F.lit(False).alias("asks"), *packs.columns)
    asking = blocks.select((everywhere if own is None else own.cast("int")).alias("group"), F.lit(True).alias("asks"), *blocks.columns)
    stream = held.unionByName(asking, allowMissingColumns=True).repartition(count, "group").sortWithinPartitions("group", "asks")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, []
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i] for j, name in enumerate(names)}
                if row["group"].as_py() != at:
                    at, known = row["group"].as_py(), []
                if not row["asks"].as_py():
                    known.append(hold(row))
                elif known:
                    yield ask(known, row)
            pa.default_memory_pool().release_unused()

    return stream.mapInArrow(answer, schema)


class Best:
    """The k best (score, id) of each of n keys: highest score first, ties by smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        """``floor`` holds scores below which nothing is asked for."""
        self.n, self.k = n, k
        self.floor = np.full(n, _NONE) if floor is None else floor.copy()
        self.last = np.full(n, _LAST)  # the id of the k-th best, once there are k at the floor
        self.parts: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 3]
        self.pending = 0

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        floor = self.floor[key]
        kept = (score > floor) | ((score == floor) & (ids <= self.last[key]))
        self.parts.append((key[kept], score[kept], ids[kept]))
        self.pending += len(self.parts[-1][0])
        if self.pending > 4 * self.k * self.n:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, score, id) of the best so far; raises the floors of the keys that have k."""
        key, score, ids = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        begin = np.searchsorted(key, np.arange(self.n))
        rank = np.arange(len(key)) - begin[key]
        last = rank == self.k - 1
        self.floor[key[last]], self.last[key[last]] = score[last], ids[last]
        kept = rank < self.k
        self.parts, self.pending = [(key[kept], score[kept], ids[kept])], 0
        return self.parts[0]
