"""Facts of many columns in one pass, with what leaves a task bounded whatever its rows hold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

# Sketch of 2,048 registers: distinct counts within a few per cent.
_INDEX_BITS = 11
_REST_BITS = 64 - _INDEX_BITS
# Tasks are merged in this many parts for each column, and only the parts reach the driver.
_PARTS = 64
_SCHEMA = ("idx int, part int, rows bigint, present bigint, lo double, hi double, flag boolean, "
           "many boolean, ids array<bigint>, registers binary")


@dataclass
class Facts:
    """What is known of one column: its cells' identities one by one up to ``most`` of them, and a sketch of all."""

    most: int
    rows: int = 0
    present: int = 0
    lo: float | None = None
    hi: float | None = None
    flag: bool = True
    ids: np.ndarray | None = field(default_factory=lambda: np.empty(0, np.int64))
    registers: np.ndarray = field(default_factory=lambda: np.zeros(1 << _INDEX_BITS, np.uint8))

    def add(self, ids: np.ndarray, numbers: np.ndarray | None, flag: bool) -> None:
        self.present += len(ids)
        self.flag = self.flag and flag
        if numbers is not None and len(numbers):
            self._widen(float(numbers.min()), float(numbers.max()))
        if self.ids is None:
            self._sketch(ids)
        else:
            self._keep(np.union1d(self.ids, ids))

    def merge(self, other: Facts) -> None:
        self.rows += other.rows
        self.present += other.present
        self.flag = self.flag and other.flag
        if other.lo is not None:
            self._widen(other.lo, other.hi)
        np.maximum(self.registers, other.registers, out=self.registers)
        if self.ids is not None:
            if other.ids is None:
                self._sketch(self.ids)
                self.ids = None
            else:
                self._keep(np.union1d(self.ids, other.ids))
        elif other.ids is not None:
            self._sketch(other.ids)

    def _widen(self, lo: float, hi: float) -> None:
        self.lo = lo if self.lo is None else min(self.lo, lo)
        self.hi = hi if self.hi is None else max(self.hi, hi)

    def _keep(self, ids: np.ndarray) -> None:
        self.ids = ids
        if len(ids) > self.most:
            self._sketch(ids)
            self.ids = None

    def _sketch(self, ids: np.ndarray) -> None:
        """Raise each identity's register to the rank of its first set bit."""
        h = ids.astype(np.int64).view(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
        rest = h & np.uint64((1 << _REST_BITS) - 1)
        rank = _REST_BITS + 1 - np.frexp(rest.astype(float))[1]
        np.maximum.at(self.registers, (h >> np.uint64(_REST_BITS)).astype(np.int64), rank.astype(np.uint8))

    def distinct(self) -> tuple[int | None, int]:
        """(exact, estimated) number of different cells; no exact one where there are more than ``most``."""
        if self.ids is not None:
            return len(self.ids), len(self.ids)
        m = len(self.registers)
        empty = int((self.registers == 0).sum())
        guess = 0.7213 / (1 + 1.079 / m) * m * m / np.exp2(-self.registers.astype(float)).sum()
        if guess <= 2.5 * m and empty:
            guess = m * np.log(m / empty)
        return None, max(self.most + 1, round(guess))


def _batch(found: Sequence[tuple[int, int, Facts]]) -> pa.RecordBatch:
    facts = [f for _, _, f in found]
    return pa.RecordBatch.from_pydict({
        "idx": pa.array([i for i, _, _ in found], pa.int32()), "part": pa.array([p for _, p, _ in found], pa.int32()),
        "rows": pa.array([f.rows for f in facts], pa.int64()), "present": pa.array([f.present for f in facts], pa.int64()),
        "lo": pa.array([f.lo for f in facts], pa.float64()), "hi": pa.array([f.hi for f in facts], pa.float64()),
        "flag": pa.array([f.flag for f in facts], pa.bool_()), "many": pa.array([f.ids is None for f in facts], pa.bool_()),
        "ids": pa.array([[] if f.ids is None else f.ids for f in facts], pa.list_(pa.int64())),
        "registers": pa.array([f.registers.tobytes() for f in facts], pa.binary()),
    })


def _facts(row: dict, most: int) -> Facts:
    return Facts(most, row["rows"], row["present"], row["lo"], row["hi"], row["flag"],
                 None if row["many"] else np.array(row["ids"], np.int64), np.frombuffer(row["registers"], np.uint8).copy())


def gather_facts(cells: DataFrame, width: int, most: int) -> list[Facts]:
    """The facts of ``width`` columns, each given by up to three columns of ``cells``.

    ``h0, h1 ...`` are identities of cells (64 bits), ``m0, m1 ...`` their numbers, null where there is none, and
    ``t0, t1 ...`` say whether a cell is one of two flags. A column without identities has its numbers as such.
    A task emits at most ``most`` identities and one sketch for each column; a column with more in one task has
    more in all. Tasks are merged in parts by the cluster, so the driver sees a fixed amount for each column.
    """
    have = set(cells.columns)

    def scan(batches):
        found = [Facts(most) for _ in range(width)]
        for batch in batches:
            for i, facts in enumerate(found):
                facts.rows += batch.num_rows
                numbers = batch.column(f"m{i}").drop_null().to_numpy(zero_copy_only=False) + 0.0 if f"m{i}" in have else None
                if f"h{i}" in have:
                    ids = batch.column(f"h{i}").drop_null().to_numpy(zero_copy_only=False)
                    flag = f"t{i}" in have and batch.column(f"t{i}").false_count == 0
                else:
                    ids, flag = numbers.view(np.int64), bool(np.isin(numbers, (0.0, 1.0)).all())
                facts.add(ids, numbers, flag)
        part = TaskContext.get().partitionId() % _PARTS
        yield _batch([(i, part, f) for i, f in enumerate(found)])

    def merge(table: pa.Table) -> pa.Table:
        total = None
        for row in (r for b in table.to_batches(64) for r in b.to_pylist()):
            facts = _facts(row, most)
            if total is None:
                total = facts
            else:
                total.merge(facts)
        return pa.Table.from_batches([_batch([(row["idx"], row["part"], total)])])

    merged = [Facts(most) for _ in range(width)]
    for row in cells.mapInArrow(scan, _SCHEMA).groupBy("idx", "part").applyInArrow(merge, _SCHEMA).collect():
        merged[row["idx"]].merge(_facts(row.asDict(), most))
    return merged
