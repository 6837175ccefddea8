"""Regularized iterative PCA imputation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.numeric import as_number, col
from surveyloom.operators.missing import require_numbers
from surveyloom.plans.scratch import discard, materialize
from surveyloom.plans.vectors import (
    PARTIAL_SCHEMA, cross_products, eigen, matrix_of, partial_batch, tree_sum,
)


# Rows below which gaps are left as they are.
MIN_ROWS = 3

# Steps replayed before the rows are stored as they stand.
_CARRY = 8

# Numbers that the statistics of all patterns of gaps may take; with more, iterations pass over the rows.
_PATTERN_NUMBERS = 1 << 18


@dataclass
class Step:
    """One update of the missing cells: standardize, project on V, shrink, rebuild."""

    mean: np.ndarray
    sd: np.ndarray
    vectors: np.ndarray
    shrink: np.ndarray

    def apply(self, x: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        scores = ((x - self.mean) / self.sd) @ self.vectors.T * self.shrink
        return np.where(gaps, scores @ self.vectors * self.sd + self.mean, x)


    def carry(self, maps: np.ndarray, shift: np.ndarray, gaps: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The update as a change of the affine map by which rows with these gaps, seen from ``start``, follow from their observed cells."""
        project = (self.vectors.T * self.shrink) @ self.vectors / self.sd[:, None] * self.sd
        mean = self.mean - start
        return np.where(gaps, maps @ project, maps), np.where(gaps, (shift - mean) @ project + mean, shift)


def _after(gaps: np.ndarray, steps: Sequence[Step], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The affine map from observed cells to completed rows after all steps, for rows with these gaps."""
    maps, shift = np.eye(len(gaps)), np.zeros(len(gaps))
    for step in steps:
        maps, shift = step.carry(maps, shift, gaps, start)
    return maps, shift


@dataclass
class IterativeFill:
    columns: list[str]
    start: np.ndarray
    steps: list[Step]
    converged: bool
    rank: int
    filled: int

    @property
    def iterations(self) -> int:
        return len(self.steps)

    def renamed(self, names: dict[str, str]) -> IterativeFill:
        return replace(self, columns=[names[c] for c in self.columns])

    def fill(self, df: DataFrame) -> DataFrame:
        """The table with its gaps filled; observed numbers are never changed.

        Complete rows pass through untouched, only incomplete rows visit Python.
        """
        columns, start, steps = self.columns, self.start, self.steps
        typed = df.select(*[as_number(df, c).alias(c) if c in columns else col(c) for c in df.columns])
        if not self.filled:
            return typed
        gap = reduce(Column.__or__, [col(c).isNull() for c in columns])

        def rebuild(batches):
            known = {}
            for batch in batches:
                x = matrix_of(batch, columns)
                gaps = np.isnan(x)
                kinds, kind = np.unique(np.packbits(gaps, axis=1), axis=0, return_inverse=True)
                if len(kinds) * len(columns) > len(x):  # maps of so many patterns cost more than the steps
                    now, _ = _replay(np.where(gaps, start, x), gaps, steps)
                else:
                    now = x.copy()
                    if len(known) * len(columns) ** 2 > _PATTERN_NUMBERS:
                        known.clear()
                    for i, code in enumerate(kinds):
                        rows = np.flatnonzero(kind.ravel() == i)
                        gone = gaps[rows[0]]
                        if code.tobytes() not in known:
                            known[code.tobytes()] = _after(gone, steps, start)
                        maps, shift = known[code.tobytes()]
                        seen = np.where(gone, 0.0, x[rows] - start)
                        now[np.ix_(rows, gone)] = (seen @ maps[:, gone]) + shift[gone] + start[gone]
                arrays = [
                    pa.array(now[:, columns.index(name)]) if name in columns else batch.column(name)
                    for name in batch.schema.names
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

        return typed.filter(~gap).unionByName(typed.filter(gap).mapInArrow(rebuild, typed.schema))


def _fit_step(n: int, sums: np.ndarray, gram: np.ndarray, center: np.ndarray, rank: int, standardize: bool) -> Step:
    shift = sums / n
    cov = gram / n - np.outer(shift, shift)
    sd = np.ones(len(center))
    if standardize:
        spread = np.sqrt(np.clip(np.diag(cov), 0, None))
        sd = np.where(spread > 0, spread, 1.0)
    values, vectors = eigen(cov / np.outer(sd, sd))
    values = np.clip(values, 0, None)
    kept = values[:rank]
    noise = values[rank:].mean() if rank < len(values) else 0.0
    shrink = np.divide(np.clip(kept - noise, 0, None), kept, out=np.zeros(rank), where=kept > 0)
    return Step(center + shift, sd, vectors[:rank], shrink)


def _replay(now: np.ndarray, gaps: np.ndarray, steps: Sequence[Step]) -> tuple[np.ndarray, np.ndarray]:
    """Completed rows after all steps, and the rows one step earlier."""
    before = now
    for step in steps:
        before, now = now, step.apply(now, gaps)
    return now, before


def _by_pattern(gapped: DataFrame, names: Sequence[str], start: np.ndarray) -> dict[tuple, np.ndarray] | None:
    """For each pattern of gaps its rows' number, sums and cross products, seen from ``start`` with gaps as zeros; None if there are too many."""
    p = len(names)
    most = _PATTERN_NUMBERS // (1 + p + p * p)
    marks = gapped.select(F.array(*[F.col(x).isNull() for x in names]).alias("gaps"))
    found = sorted(tuple(r["gaps"]) for r in marks.distinct().limit(most + 1).collect())
    if len(found) > most:
        return None
    place = {np.packbits(gaps).tobytes(): i for i, gaps in enumerate(found)}

    def accumulate(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            x = matrix_of(batch, names)
            gaps = np.isnan(x)
            kinds, kind = np.unique(np.packbits(gaps, axis=1), axis=0, return_inverse=True)
            order = np.argsort(kind.ravel(), kind="stable")
            ends = np.cumsum(np.bincount(kind.ravel(), minlength=len(kinds)))
            seen = np.where(gaps, 0.0, x - start)[order]
            for code, lo, hi in zip(kinds, np.append(0, ends), ends):
                rows, key = seen[lo:hi], place[code.tobytes()]
                part = np.concatenate([[hi - lo], rows.sum(axis=0), (rows.T @ rows).ravel()])
                totals[key] = totals[key] + part if key in totals else part
        yield partial_batch(totals)

    sums = tree_sum(gapped.select(*names).mapInArrow(accumulate, PARTIAL_SCHEMA))
    return {found[i]: total for i, total in sums.items()}


class _Patterns:
    """Iterations on what the patterns of gaps add up to: a completed row is an affine map, its pattern's, of its observed cells."""

    def __init__(self, totals: dict[tuple, np.ndarray], start: np.ndarray):
        p = len(start)
        self.start = start
        self.gaps = [np.array(g, dtype=bool) for g in totals]
        self.parts = [(t[0], t[1 : 1 + p], t[1 + p :].reshape(p, p)) for t in totals.values()]
        self.maps = [(np.eye(p), np.zeros(p)) for _ in totals]

    def step(self, step: Step | None) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Sums and cross products of the rows after the step, how far filled cells moved, and their size."""
        sums, gram, moved, size = np.zeros(len(self.start)), np.zeros((len(self.start),) * 2), 0.0, 0.0
        for i, (gaps, (n, s, g)) in enumerate(zip(self.gaps, self.parts, strict=True)):
            before, at = self.maps[i]
            maps, shift = (before, at) if step is None else step.carry(before, at, gaps, self.start)
            self.maps[i] = maps, shift
            total = s @ maps + n * shift
            cross = np.outer(s @ maps, shift)
            square = maps.T @ g @ maps + cross + cross.T + n * np.outer(shift, shift)
            d, e = (maps - before)[:, gaps], (shift - at)[gaps]
            moved += max(np.einsum("ij,ik,kj->", d, g, d) + 2 * (s @ d) @ e + n * (e @ e), 0.0)
            away = self.start[gaps]
            size += np.diag(square)[gaps].sum() + 2 * away @ total[gaps] + n * (away @ away)
            sums, gram = sums + total, gram + square
        return sums, gram, float(moved), float(size)


def fit_iterative(
    df: DataFrame,
    columns: Sequence[str],
    rank: int = 2,
    standardize: bool = True,
    max_iter: int = 200,
    tol: float = 1e-8,
) -> IterativeFill:
    """Fill gaps from the low-rank structure of the other columns.

    Complete rows enter once, as fixed cross products. Where the patterns of gaps
    are few, so do the others: a filled row is an affine map of its observed cells
    that only its pattern decides, so an iteration needs each pattern's cross
    products and no row. Otherwise an iteration is one
    pass over the incomplete rows alone. These are stored as they stand every
    few iterations, beside a mark for each gap, so an iteration replays only the
    steps since then and the two hundredth costs what the tenth does. The stored
    rows are a table: nothing is kept that an executor could lose.
    """
    columns = list(columns)
    p = len(columns)
    rank = max(1, min(rank, p - 1))
    require_numbers(df, columns)
    views = {c: as_number(df, c) for c in columns}
    names = [f"x{i}" for i in range(p)]
    numbers = df.select(*[views[c].alias(x) for c, x in zip(columns, names)])
    stats = numbers.agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(x) for x in names],
                        *[F.count(x).alias(f"c{x}") for x in names]).first()
    n = stats["n"]
    start = np.array([stats[x] for x in names])
    filled = sum(n - stats[f"c{x}"] for x in names)
    if not filled or n < MIN_ROWS:
        return IterativeFill(columns, start, [], True, rank, 0)

    whole = numbers.dropna()
    gapped = numbers.filter(" or ".join(f"{x} is null" for x in names))
    _, base_sums, base_gram = cross_products(whole, [F.col(x) for x in names], start)
    marks = [f"gap{i}" for i in range(p)]
    layout = ", ".join([f"{x} double" for x in names] + [f"{g} boolean" for g in marks])

    def stored(now: np.ndarray, gaps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*now.T, *gaps.T)], names=[*names, *marks])

    def begin(batches):
        for batch in batches:
            x = matrix_of(batch, names)
            gaps = np.isnan(x)
            yield stored(np.where(gaps, start, x), gaps)

    def carry(rows: DataFrame, recent: list[Step]) -> DataFrame:
        def run(batches):
            for batch in batches:
                gaps = matrix_of(batch, marks).astype(bool)
                yield stored(_replay(matrix_of(batch, names), gaps, recent)[0], gaps)

        return materialize(rows.mapInArrow(run, layout), "fills")

    def measure(rows: DataFrame, recent: list[Step]) -> tuple[np.ndarray, np.ndarray, float, float]:
        def accumulate(batches):
            total = np.zeros(2 + p + p * p)
            for batch in batches:
                gaps = matrix_of(batch, marks).astype(bool)
                now, before = _replay(matrix_of(batch, names), gaps, recent)
                total[0] += ((now - before)[gaps] ** 2).sum()
                total[1] += (now[gaps] ** 2).sum()
                centered = now - start
                total[2 : 2 + p] += centered.sum(axis=0)
                total[2 + p :] += (centered.T @ centered).ravel()
            yield partial_batch({0: total})

        total = tree_sum(rows.mapInArrow(accumulate, PARTIAL_SCHEMA), plain_scan=True)[0]
        return total[2 : 2 + p], total[2 + p :].reshape(p, p), total[0], total[1]

    steps: list[Step] = []
    recent: list[Step] = []
    converged = False
    totals = _by_pattern(gapped, names, start)
    if totals is not None:
        patterns = _Patterns(totals, start)
        sums, gram, _, _ = patterns.step(None)
        while len(steps) < max_iter and not converged:
            steps.append(_fit_step(n, base_sums + sums, base_gram + gram, start, rank, standardize))
            sums, gram, moved, size = patterns.step(steps[-1])
            converged = moved <= tol * max(size, 1e-12)
        return IterativeFill(columns, start, steps, bool(converged), rank, filled)
    rows = materialize(gapped.mapInArrow(begin, layout), "fills")
    sums, gram, _, _ = measure(rows, recent)
    while len(steps) < max_iter and not converged:
        if len(recent) == _CARRY:
            before, rows, recent = rows, carry(rows, recent), []
            discard(before)
        steps.append(_fit_step(n, base_sums + sums, base_gram + gram, start, rank, standardize))
        recent = [*recent, steps[-1]]
        sums, gram, moved, size = measure(rows, recent)
        converged = moved <= tol * max(size, 1e-12)
    discard(rows)
    return IterativeFill(columns, start, steps, bool(converged), rank, filled)


def impute_iterative(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    return fit_iterative(df, columns, **options).fill(df)
