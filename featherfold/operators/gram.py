"""Means and centred cross products of many columns, per fold, in one pass, and the lasso path on them.

Each task keeps one mean vector and one matrix per fold and merges its batches into them, without squares of
large values ever being subtracted.  The scan runs in as many tasks as a shuffle is wide, not one per
file split, so that what meets afterwards grows with the cluster and not with the data; it merges in two levels.
Only a matrix per fold reaches the driver, so columns may number some thousands.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import as_col

_SCHEMA = "level int, fold int, n long, mean array<double>, cross array<double>"
_NAMES = ["level", "fold", "n", "mean", "cross"]


@dataclass
class Moments:
    """Row count, means, and sums of products of deviations from the means."""

    n: int
    mean: np.ndarray
    cross: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> "Moments":
        mean = x.mean(axis=0)
        off = x - mean
        return Moments(len(x), mean, off.T @ off)

    def __add__(self, other: "Moments | None") -> "Moments":
        if other is None:
            return self
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n))


def _rows(level: int, held: dict[int, Moments]) -> Iterator[pa.RecordBatch]:
    for fold, m in held.items():
        values = [[level], [fold], [m.n], [m.mean], [m.cross.ravel()]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=_NAMES)


def fold_moments(df: DataFrame, columns: Sequence[str], fold: Column | None = None) -> dict[int, Moments]:
    """Moments of ``columns``, a missing value counting as 0, for each value of ``fold`` (all rows: 0)."""
    k = len(columns)
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    groups = max(1, math.isqrt(width))
    own = F.lit(0) if fold is None else fold.cast("int")
    wide = df.select(own.alias("fold"), *[F.coalesce(as_col(c).cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)])

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, Moments] = {}
        for batch in batches:
            folds = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            for f in np.unique(folds).tolist():
                held[f] = Moments.of(x[folds == f]) + held.get(f)
        yield from _rows(TaskContext.get().partitionId() % groups, held)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            for level, f, n, mean, cross in zip(*[batch.column(c) for c in range(5)]):
                one = Moments(n.as_py(), mean.values.to_numpy(), cross.values.to_numpy().reshape(k, k))
                held[f.as_py()] = one + held.get(f.as_py())
        yield from _rows(0, held)

    parts = wide.coalesce(width).mapInArrow(add_up, _SCHEMA)
    parts = parts.repartition(groups, "level").sortWithinPartitions("level", "fold", "n", "mean").mapInArrow(merge, _SCHEMA)
    out: dict[int, Moments] = {}
    for r in sorted(parts.collect(), key=lambda r: (r["fold"], r["n"], r["mean"])):  # some matrices per fold
        out[r["fold"]] = Moments(r["n"], np.array(r["mean"]), np.array(r["cross"]).reshape(k, k)) + out.get(r["fold"])
    return out


def lasso_fit(moments: Moments, penalty: float, start: np.ndarray | None = None, rounds: int = 10_000, tol: float = 1e-12) -> np.ndarray:
    """Coefficients of the L1 least-squares fit of the last column on the others, by coordinate descent.

    The loss is half the mean squared error plus ``penalty`` times the sum of the absolute coefficients of the
    columns in units of their deviation; columns that do not vary have none.
    """
    c = moments.cross / moments.n
    k = len(c) - 1
    dev = np.sqrt(np.diag(c) * moments.n / max(moments.n - 1, 1))
    live = [j for j in range(k) if dev[j] > 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.nan_to_num(c[:k, :k] / np.outer(dev[:k], dev[:k]), posinf=0.0, neginf=0.0)
        b = np.nan_to_num(c[:k, k] / dev[:k], posinf=0.0, neginf=0.0)
    w = np.zeros(k) if start is None else start * dev[:k]
    scale = max(dev[k], 1e-300)
    for _ in range(rounds):
        most = 0.0
        for j in live:
            rest = b[j] - g[j] @ w + g[j, j] * w[j]
            new = math.copysign(max(abs(rest) - penalty, 0.0), rest) / g[j, j]
            most = max(most, abs(new - w[j]))
            w[j] = new
        if most <= tol * scale:
            break
    out = np.zeros(k)
    out[live] = w[live] / dev[live]
    return out


def held_error(fitted: Moments, held: Moments, coefficients: np.ndarray) -> float:
    """Mean squared error on ``held`` of the fit, with the intercept that ``fitted`` gives."""
    v = np.append(-coefficients, 1.0)  # residual = v . (x, y) - intercept
    return float(v @ held.cross @ v) / held.n + float(v @ (held.mean - fitted.mean)) ** 2


def lasso_path(df: DataFrame, columns: Sequence[str], label: str, penalties: Sequence[float], fold: Column) -> tuple[np.ndarray, float, dict[float, float]]:
    """(coefficients, penalty, mean held-out error by penalty): the penalty of the least error, fitted on all rows."""
    folds = fold_moments(df.where(as_col(label).isNotNull()), [*columns, label], fold)
    total: Moments | None = None
    for f in sorted(folds):
        total = folds[f] + total
    errors = {float(p): 0.0 for p in penalties}
    if total is None:
        return np.zeros(len(columns)), float(min(penalties)), errors
    for f in sorted(folds):
        rest: Moments | None = None
        for other in sorted(folds):
            if other != f:
                rest = folds[other] + rest
        if rest is None:
            continue
        w = None
        for p in sorted(errors, reverse=True):  # each fit starts from the one before
            w = lasso_fit(rest, p, w)
            errors[p] += held_error(rest, folds[f], w) / len(folds)
    best = min(sorted(errors, reverse=True), key=errors.get)  # ties: the larger penalty
    return lasso_fit(total, best), best, errors
