"""Embedding whitening: leading eigenpairs of the covariance by spectrum slicing.

Entries become whole numbers, so that sums and products over all rows are exact and no task order
can change them: one pass gives the sums, a second the products of entries centred at the whole number
next to the mean; what is left of the centring is taken off exactly afterwards.  Products meet by
(row, column) of the covariance, a few thousand keys, and only that matrix reaches the driver.

There the spectrum is sliced.  An LDL' factorisation of the covariance less a shift has as many
positive pivots as there are eigenvalues above the shift.  Bisection on these counts isolates each
leading eigenvalue, Rayleigh quotient iteration takes it to double precision, and counts on
both sides of the result certify its number.  Eigenvalues that agree to rounding are taken together.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of
from .vectors import main_dimension, matrix, usable

SCALE, SHIFT = 64, 1_000_000  # fixed values: x = floor(64 * c) + 1000000
LARGEST = float(1 << 56)  # 64 * c + 1000000 fits a long below this
COMPONENTS = 32
ROWS = 4096
PART = 10**18  # product sums travel as two decimals, so that none overflows
DIGITS = 22  # decimals of the sums of whitened products


# --- spectrum slicing of one symmetric matrix ---------------------------------------------------------


def count_above(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of symmetric ``a`` above ``shift``: the positive inertia of LDL' with 1x1 and 2x2 pivots."""
    m = a - shift * np.eye(len(a))
    n, k, above = len(m), 0, 0
    edge = (1 + math.sqrt(17)) / 8

    def swap(i: int, j: int) -> None:
        m[[i, j], :] = m[[j, i], :]
        m[:, [i, j]] = m[:, [j, i]]

    while k < n:
        own, two = abs(m[k, k]), False
        column = np.abs(m[k + 1 :, k])
        most = column.max() if len(column) else 0.0
        if own == 0 and most == 0:  # an eigenvalue at the shift
            k += 1
            continue
        if own < edge * most:
            r = k + 1 + int(column.argmax())
            row = np.abs(m[r, k:])
            row[r - k] = 0
            other = row.max()
            if own * other < edge * most * most:
                if abs(m[r, r]) >= edge * other:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    two = True
        if two:  # such a pivot has one eigenvalue of each sign
            pivot, below = m[k : k + 2, k : k + 2], m[k + 2 :, k : k + 2].copy()
            m[k + 2 :, k + 2 :] -= below @ np.linalg.solve(pivot, below.T)
            above += 1
            k += 2
        else:
            below = m[k + 1 :, k].copy()
            m[k + 1 :, k + 1 :] -= np.outer(below / m[k, k], below)
            above += m[k, k] > 0
            k += 1
    return int(above)


def _solve(a: np.ndarray, shift: float, x: np.ndarray, scale: float) -> np.ndarray:
    eye = np.eye(len(a))
    try:
        return np.linalg.solve(a - shift * eye, x)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        return np.linalg.solve(a - (shift + 4 * np.finfo(float).eps * scale) * eye, x)


def leading_eigenpairs(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as rows) of at most ``most`` leading eigenpairs of a covariance.

    Eigenvalues that rounding cannot tell from zero are left out.  The sign of a vector makes its
    largest entry positive.
    """
    d = len(a)
    scale = float(np.linalg.norm(a)) if d else 0.0
    if scale == 0:
        return np.empty(0), np.empty((0, d))
    tiny = 16 * d * np.finfo(float).eps * scale
    counts = {scale * (1 + 1e-6) + tiny: 0}
    seen = count_above(a, tiny)
    counts[tiny] = seen
    want = min(most, seen)
    random = np.random.default_rng(12)
    values, vectors = [], np.empty((0, d))

    def at(shift: float) -> int:
        if shift not in counts:
            counts[shift] = count_above(a, shift)
        return counts[shift]

    def free(x: np.ndarray) -> np.ndarray:
        """``x`` as orthonormal columns, orthogonal to the vectors found."""
        for _ in range(2):
            x = x - vectors.T @ (vectors @ x)
        return np.linalg.qr(x)[0]

    def iterate(low: float, high: float) -> tuple[float, np.ndarray] | None:
        """Rayleigh quotient iteration for the one eigenvalue inside, None where it ends elsewhere."""
        x = random.standard_normal(d)
        rho = (low + high) / 2
        for _ in range(2):
            x = _solve(a, rho, x, scale)
            x /= np.linalg.norm(x)
        best = math.inf
        for _ in range(12):
            rho = float(x @ a @ x)
            left = float(np.linalg.norm(a @ x - rho * x))
            if left >= best / 2 or left == 0:
                break
            best = left
            x = _solve(a, rho, x, scale)
            x /= np.linalg.norm(x)
        return (rho, x) if low < rho < high and left <= tiny else None

    while len(values) < want:
        j = len(values) + 1  # the eigenvalue's number
        low = max(s for s, c in counts.items() if c >= j)
        high = min(s for s, c in counts.items() if c < j)
        while True:
            middle = (low + high) / 2
            inside = at(low) - at(high)
            if inside == 1:
                found = iterate(low, high)
                if found:
                    rho, x = found
                    delta = min(tiny, (high - rho) / 2, (rho - low) / 2) or tiny
                    if at(rho + delta) == j - 1 and at(rho - delta) == j:  # certified
                        values.append(rho)
                        vectors = np.vstack([vectors, free(x[:, None]).T])
                        break
            if high - low <= 2 * tiny or middle in (low, high):  # a cluster that rounding cannot part
                x = random.standard_normal((d, inside))
                for _ in range(4):
                    x = free(_solve(a, middle + tiny / 3, x, scale))
                own, turn = np.linalg.eigh(x.T @ a @ x)
                values.extend(own[::-1])
                vectors = np.vstack([vectors, (x @ turn)[:, ::-1].T])
                break
            if at(middle) >= j:
                low = middle
            else:
                high = middle
    values, vectors = np.array(values[:want]), vectors[:want]
    signs = np.sign(vectors[np.arange(want), np.abs(vectors).argmax(axis=1)])
    return values, vectors * signs[:, None]


# --- the Spark job -------------------------------------------------------------------------------------


def whole(c: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def _sums(rows: DataFrame, d: int) -> list[int]:
    """Exact sum of each entry."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in rows_of(batches, ROWS):
            x = whole(matrix(batch.column(0), d))
            if np.abs(x).max(initial=0) < 1 << 50:
                total = [t + int(s) for t, s in zip(total, x.sum(axis=0))]
            else:
                total = [t + sum(map(int, column)) for t, column in zip(total, x.T)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "s"]
        )

    made = rows.select("vector").mapInArrow(run, "i int, s decimal(38,0)")
    found = {r["i"]: int(r["s"]) for r in made.groupBy("i").agg(F.sum("s").alias("s")).collect()}  # d rows
    return [found[i] for i in range(d)]


def _products(rows: DataFrame, d: int, centre: list[int]) -> list[list[int]]:
    """Exact sums of products of entries less ``centre``."""
    off = np.array(centre, np.int64)
    up = np.triu_indices(d)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(up[0]), object)
        for batch in rows_of(batches, ROWS):
            z = whole(matrix(batch.column(0), d)) - off
            far = int(np.abs(z).max(initial=0))
            if far * far * max(len(z), 1) < 1 << 53:  # then products of doubles are exact
                f = z.astype(float)
                made = (f.T @ f).astype(np.int64).astype(object)
            else:
                o = z.astype(object)
                made = o.T @ o
            total = total + made[up]
        high, low = zip(*[divmod(int(t), PART) for t in total])
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(up[0], pa.int32()), pa.array(up[1], pa.int32()),
                pa.array([Decimal(v) for v in high], kind), pa.array([Decimal(v) for v in low], kind),
            ],
            names=["i", "j", "high", "low"],
        )

    made = rows.select("vector").mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    out = [[0] * d for _ in range(d)]
    for r in made.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():  # d * d rows
        out[r["i"]][r["j"]] = out[r["j"]][r["i"]] = int(r["high"]) * PART + int(r["low"])
    return out


@dataclass(frozen=True)
class Whitening:
    """A fitted map: number of rows, sums, eigenvalues, unit eigenvectors (rows), trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """``x - S/n``, rounded once, and the exact sum of ``(n * x - S)**2`` per row (None beyond a long)."""
        far = max(int(np.abs(x).max(initial=0)), max(map(abs, self.sums), default=0) // self.n + 1)
        small = (2 * self.n * far) ** 2 * max(len(self.sums), 1) < 1 << 63
        y = self.n * (x if small else x.astype(object)) - np.array(self.sums, np.int64 if small else object)
        squares = (y * y).sum(axis=1)
        if small:
            return y / self.n, squares.tolist()
        return (y / self.n).astype(float), [int(s) if s < 1 << 63 else None for s in squares]


def _fit_rows(embeddings: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    rows = usable(embeddings, id_col, vector_col).where(F.forall("vector", lambda c: F.abs(c) < LARGEST))
    d, n = main_dimension(rows)
    return rows.where(F.size("vector") == d), d, n


def _fit(rows: DataFrame, d: int, n: int, components: int) -> Whitening:
    sums = _sums(rows, d)
    centre = [(2 * s + n) // (2 * n) for s in sums]  # the whole number next to the mean
    left = [s - n * c for s, c in zip(sums, centre)]
    products = _products(rows, d, centre)
    cov = np.array([[(n * products[i][j] - left[i] * left[j]) / (n * n) for j in range(d)] for i in range(d)])
    return Whitening(n, tuple(sums), *leading_eigenpairs(cov, components), float(np.trace(cov)))


def fit_whitening(
    embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> Whitening | None:
    """Mean, leading eigenvalues and eigenvectors over all usable rows; None without rows."""
    rows, d, n = _fit_rows(embeddings, id_col, vector_col)
    return _fit(rows, d, n, components) if n else None


SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whiten(
    embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error per usable row and component.

    Rows without a vector, with an empty one or with missing, non-finite or huge entries (2^56 and more) are
    dropped; so are vectors of another length than most have (of equally frequent lengths the
    longer counts).  Repeated rows and rows without an id count and come out as they went in; other columns
    are ignored.  Directions without variance have no component, so that equal rows alone, a single row or
    an empty table give no rows.  A deviation beyond a long is NULL.  The matrix of the covariance is on
    the driver, so the dimension must be some hundreds or thousands.
    """
    rows, d, n = _fit_rows(embeddings, id_col, vector_col)
    spark = embeddings.sparkSession
    fitted = _fit(rows, d, n, components) if n else None
    if fitted is None or not len(fitted.values):
        return spark.range(0).selectExpr(*[f"CAST(NULL AS {kind}) AS {name}" for name, kind in map(str.split, SCHEMA.split(", "))])
    held = spark.sparkContext.broadcast(fitted)
    k = len(fitted.values)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Whitening = held.value
        onto = (f.vectors / np.sqrt(f.values)[:, None]).T.copy()
        for batch in rows_of(batches, ROWS):
            y, deviation = f.centred(whole(matrix(batch.column(1), d)))
            ends = pa.array(np.arange(0, (len(y) + 1) * k, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(deviation, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array((y @ onto).ravel())),
                ],
                names=["vec_id", "deviation", "w"],
            )

    made = materialize(rows.mapInArrow(project, "vec_id long, deviation long, w array<double>"), "whitened")
    error = identity_error(made, n, k)
    explained = F.element_at(F.lit([float(e) / fitted.trace for e in fitted.values]), F.col("at") + 1)
    return made.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(error).alias("identity_error"),
    )


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of the column ``w`` minus the identity, measured over all rows."""
    up = np.triu_indices(k)
    unit = Decimal(1).scaleb(-DIGITS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((k, k)), np.zeros(k)
        for batch in rows_of(batches, ROWS):
            w = matrix(batch.column(0), k)
            total, sums = total + w.T @ w, sums + w.sum(axis=0)
        made = [*zip(*up, total[up]), *[(i, -1, s) for i, s in enumerate(sums)]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in made], pa.int32()), pa.array([r[1] for r in made], pa.int32()),
                pa.array([Decimal(float(r[2])).quantize(unit) for r in made], pa.decimal128(38, DIGITS)),
            ],
            names=["i", "j", "s"],
        )

    made = whitened.select("w").mapInArrow(run, f"i int, j int, s decimal(38,{DIGITS})")
    found = {(r["i"], r["j"]): float(r["s"]) for r in made.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}  # k * k rows
    mean = [found[i, -1] / n for i in range(k)]
    return max(abs(found[i, j] / n - mean[i] * mean[j] - (i == j)) for i, j in zip(*map(np.ndarray.tolist, up)))
