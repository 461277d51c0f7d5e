"""Vector columns: which rows take part, their dimension, their batches as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector that is there, not empty, and holds numbers only."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & whole, F.lit(False))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, vector array<double>) of the rows whose vector is finite and not empty."""
    vector = F.col(vector_col).cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where(finite(F.col("vector")))


def main_dimension(vectors: DataFrame) -> tuple[int, int]:
    """(length that most vectors have, their number); of equally frequent lengths the longer; (0, 0) without rows."""
    found = vectors.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    best = found.agg(F.max(F.struct("n", "d")).alias("best")).first()["best"]
    return (best["d"], best["n"]) if best else (0, 0)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a batch as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
