"""Distribution of a feature by class: medians, correlation, kernel density."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import as_col
from .ordered import quantiles_per_group
from .screen import correlation


def class_medians(df: DataFrame, column: str, label: str) -> DataFrame:
    """One row: correlation with the label and the median of each class."""
    med = quantiles_per_group(df.where(as_col(label).isNotNull()), [label], column, {"m": 0.5})
    missing = F.lit(None).cast("double")
    corr = df.agg(correlation(as_col(column).cast("double"), as_col(label).cast("double")).alias("corr"))
    # one row and one row per class: stacked, then folded into a single row
    stacked = corr.select(F.lit(None).cast("int").alias("y"), "corr", missing.alias("m")).unionByName(
        med.select(as_col(label).cast("int").alias("y"), missing.alias("corr"), "m")
    )
    return stacked.agg(
        F.max("corr").alias("corr"),
        F.max(F.when(F.col("y") == 0, F.col("m"))).alias("median_0"),
        F.max(F.when(F.col("y") == 1, F.col("m"))).alias("median_1"),
    )


def class_density(df: DataFrame, column: str, label: str, points: int = 100, reach: float = 3.0) -> DataFrame:
    """(label, point, x, density): Gaussian kernel density of classes 0 and 1 on an even grid.

    Bandwidth by Scott's rule.  Every grid point is one sum in a single aggregate, so
    rows are neither multiplied nor collected.
    """
    rows = df.select(as_col(label).alias(label), as_col(column).cast("double").alias("__x"))
    rows = rows.where(F.col(label).isin(0, 1) & F.col("__x").isNotNull())
    x = F.col("__x")
    stats = rows.groupBy(label).agg(
        F.count(x).alias("__n"), F.stddev_samp(x).alias("__s"), F.min(x).alias("__lo"), F.max(x).alias("__hi")
    )
    stats = stats.withColumn("__h", F.col("__s") * F.pow(F.col("__n").cast("double"), F.lit(-0.2)))
    stats = stats.where(F.col("__h") > 0).select(
        label, "__n", "__h",
        (F.col("__lo") - reach * F.col("__h")).alias("__from"),
        ((F.col("__hi") - F.col("__lo") + 2 * reach * F.col("__h")) / (points - 1)).alias("__step"),
    )
    placed = rows.join(F.broadcast(stats), label, "inner")  # two rows
    sums = []
    for i in range(points):
        z = (F.col("__from") + F.col("__step") * F.lit(float(i)) - x) / F.col("__h")
        sums.append(F.sum(F.exp(-0.5 * z * z)).alias(f"__d{i}"))
    keep = [F.first(c).alias(c) for c in ("__n", "__h", "__from", "__step")]
    wide = placed.groupBy(label).agg(*keep, *sums)
    scale = F.col("__n") * F.col("__h") * F.sqrt(F.lit(2.0) * F.pi())
    items = [
        F.struct(
            F.lit(i).alias("point"),
            (F.col("__from") + F.col("__step") * F.lit(float(i))).alias("x"),
            (F.col(f"__d{i}") / scale).alias("density"),
        )
        for i in range(points)
    ]
    return wide.select(label, F.inline(F.array(*items)))
