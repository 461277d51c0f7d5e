"""Outlier screens by quartile fences and the study of negative values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import as_col
from .profile import class_ratio, numeric_columns, quartiles, to_long, two_value_columns, single_value_columns


@dataclass(frozen=True)
class Fence:
    low: float
    high: float


def quartile_fences(df: DataFrame, columns: Sequence[str], reach: float = 1.5) -> dict[str, Fence]:
    """``Q1 - reach*IQR .. Q3 + reach*IQR`` per column; columns without spread are left out."""
    out = {}
    for r in quartiles(df, columns).collect():  # one row per column
        spread = abs(r["q75"] - r["q25"])
        if spread:
            out[r["column"]] = Fence(r["q25"] - reach * spread, r["q75"] + reach * spread)
    return {c: out[c] for c in columns if c in out}


def screened_columns(df: DataFrame, skip: Sequence[str] = ("TARGET",)) -> list[str]:
    """Numeric columns worth a fence: over two distinct values and not all inside [0, 1]."""
    columns = numeric_columns(df, skip)
    small = set(two_value_columns(df, [c for c in df.columns if c not in columns]))
    small |= set(single_value_columns(df, [c for c in df.columns if c not in columns]))
    outside = df.agg(
        *[F.count_if(~as_col(c).between(0, 1)).alias(str(i)) for i, c in enumerate(columns)]
    ).collect()[0]
    return [c for i, c in enumerate(columns) if c not in small and outside[str(i)]]


def outlier_report(
    df: DataFrame, columns: Sequence[str] | None = None, reach: float = 1.5, null_is_outlier: bool = False
) -> DataFrame:
    """(column, low, high, outliers) for columns with values outside their fences."""
    columns = list(columns or screened_columns(df))
    fences = quartile_fences(df, columns, reach)
    names = list(fences)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, low double, high double, outliers bigint")
    exprs = []
    for i, c in enumerate(names):
        inside = as_col(c).between(fences[c].low, fences[c].high)
        bad = ~F.coalesce(inside, F.lit(not null_is_outlier))
        exprs += [
            F.lit(fences[c].low).alias(f"{i}_low"),
            F.lit(fences[c].high).alias(f"{i}_high"),
            F.count_if(bad).alias(f"{i}_outliers"),
        ]
    return to_long(df.agg(*exprs), names, ["low", "high", "outliers"]).where(F.col("outliers") > 0)


def extreme_values(
    df: DataFrame, columns: Sequence[str], reach: float = 1.5, day_prefix: str = "DAYS", max_years: float = 100
) -> DataFrame:
    """(column, side, value): the highest value on or above and the lowest on or below the fences.

    Day offsets are listed only when one of the two is over ``max_years`` years.
    """
    fences = quartile_fences(df, columns, reach)
    names = list(fences)
    schema = "column string, side string, value double"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    exprs = []
    for i, c in enumerate(names):
        x = as_col(c).cast("double")
        exprs += [
            F.max(F.when(x >= fences[c].high, x)).alias(f"{i}_max"),
            F.min(F.when(x <= fences[c].low, x)).alias(f"{i}_min"),
        ]
    row = df.agg(*exprs).collect()[0]
    out = []
    for i, c in enumerate(names):
        ends = {"max": row[f"{i}_max"], "min": row[f"{i}_min"]}
        if c.startswith(day_prefix) and not any(v is not None and abs(v / 365) > max_years for v in ends.values()):
            continue
        out += [(c, side, float(v)) for side, v in ends.items() if v is not None]
    return df.sparkSession.createDataFrame(out, schema)  # two rows per column at most


def rows_at_extremes(df: DataFrame, column: str, extremes: DataFrame) -> DataFrame:
    """Rows that hold an extreme value of ``column``, tagged with the side."""
    table = extremes.where(F.col("column") == column).select("side", F.col("value").alias("__v"))
    return df.join(F.broadcast(table), as_col(column).cast("double") == F.col("__v"), "inner").drop("__v")


def parents_of(rows: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Parent rows that own at least one of ``rows``."""
    return parent.join(rows.select(key).distinct(), key, "left_semi")


def log_of_negatives(child: DataFrame, column: str, parent: DataFrame, key: str, label: str) -> DataFrame:
    """Negative values as ``ln(-x)`` next to the parent's label; clashing names get ``_r``."""
    negative = child.where(as_col(column) < 0).select(key, F.ln(-as_col(column)).alias(column))
    right = parent.select(F.col(key), F.col(label), F.col(key).alias(f"{key}_r"))
    return negative.join(right, key, "left").withColumnRenamed(key, f"{key}_l")


def negative_flag_rate(child: DataFrame, column: str, parent: DataFrame, key: str, label: str) -> DataFrame:
    """Class ratio of parents that own a negative ``column``: right join, drop nulls, distinct rows."""
    negative = child.where(as_col(column) < 0).select(key, column)
    joined = negative.join(parent.select(key, label), key, "right").na.drop().dropDuplicates()
    return class_ratio(joined, label)
