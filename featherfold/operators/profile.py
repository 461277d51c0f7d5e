"""Column profiles: null ratios, distinct counts of small kinds, describe, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.scalar import as_col
from ..session import shared_dir, wide_code
from .selection import select_quantiles


COLUMNS_PER_PASS = 150


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]


def text_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and c not in skip]


def to_long(row: DataFrame, columns: Sequence[str], fields: Sequence[str], id_name: str = "column") -> DataFrame:
    """Turn one wide row of ``<i>_<field>`` aggregates into a row per column."""
    items = [
        F.struct(F.lit(c).alias(id_name), *[F.col(f"`{i}_{f}`").alias(f) for f in fields])
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*items)))


def null_ratios(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, null_ratio) from one aggregate over all columns."""
    columns = list(columns or df.columns)
    total = F.count(F.lit(1))
    exprs = [
        (F.try_divide((total - F.count(as_col(c))).cast("double"), total.cast("double"))).alias(f"{i}_null_ratio")
        for i, c in enumerate(columns)
    ]
    return to_long(df.agg(*exprs), columns, ["null_ratio"])


def mostly_null_columns(df: DataFrame, limit: float, keep: Sequence[str] = ()) -> list[str]:
    """Names of columns whose null ratio is above ``limit``; a handful of strings."""
    ratios = null_ratios(df, [c for c in df.columns if c not in keep])
    return [r["column"] for r in ratios.where(F.col("null_ratio") > limit).collect()]


def _ends(df: DataFrame, columns: Sequence[str]) -> dict:
    """Row count, and smallest and largest value and null count of every column.

    Very wide frames are read in groups of columns: a columnar scan then reads each
    column once all the same, and the generated code stays small.
    """
    out: dict = {"rows": 0}
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        total = F.count(F.lit(1))
        exprs = [total.alias("rows")]
        for i, c in enumerate(columns[start:start + COLUMNS_PER_PASS], start):
            exprs += [
                F.min(as_col(c)).alias(f"{i}_lo"),
                F.max(as_col(c)).alias(f"{i}_hi"),
                (total - F.count(as_col(c))).alias(f"{i}_nulls"),
            ]
        out |= df.agg(*exprs).collect()[0].asDict()
    return out


def _is_single(row: dict, i: int) -> bool:
    lo, hi, nulls = row[f"{i}_lo"], row[f"{i}_hi"], row[f"{i}_nulls"]
    return lo is None or (lo == hi and nulls == 0)


def single_value_columns(df: DataFrame, keep: Sequence[str] = ()) -> list[str]:
    """Columns with at most one distinct value, a missing value counting as one."""
    columns = [c for c in df.columns if c not in keep]
    row = _ends(df, columns)
    return [c for i, c in enumerate(columns) if _is_single(row, i)]


def useless_columns(df: DataFrame, limit: float = 0.97, keep: Sequence[str] = ()) -> list[str]:
    """Mostly-null and single-valued columns in one profiling pass; apply the list to every split."""
    columns = [c for c in df.columns if c not in keep]
    row = _ends(df, columns)
    if not row["rows"]:
        return []
    return [c for i, c in enumerate(columns) if row[f"{i}_nulls"] / row["rows"] > limit or _is_single(row, i)]


class Profiled:
    """A frame that is stored once, with the states of its columns.

    The states (values, smallest, largest, over the rows where ``where`` holds) add up over frames that are joined
    later: a row that a frame has no match for counts as one missing value in all its columns.  So the useless
    columns of a wide frame are known before it is put together, and the joins read the others alone.
    """

    def __init__(self, frame: DataFrame, name: str, where: Column | None = None, skip: Sequence[str] = ()):
        self.columns = [c for c in frame.columns if c not in skip]
        path = shared_dir(frame.sparkSession, name)
        with wide_code(frame.sparkSession):
            frame.write.parquet(path)
        self.frame = frame.sparkSession.read.schema(frame.schema).parquet(path)
        seen = self.frame if where is None else self.frame.where(where)
        self.states: dict = {"rows": 0}
        for start in range(0, max(len(self.columns), 1), COLUMNS_PER_PASS):  # a columnar scan reads each column once
            exprs = [F.count(F.lit(1)).alias("rows")]
            for i, c in enumerate(self.columns[start : start + COLUMNS_PER_PASS], start):
                x = as_col(c)
                exprs += [F.count(x).alias(f"{i}_n"), F.min(x).alias(f"{i}_lo"), F.max(x).alias(f"{i}_hi")]
            self.states |= seen.agg(*exprs).first().asDict()
        self.rows = self.states["rows"]

    def useless(self, rows: int, limit: float = 0.97) -> list[str]:
        """Mostly-null and single-valued columns, once the frame is left-joined to a table of ``rows`` rows."""
        out = []
        for i, c in enumerate(self.columns):
            nulls = rows - self.states[f"{i}_n"]
            lo, hi = self.states[f"{i}_lo"], self.states[f"{i}_hi"]
            if rows and (nulls / rows > limit or lo is None or (lo == hi and not nulls)):
                out.append(c)
        return out


def two_value_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """Columns with exactly two distinct values, a missing value counting as one.

    Two narrow passes (extremes, then "anything in between?") instead of one
    distinct count per column, which would copy each row once per column.
    """
    columns = [c for c in df.columns if c not in skip]
    row = _ends(df, columns)
    maybe, out = [], []
    for i, c in enumerate(columns):
        lo, hi, nulls = row[f"{i}_lo"], row[f"{i}_hi"], row[f"{i}_nulls"]
        if lo is None:
            continue
        if lo == hi:
            if nulls:
                out.append(c)
        elif not nulls:
            maybe.append((c, lo, hi))
    if maybe:
        between = df.agg(
            *[F.count_if((as_col(c) != F.lit(lo)) & (as_col(c) != F.lit(hi))).alias(str(i))
              for i, (c, lo, hi) in enumerate(maybe)]
        ).collect()[0]
        out += [c for i, (c, _, _) in enumerate(maybe) if between[str(i)] == 0]
    return [c for c in columns if c in out]


def melt(df: DataFrame, columns: Sequence[str], id_cols: Sequence[str] = ()) -> DataFrame:
    """(id_cols..., column, value) with values as double."""
    items = [F.struct(F.lit(c).alias("column"), as_col(c).cast("double").alias("value")) for c in columns]
    return df.select(*id_cols, F.inline(F.array(*items)))


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def quartiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, q25, q50, q75), exact and interpolated."""
    return select_quantiles(df, [], columns, QUARTILES)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) per numeric column."""
    columns = list(columns)
    exprs = []
    for i, c in enumerate(columns):
        x = as_col(c).cast("double")
        exprs += [
            F.count(x).alias(f"{i}_count"),
            F.avg(x).alias(f"{i}_mean"),
            F.stddev_samp(x).alias(f"{i}_std"),
            F.min(x).alias(f"{i}_min"),
            F.max(x).alias(f"{i}_max"),
        ]
    base = to_long(df.agg(*exprs), columns, ["count", "mean", "std", "min", "max"])
    out = base.join(quartiles(df, columns), "column", "left")
    return out.select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(as_col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def class_ratio(df: DataFrame, label: str, name: str = "ratio") -> DataFrame:
    """Rows of class 1 per row of class 0."""
    ones, zeros = F.count_if(as_col(label) == 1), F.count_if(as_col(label) == 0)
    return df.agg(F.try_divide(ones.cast("double"), zeros.cast("double")).alias(name))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bucket, low, high, count): equal-width buckets, the last one closed; empty ones kept."""
    x = as_col(column).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).collect()[0]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bucket int, low double, high double, count bigint")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    bucket = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = [F.count_if(bucket == b).alias(f"{b}_count") for b in range(bins)]
    items = [
        F.struct(
            F.lit(b).alias("bucket"),
            F.lit(lo + b * width).alias("low"),
            F.lit(lo + (b + 1) * width).alias("high"),
            F.col(f"{b}_count").alias("count"),
        )
        for b in range(bins)
    ]
    return df.agg(*counts).select(F.inline(F.array(*items)))
