"""Cleaning and encoding: fills, recodes, label and one-hot encoding, types, alignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from ..functions.scalar import abs_cap_to_null, as_col, cap_to_null, infinity_to, sentinel_to_null
from .profile import text_columns


def sentinels_to_null(df: DataFrame, columns: Sequence[str], sentinel: float) -> DataFrame:
    return df.withColumns({c: sentinel_to_null(c, sentinel) for c in columns})


def caps_to_null(df: DataFrame, caps: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values outside ``{column: (low, high)}`` become NULL; None leaves a side open."""
    return df.withColumns({c: cap_to_null(c, lo, hi) for c, (lo, hi) in caps.items()})


def abs_caps_to_null(df: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: abs_cap_to_null(c, lim) for c, lim in limits.items()})


def fill_missing(df: DataFrame, value: float | str, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(value, list(columns) if columns else None)


def replace_infinity(df: DataFrame, value: float, columns: Sequence[str] | None = None) -> DataFrame:
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: infinity_to(c, value) for c in names})


def recode_flags(df: DataFrame, columns: Sequence[str], true: int = 1, false: int = 0) -> DataFrame:
    """Booleans or 0/1 columns to two chosen numbers; missing stays missing."""
    out = {}
    for c in columns:
        yes = as_col(c).cast("boolean")
        out[c] = F.when(yes, F.lit(true)).when(~yes, F.lit(false))
    return df.withColumns(out)


@dataclass(frozen=True)
class LabelEncoder:
    """Sorted class -> position, learnt on one frame and applied to others."""

    classes: Mapping[str, Sequence[str]]

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str] | None = None, max_classes: int = 2) -> "LabelEncoder":
        """Text columns with at most ``max_classes`` distinct values (a missing value counts)."""
        found = distinct_texts(df, columns or text_columns(df), max_classes + 1)
        return LabelEncoder({c: [v for v in vs if v is not None] for c, vs in found.items() if len(vs) <= max_classes})

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, values in self.classes.items():
            code = F.when(F.lit(False), F.lit(0))
            for i, v in enumerate(values):
                code = code.when(as_col(c) == v, F.lit(i))
            out[c] = code
        return df.withColumns(out)


#: Values of a column, each a column of the result, that are fetched unless the caller asks for them whole.
MOST_VALUES = 10_000


@dataclass(frozen=True)
class OneHotEncoder:
    """Text value -> 0/1 column named ``<column>_<value>``; missing gives all zeros."""

    values: Mapping[str, Sequence[str]]

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str] | None = None, max_values: int | None = MOST_VALUES) -> "OneHotEncoder":
        """All values of each column.  Columns with more than ``max_values`` are an error that names them, found by a
        sketch in Spark before values move; None asks for all values of any column on the driver.
        """
        names = columns or text_columns(df)
        found = distinct_texts(df, names, None if max_values is None else max_values + 1)
        wide = [c for c, vs in found.items() if max_values is not None and len(vs) > max_values]
        if wide:
            raise ValueError(f"more than {max_values} distinct values in {wide}")
        return OneHotEncoder({c: [v for v in vs if v is not None] for c, vs in found.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        flags = {
            f"{c}_{v}": F.coalesce(as_col(c) == v, F.lit(False)).cast("int")
            for c, values in self.values.items()
            for v in values
        }
        return df.withColumns(flags).drop(*self.values)


def distinct_texts(df: DataFrame, columns: Sequence[str], most: int | None) -> dict[str, list[str | None]]:
    """Sorted distinct values per column; with ``most``, a column with more gives ``most + 1`` times None.

    One aggregate over the rows gives a sketch of every column's distinct values, which combines
    map-side to a few kilobytes.  Only columns whose sketch is not far over ``most`` (twice, at an error
    of 2 %) are then counted and gathered exactly, so values of wide columns never move.
    """
    if not columns:
        return {}
    names = list(dict.fromkeys(columns))
    if most is not None:
        near = df.agg(*[F.approx_count_distinct(as_col(c), 0.02).alias(str(i)) for i, c in enumerate(names)]).first()
        names = [c for i, c in enumerate(names) if near[i] <= 2 * most]
    out: dict[str, list[str | None]] = {c: [] for c in columns if c in names or most is None}
    if names:
        items = [F.struct(F.lit(c).alias("column"), as_col(c).alias("value")) for c in names]
        pairs = df.select(F.inline(F.array(*items))).distinct()
        for r in pairs.collect():  # at most about 2 * most values of a column, or what the caller asked to have whole
            out[r["column"]].append(r["value"])
    full = lambda c: c not in out or (most is not None and len(out[c]) > most)
    return {c: [None] * (most + 1) if full(c) else sorted(out[c], key=lambda v: (v is None, v)) for c in columns}


def zero_one_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns without missing values that hold 0 and 1 and nothing else."""
    exprs = []
    for i, c in enumerate(columns):
        x = as_col(c)
        exprs += [
            F.count_if(x.isNull() | ~x.isin(0, 1)).alias(f"{i}_other"),
            F.count_if(x == 0).alias(f"{i}_zero"),
            F.count_if(x == 1).alias(f"{i}_one"),
        ]
    row = df.agg(*exprs).collect()[0]
    return [c for i, c in enumerate(columns) if not row[f"{i}_other"] and row[f"{i}_zero"] and row[f"{i}_one"]]


def normalise_types(df: DataFrame, id_columns: Sequence[str], flags: Sequence[str] | None = None) -> DataFrame:
    """Ids to long (missing -> 0), 0/1 columns to boolean, doubles to float."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in id_columns]
    flags = zero_one_columns(df, numbers) if flags is None else flags
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in id_columns:
            c = F.coalesce(c.cast("long"), F.lit(0).cast("long"))
        elif f.name in flags:
            c = c.cast("boolean")
        elif isinstance(f.dataType, DoubleType):
            c = c.cast("float")
        out.append(c.alias(f.name))
    return df.select(*out)


def align_columns(train: DataFrame, other: DataFrame, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Keep the columns both frames have, in the order of the first; the label stays on it."""
    common = [c for c in train.columns if c in set(other.columns)]
    extra = [label] if label and label in train.columns and label not in common else []
    return train.select(*[F.col(f"`{c}`") for c in common + extra]), other.select(*[F.col(f"`{c}`") for c in common])


def columns_like(df: DataFrame, contains: str = "", starts: str = "", without: Sequence[str] = ()) -> list[str]:
    """Column names by pattern."""
    return [
        c for c in df.columns if contains in c and c.startswith(starts) and not any(w in c for w in without)
    ]


@dataclass(frozen=True)
class Standardizer:
    """z-scores by the mean and sample deviation of the frame it was fitted on; missing -> 0."""

    stats: Mapping[str, tuple[float | None, float | None]]

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str]) -> "Standardizer":
        exprs = []
        for i, c in enumerate(columns):
            exprs += [F.avg(as_col(c)).alias(f"{i}_m"), F.stddev_samp(as_col(c)).alias(f"{i}_s")]
        row = df.agg(*exprs).collect()[0]
        return Standardizer({c: (row[f"{i}_m"], row[f"{i}_s"]) for i, c in enumerate(columns)})

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (mean, std) in self.stats.items():
            if mean is None or not std:
                out[c] = F.lit(0.0)
            else:
                out[c] = F.coalesce((as_col(c) - F.lit(mean)) / F.lit(std), F.lit(0.0))
        return df.withColumns(out)


def date_columns(df: DataFrame, anchor: str = "2016-01-01", calendar_months: bool = False) -> DataFrame:
    """Turn ``DAYS_*`` into ``TSD_*`` dates and ``MONTHS_*`` into ``TSM_*`` timestamps."""
    from ..functions.scalar import day_to_date, month_to_timestamp

    out = []
    for c in df.columns:
        if c.startswith("DAYS_"):
            out.append(day_to_date(c, anchor).alias(c.replace("DAYS_", "TSD_", 1)))
        elif c.startswith("MONTHS_"):
            out.append(month_to_timestamp(c, anchor, calendar_months).alias(c.replace("MONTHS_", "TSM_", 1)))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)
