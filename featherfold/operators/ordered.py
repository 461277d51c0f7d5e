"""Ordered operators that hold up when one key or one value owns most rows.

A plain ``Window.partitionBy(key).orderBy(x)`` sends a hot key to one task.
Here an ordered column is first cut into ranges, so each sort sees one range of
one key, and only one total per range crosses to the next step.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import all_present, as_col, stable_hash
from ..session import bin_count
from .selection import few_groups, select_quantiles

BIN = "__bin"
HASH_DIGITS = 4  # leading hex digits that cut a hash order into 65536 even ranges


class Cuts:
    """Bounds that cut an ordered column into ranges, read in one pass.

    A mergeable quantile sketch gives at most ``bins - 1`` numbers for each value
    of ``split_by``, which is meant for a fixed list such as column names.  The
    numbers go to the driver once and are constants from then on, so a retried
    task puts every value in the same range as before.
    """

    def __init__(self, df: DataFrame, order: str, split_by: Sequence[str] = (), bins: int | None = None):
        self.bins = bins or bin_count(df.sparkSession)
        self.order = order
        self.split_by = list(split_by)
        probs = [i / self.bins for i in range(1, self.bins)]
        sketch = F.percentile_approx(as_col(order).cast("double"), probs, max(200, 4 * self.bins))
        frame = df.groupBy(*self.split_by).agg(sketch.alias("__cuts"))
        self.schema = frame.schema
        self.rows = [r for r in frame.collect() if r["__cuts"] is not None]

    def _search(self, bounds: Column) -> Column:
        # halving search: how many bounds are <= the value
        value = as_col(self.order).cast("double")
        halves = [self.bins >> i for i in range(1, self.bins.bit_length())]
        found = F.aggregate(
            F.lit(halves),
            F.lit(0),
            lambda at, step: F.when(F.element_at(bounds, at + step) <= value, at + step).otherwise(at),
        )
        # never NULL: a join on the range then adds no null filter, and equal subplans stay equal
        return F.coalesce(found, F.lit(0))

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.rows:
            return df.withColumn(BIN, F.lit(0))
        if not self.split_by:
            return df.withColumn(BIN, self._search(F.lit([float(v) for v in self.rows[0]["__cuts"]])))
        table = df.sparkSession.createDataFrame(self.rows, self.schema)
        joined = df.join(F.broadcast(table), self.split_by, "inner")
        return joined.withColumn(BIN, self._search(F.col("__cuts"))).drop("__cuts")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column],
    split_by: Sequence[str] = (),
    bins: int | None = None,
    bounds_from: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running sums per key in the order of ``order``.

    ``df`` must hold one row per (keys, order): pre-aggregate first.  Totals of
    the ranges (at most ``bins`` rows per key) give each range its start value.
    ``bounds_from`` may name the rows before pre-aggregation, so that reading the
    range bounds needs no shuffle.
    """
    binned = Cuts(df if bounds_from is None else bounds_from, order, split_by, bins).apply(df)
    group = [*keys, BIN]
    totals = binned.groupBy(*group).agg(*[F.sum(e).alias(f"__t_{n}") for n, e in sums.items()])
    before = Window.partitionBy(*keys).orderBy(BIN).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *group, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in sums]
    )
    local = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = binned.withColumns({f"__l_{n}": F.sum(e).over(local) for n, e in sums.items()})
    out = placed.join(starts, group, "inner")
    out = out.withColumns({n: F.col(f"__l_{n}") + F.col(f"__s_{n}") for n in sums})
    return out.drop(BIN, *[f"__l_{n}" for n in sums], *[f"__s_{n}" for n in sums])


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    split_by: Sequence[str] = (),
    bins: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per key, one output column per entry of ``probs``.

    Equal values are counted first, counts are added up by value range, and only
    the ranges that hold a wanted rank are sorted.  Keys with no value and missing
    keys are absent.
    """
    present = df.select(*keys, as_col(value).cast("double").alias("__v")).where(all_present([*keys, "__v"]))
    cuts = Cuts(present, "__v", split_by, bins)  # off the raw rows: the sketch needs no shuffle
    counts = present.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    binned = cuts.apply(counts)
    group = [*keys, BIN]
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(BIN).rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        binned.groupBy(*group)
        .agg(F.sum("__n").alias("__m"))
        .select(
            *group,
            "__m",
            F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__start"),
            F.sum("__m").over(whole).alias("__total"),
        )
    )

    def at(p: float) -> Column:
        return (F.col("__total") - 1) * F.lit(float(p))

    def inside(rank: Column, start: str, size: str) -> Column:
        return (F.col(start) <= rank) & (rank < F.col(start) + F.col(size))

    wanted = [inside(end(at(p)), "__start", "__m") for p in probs.values() for end in (F.floor, F.ceil)]
    hits = ranges.where(reduce(lambda a, b: a | b, wanted)).drop("__m")
    local = Window.partitionBy(*group).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = binned.join(hits, group, "inner").withColumn(
        "__at", F.col("__start") + F.coalesce(F.sum("__n").over(local), F.lit(0))
    )
    picks = []
    for name, p in probs.items():
        for side, end in (("lo", F.floor), ("hi", F.ceil)):
            held = F.when(inside(end(at(p)), "__at", "__n"), F.col("__v"))
            picks.append(F.max(held).alias(f"__{side}_{name}"))
    ends = ranked.groupBy(*keys).agg(F.max("__total").alias("__total"), *picks)
    out = []
    for name, p in probs.items():
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((lo + (hi - lo) * (at(p) - F.floor(at(p)))).alias(name))
    return ends.select(*keys, *out)


def quantiles_per_group(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """:func:`exact_quantiles`; a small number of groups, counted first, is served by filtering rows to brackets of the ranks."""
    rows = df.select(*keys, as_col(value).cast("double").alias("__x")).where(all_present([*keys, "__x"]))
    if few_groups(rows, keys):
        return select_quantiles(rows, keys, ["__x"], probs).drop("column")
    return exact_quantiles(df, keys, value, probs)


def number_rows(df: DataFrame, cols: Sequence[str], name: str, seed: int | str = 0) -> DataFrame:
    """Gapless numbers from 1 in the order of a seeded hash of ``cols`` (a fixed shuffle).

    The leading hash digits cut the rows into even ranges; at most 65536 counts
    are added up to give each range its first number.
    """
    hashed = df.withColumn("__h", stable_hash(cols, seed))
    binned = hashed.withColumn(BIN, F.conv(F.substring("__h", 1, HASH_DIGITS), 16, 10).cast("int"))
    before = Window.orderBy(BIN).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        binned.groupBy(BIN)
        .agg(F.count(F.lit(1)).alias("__m"))
        .select(BIN, F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__start"))
    )
    local = F.row_number().over(Window.partitionBy(BIN).orderBy("__h", *cols))
    return (
        binned.withColumn("__i", local)
        .join(F.broadcast(starts), BIN, "inner")  # at most 16**HASH_DIGITS rows
        .withColumn(name, F.col("__start") + F.col("__i"))
        .drop(BIN, "__h", "__i", "__start")
    )


def tag_groups(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """Give rows that agree on all ``cols`` one shared number; NULL where a column is missing."""
    numbered = number_rows(df.where(all_present(cols)).select(*cols).distinct(), cols, name)
    return df.join(numbered, list(cols), "left")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key.

    The rank filter lets Spark cut every map task down to ``n`` rows per key
    before the shuffle, so a hot key sends little.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def latest_row(df: DataFrame, keys: Sequence[str], by: str, ties: Sequence[str] = ()) -> DataFrame:
    """The row with the highest ``by`` of each key; missing values come last."""
    order = [as_col(by).desc_nulls_last(), *[as_col(t).asc_nulls_last() for t in ties]]
    return first_rows(df, keys, order)


def last_rows(df: DataFrame, keys: Sequence[str], by: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key in the order of ``by``."""
    return first_rows(df, keys, [as_col(b).desc_nulls_last() for b in by], n)


def first_value(value: Column | str, by: Sequence[Column | str]) -> Column:
    """Aggregate: first non-missing value in the order of ``by`` (ties: the smallest value)."""
    v = as_col(value)
    return F.min_by(v, F.when(v.isNotNull(), F.struct(*[as_col(b) for b in by], v)))


def last_value(value: Column | str, by: Sequence[Column | str]) -> Column:
    """Aggregate: last non-missing value in the order of ``by`` (ties: the largest value)."""
    v = as_col(value)
    return F.max_by(v, F.when(v.isNotNull(), F.struct(*[as_col(b) for b in by], v)))


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    """The ``k`` highest rows; each task keeps ``k`` rows, no full sort."""
    head = as_col(by).asc_nulls_last() if ascending else as_col(by).desc_nulls_last()
    return df.orderBy(head, *[as_col(t).asc() for t in ties]).limit(k)


def row_slice(df: DataFrame, by: Sequence[str], start: int, stop: int) -> DataFrame:
    """Rows ``start`` to ``stop`` (exclusive) in the order of ``by``."""
    return df.orderBy(*[as_col(b).asc() for b in by]).limit(stop).offset(start)


def head_and_rest(df: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Split by order of a unique key: the first ``n`` rows, and all others."""
    head = df.select(key).orderBy(key).limit(n)
    return df.join(head, key, "left_semi"), df.join(head, key, "left_anti")
