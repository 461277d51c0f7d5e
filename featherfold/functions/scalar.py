"""Column expressions with the missing-value rules of the data model.

Missing is NULL throughout.  Division by zero gives NULL, comparisons with a
missing value are false, row-wise sums and means skip missing values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Colish = Column | str

SECONDS_PER_MEAN_MONTH = 2_629_746  # 30.436875 days


def as_col(c: Colish) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def ratio(num: Colish, den: Colish) -> Column:
    """``num / den`` as double; NULL where the divisor is zero or a side is missing."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def minus(a: Colish, b: Colish) -> Column:
    return as_col(a) - as_col(b)


def holds(cond: Column) -> Column:
    """A condition where unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    """1 where the condition holds, else 0 (also for missing input)."""
    return holds(cond).cast("int")


def pick(cond: Column, value: Colish, other: float = 0.0) -> Column:
    """``value`` where the condition holds, else ``other``."""
    return F.when(holds(cond), as_col(value)).otherwise(F.lit(other))


def floor_at_zero(c: Colish) -> Column:
    """Negative and missing values become 0."""
    c = as_col(c)
    return F.when(c > 0, c).otherwise(F.lit(0))


def sentinel_to_null(c: Colish, sentinel: float) -> Column:
    return F.nullif(as_col(c), F.lit(sentinel))


def cap_to_null(c: Colish, low: float | None = None, high: float | None = None) -> Column:
    """Keep values inside [low, high]; others become NULL."""
    c = as_col(c)
    keep = F.lit(True)
    if low is not None:
        keep = keep & (c >= F.lit(low))
    if high is not None:
        keep = keep & (c <= F.lit(high))
    return F.when(keep, c)


def abs_cap_to_null(c: Colish, limit: float) -> Column:
    c = as_col(c)
    return F.when(F.abs(c) <= F.lit(limit), c)


def infinity_to(c: Colish, value: float) -> Column:
    """Replace +-infinity by a constant."""
    c = as_col(c)
    return F.when(c.isin(float("inf"), float("-inf")), F.lit(value)).otherwise(c)


def nan_to_null(c: Colish) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def strict_sum(cols: Sequence[Colish]) -> Column:
    """Sum that is NULL as soon as one term is missing."""
    return reduce(lambda a, b: a + b, [as_col(c) for c in cols])


def row_sum(cols: Sequence[Colish]) -> Column:
    """Sum across columns, skipping missing values."""
    return reduce(lambda a, b: a + b, [F.coalesce(as_col(c).cast("double"), F.lit(0.0)) for c in cols])


def row_present(cols: Sequence[Colish]) -> Column:
    return reduce(lambda a, b: a + b, [as_col(c).isNotNull().cast("int") for c in cols])


def row_missing(cols: Sequence[Colish]) -> Column:
    """How many of the columns are missing in the row."""
    return reduce(lambda a, b: a + b, [as_col(c).isNull().cast("int") for c in cols])


def row_mean(cols: Sequence[Colish]) -> Column:
    return F.try_divide(row_sum(cols), row_present(cols).cast("double"))


def row_kurtosis(cols: Sequence[Colish]) -> Column:
    """Bias-corrected excess kurtosis across columns; NULL below four values, 0 without spread."""
    values = F.filter(F.array(*[as_col(c).cast("double") for c in cols]), lambda v: v.isNotNull())
    n = F.size(values).cast("double")
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.nullif(n, F.lit(0.0))
    # (mean, m2, m4) travel in one struct so the mean is worked out once per row
    moments = F.aggregate(
        values,
        F.struct(mean.alias("mu"), F.lit(0.0).alias("m2"), F.lit(0.0).alias("m4")),
        lambda s, v: F.struct(
            s["mu"].alias("mu"),
            (s["m2"] + (v - s["mu"]) * (v - s["mu"])).alias("m2"),
            (s["m4"] + F.pow(v - s["mu"], F.lit(4.0))).alias("m4"),
        ),
        lambda s: F.when(s["m2"] < 1e-14, F.lit(None).cast("double")).otherwise(s["m4"] / (s["m2"] * s["m2"])),
    )
    scale = (n * (n + 1) * (n - 1)) / ((n - 2) * (n - 3))
    shift = 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))
    return F.when(n >= 4, F.coalesce(scale * moments - shift, F.lit(0.0)))


def age_band(days_birth: Colish) -> Column:
    """Age group from a negative day offset; missing or 99 and over gives 0."""
    # fixed values: upper bounds in years of bands 1 to 5
    bounds = (27, 40, 50, 65, 99)
    years = -as_col(days_birth) / F.lit(365.0)
    out = F.when(years < bounds[0], 1)
    for band, bound in enumerate(bounds[1:], start=2):
        out = out.when(years < bound, band)
    return out.otherwise(0)


def day_to_date(offset: Colish, anchor: str = "2016-01-01") -> Column:
    return F.date_add(F.lit(anchor).cast("date"), as_col(offset).cast("int"))


def month_to_timestamp(offset: Colish, anchor: str = "2016-01-01", calendar: bool = False) -> Column:
    """Month offset to time: mean months by default, calendar months on request."""
    if calendar:
        return F.add_months(F.lit(anchor).cast("date"), as_col(offset).cast("int")).cast("timestamp")
    base = F.unix_timestamp(F.lit(anchor).cast("timestamp"))
    return F.timestamp_seconds(base + as_col(offset).cast("long") * F.lit(SECONDS_PER_MEAN_MONTH))


def all_present(cols: Sequence[Colish]) -> Column:
    """No column is missing.  Plain null tests reach the scan and let equal subplans be shared."""
    return reduce(lambda a, b: a & b, [as_col(c).isNotNull() for c in cols])


def stable_hash(cols: Sequence[Colish], seed: int | str) -> Column:
    """Hex digest of the columns and a seed: the same on every run, engine and partitioning."""
    return F.md5(F.concat_ws("-", *[as_col(c).cast("string") for c in cols], F.lit(str(seed))))


def hash_bucket(cols: Sequence[Colish], buckets: int, seed: int | str = 50) -> Column:
    """Even assignment to ``buckets`` numbered from 0, used for folds and hold-out splits."""
    head = F.conv(F.substring(stable_hash(cols, seed), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(buckets)).cast("int")
