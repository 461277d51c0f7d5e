"""Missing-value rules of the scalar expressions, on hand-made rows, against pandas where it applies."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from featherfold.functions import scalar as S


def values(df):
    return [r[0] for r in df.collect()]


def test_ratio_zero_and_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (0.0, 0.0), (None, 2.0), (3.0, None)], "a double, b double")
    assert values(df.select(S.ratio("a", "b"))) == [0.5, None, None, None, None]


def test_row_statistics_skip_missing(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    assert values(df.select(S.row_mean(["a", "b", "c"]))) == [2.0, None]
    assert values(df.select(S.row_sum(["a", "b", "c"]))) == [4.0, 0.0]
    assert values(df.select(S.strict_sum(["a", "b", "c"]))) == [None, None]
    assert values(df.select(S.row_missing(["a", "b", "c"]))) == [1, 3]


@pytest.mark.parametrize(
    "row", [(1.0, 2.0, 4.0, 9.0, 1.5), (5.0, 5.0, 5.0, 5.0, 5.0), (1.0, None, 2.0, 8.0, 3.0), (1.0, None, None, 8.0, 3.0)]
)
def test_row_kurtosis_equals_pandas(spark, row):
    names = list("abcde")
    df = spark.createDataFrame([row], ", ".join(f"{n} double" for n in names))
    got = values(df.select(S.row_kurtosis(names)))[0]
    want = pd.DataFrame([row], columns=names).astype(float).kurtosis(axis=1)[0]
    assert got is None if math.isnan(want) else got == pytest.approx(want)


def test_flags_treat_unknown_as_false(spark):
    df = spark.createDataFrame([(5.0,), (-1.0,), (None,)], "x double")
    assert values(df.select(S.flag(F.col("x") > 0))) == [1, 0, 0]
    assert values(df.select(S.floor_at_zero("x"))) == [5.0, 0.0, 0.0]
    assert values(df.select(S.pick(F.col("x") > 0, "x"))) == [5.0, 0.0, 0.0]


def test_age_band_edges(spark):
    years = [26.9, 27, 39.9, 40, 50, 65, 98.9, 99, None]
    df = spark.createDataFrame([(None if y is None else -365.0 * y,) for y in years], "d double")
    assert values(df.select(S.age_band("d"))) == [1, 2, 2, 3, 4, 5, 5, 0, 0]


def test_caps_and_sentinels(spark):
    df = spark.createDataFrame([(365243,), (10,), (-50,), (None,)], "x int")
    assert values(df.select(S.sentinel_to_null("x", 365243))) == [None, 10, -50, None]
    assert values(df.select(S.cap_to_null("x", low=-20, high=100))) == [None, 10, None, None]
    assert values(df.select(S.abs_cap_to_null("x", 20))) == [None, 10, None, None]


def test_nan_and_infinity(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.0,)], "x double")
    assert values(df.select(S.nan_to_null("x")))[0] is None
    assert values(df.select(S.infinity_to("x", 0.0)))[1:] == [0.0, 2.0]


def test_dates(spark):
    df = spark.createDataFrame([(-1, -1)], "d int, m int")
    r = df.select(S.day_to_date("d").cast("string"), S.month_to_timestamp("m").cast("string"), S.month_to_timestamp("m", calendar=True).cast("string")).collect()[0]
    want = pd.Timestamp("2016-01-01") - pd.Timedelta(seconds=2_629_746)
    assert r[0] == "2015-12-31" and r[1] == str(want) and r[2] == "2015-12-01 00:00:00"


def test_buckets_are_stable_and_even(spark):
    df = spark.range(10_000).select("id", S.hash_bucket(["id"], 5, 50).alias("b"))
    sizes = [r["count"] for r in df.groupBy("b").count().collect()]
    assert sum(sizes) == 10_000 and len(sizes) == 5 and max(sizes) < 2300
    again = df.repartition(7).groupBy("b").agg(F.sum("id")).collect()
    assert sorted(again) == sorted(df.groupBy("b").agg(F.sum("id")).collect())
