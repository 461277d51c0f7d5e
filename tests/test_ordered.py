"""Ordered operators against pandas on skewed data: one value and one key hold over a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featherfold.models.metrics import auc, auc_value
from featherfold.operators.ordered import (
    exact_quantiles, first_value, head_and_rest, last_rows, last_value, latest_row, number_rows, row_slice, running_sums,
    tag_groups, top_k,
)


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    n = 5000
    x = np.where(rng.random(n) < 0.35, 1.25, np.exp(rng.normal(size=n) * 3))
    return pd.DataFrame({"id": np.arange(n), "k": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 30, n)), "x": x, "y": (rng.random(n) < 0.3).astype(int)})


@pytest.mark.parametrize("bins", [2, 16, 64])
def test_quantiles(spark, skewed, bins):
    probs = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q99": 0.99}
    got = exact_quantiles(spark.createDataFrame(skewed), ["k"], "x", probs, bins=bins).toPandas().set_index("k").sort_index()
    want = skewed.groupby("k")["x"].quantile(list(probs.values())).unstack()
    np.testing.assert_allclose(got[list(probs)].to_numpy(), want.to_numpy(), rtol=1e-12)


def test_quantiles_small_groups_and_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("c", 1.0), ("c", 2.0), (None, 5.0)], "k string, x double")
    out = {r["k"]: r["m"] for r in exact_quantiles(df, ["k"], "x", {"m": 0.5}).collect()}
    assert out == {"a": 1.0, "c": 1.5}


def test_running_sums(spark, skewed):
    pre = spark.createDataFrame(skewed).groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    got = running_sums(pre, ["k"], "x", {"rn": F.col("n"), "ry": F.col("y")}).toPandas()
    want = skewed.groupby(["k", "x"]).agg(n=("id", "size"), y=("y", "sum")).groupby(level=0).cumsum().reset_index()
    both = got.merge(want, on=["k", "x"], suffixes=("", "_want"))
    assert len(both) == len(got) == len(want)
    assert (both["rn"] == both["n_want"]).all() and (both["ry"] == both["y_want"]).all()


def test_number_rows_is_a_permutation(spark):
    df = spark.range(3000)
    a = number_rows(df, ["id"], "p", 1).toPandas()
    assert sorted(a["p"]) == list(range(1, 3001))
    b = number_rows(df.repartition(5), ["id"], "p", 1).toPandas()
    assert a.sort_values("id")["p"].tolist() == b.sort_values("id")["p"].tolist()
    assert a.sort_values("id")["p"].tolist() != number_rows(df, ["id"], "p", 2).toPandas().sort_values("id")["p"].tolist()


def test_tag_groups(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 1)], "a int, b int")
    rows = tag_groups(df, ["a", "b"], "u").collect()
    tags = {(r["a"], r["b"]): r["u"] for r in rows}
    assert len(rows) == 4 and tags[(None, 1)] is None and {tags[(1, 1)], tags[(1, 2)]} == {1, 2}


def test_latest_first_last(spark):
    df = spark.createDataFrame([(1, 5, 10.0), (1, 7, None), (1, 7, 3.0), (2, None, 1.0), (2, 1, 2.0)], "k int, t int, x double")
    last = {r["k"]: r["x"] for r in latest_row(df, ["k"], "t", ["x"]).collect()}
    assert last == {1: 3.0, 2: 2.0}
    ends = df.groupBy("k").agg(first_value("x", ["t"]).alias("f"), last_value("x", ["t"]).alias("l")).collect()
    assert {r["k"]: (r["f"], r["l"]) for r in ends} == {1: (10.0, 3.0), 2: (1.0, 2.0)}


def test_slices_and_tops(spark):
    df = spark.range(100).withColumn("v", (F.col("id") * 37) % 101)
    assert [r["id"] for r in row_slice(df, ["id"], 50, 60).collect()] == list(range(50, 60))
    assert [r["v"] for r in top_k(df, "v", 3, ["id"]).collect()] == sorted([(i * 37) % 101 for i in range(100)], reverse=True)[:3]
    head, rest = head_and_rest(df, "id", 10)
    assert head.count() == 10 and rest.count() == 90
    assert last_rows(df.withColumn("k", F.lit(1)), ["k"], ["id"], 3).agg(F.sum("id")).collect()[0][0] == 99 + 98 + 97


def rank_auc(score, y):
    r = pd.Series(score).rank()
    p = y.sum()
    return (r[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_auc_with_ties(spark, skewed):
    df = spark.createDataFrame(skewed)
    assert auc_value(df, "x", "y") == pytest.approx(rank_auc(skewed["x"].to_numpy(), skewed["y"]), rel=1e-12)
    flipped = df.withColumn("s", 1 - F.col("x"))
    assert auc_value(flipped, "s", "y") == pytest.approx(1 - auc_value(df, "x", "y"), rel=1e-12)
    per_key = {r["k"]: r["auc"] for r in auc(df, "x", "y", ["k"]).collect()}
    for k, part in skewed.groupby("k"):
        assert per_key[k] == pytest.approx(rank_auc(part["x"].to_numpy(), part["y"].reset_index(drop=True)), rel=1e-12)


def test_auc_of_one_class_is_null(spark):
    assert auc_value(spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int"), "s", "y") is None
