"""Spec aggregates on edge frames: missing values, single rows, empty slices, hot keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featherfold.operators.aggregate import (
    Slice, aggregate, aggregate_unfused, group_statistics, keep_loans_seen_since, merge_specs,
)

ROWS = [
    ("a", 1.0, 1, True), ("a", None, 2, False), ("a", 4.0, 3, None), ("b", None, 1, True), ("b", None, 2, True),
    ("c", 7.0, 1, False), (None, 9.0, 1, True),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "k string, x double, t int, f boolean")


def by_key(df, key="k"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_missing_values_and_keys(frame):
    spec = {"x": ["min", "max", "mean", "sum", "var", "std", "nunique", "first", "last"], "t": ["size"], "f": ["mean"]}
    out = by_key(aggregate(frame, "k", [Slice(spec)], ["t"]))
    assert set(out) == {"a", "b", "c"}
    a, b, c = out["a"], out["b"], out["c"]
    assert (a["x_MIN"], a["x_MAX"], a["x_MEAN"], a["x_SUM"], a["x_NUNIQUE"], a["t_SIZE"]) == (1.0, 4.0, 2.5, 5.0, 2, 3)
    assert (a["x_FIRST"], a["x_LAST"], a["f_MEAN"]) == (1.0, 4.0, 0.5)
    assert b["x_SUM"] == 0.0 and b["x_MEAN"] is None and b["x_NUNIQUE"] == 0 and b["x_FIRST"] is None and b["t_SIZE"] == 2
    assert c["x_VAR"] is None and c["x_STD"] is None


def test_slice_without_rows_is_null_not_zero(frame):
    out = by_key(aggregate(frame, "k", [Slice({"t": ["size"]}), Slice({"x": ["sum", "mean"], "t": ["size"]}, "LATE_", "t >= 2")]))
    assert out["c"]["LATE_x_SUM"] is None and out["c"]["LATE_t_SIZE"] is None
    assert out["b"]["LATE_x_SUM"] == 0.0 and out["b"]["LATE_x_MEAN"] is None and out["b"]["LATE_t_SIZE"] == 1


def test_fused_equals_unfused(spark):
    rng = np.random.default_rng(1)
    n = 4000
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.34, 0, rng.integers(1, 200, n)), "x": rng.normal(size=n), "kind": rng.integers(0, 5, n),
    })
    pdf["t"] = np.arange(n)
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.col("x") > -1, F.col("x")))
    spec = {"x": ["min", "max", "mean", "sum", "var", "nunique", "first"], "t": ["size"]}
    slices = [Slice(spec)] + [Slice(spec, f"K{i}_", f"kind = {i}") for i in range(5)]
    a = aggregate(df, "k", slices, ["t"]).toPandas().sort_values("k").reset_index(drop=True)
    b = aggregate_unfused(df, "k", slices, ["t"]).toPandas().sort_values("k").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False)


def test_merge_specs_keeps_all_functions():
    assert merge_specs({"x": ["min", "mean"]}, {"x": ["mean", "max"], "y": ["sum"]}) == {"x": ["min", "mean", "max"], "y": ["sum"]}


@pytest.mark.parametrize("small", [True, False])
def test_group_statistics_both_join_ways(spark, monkeypatch, small):
    from featherfold.operators import aggregate as module

    if not small:
        monkeypatch.setattr(module, "SMALL_GROUPS", 0)
    rng = np.random.default_rng(2)
    n = 3000
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 20, n).astype(str)), "x": rng.integers(0, 50, n) / 7, "id": np.arange(n)})
    df = spark.createDataFrame(pdf).withColumn("g", F.when(F.col("g") != "3", F.col("g")))
    stats = {"med": ("x", "median"), "mean": ("x", "mean"), "std": ("x", "std"), "sum": ("x", "sum")}
    got = group_statistics(df, ["g"], stats).toPandas().sort_values("id").reset_index(drop=True)
    pdf.loc[pdf["g"] == "3", "g"] = None
    for name, (c, f) in stats.items():
        want = pdf.groupby("g")[c].transform(f)
        np.testing.assert_allclose(got[name].astype(float), want.astype(float), rtol=1e-9)


def test_whole_loans_are_kept(spark):
    df = spark.createDataFrame([(1, 10, -5), (1, 10, -500), (1, 11, -400)], "c int, loan int, d int")
    out = keep_loans_seen_since(df, "loan", "d", "seen")
    assert out.where("seen >= -30").count() == 2
