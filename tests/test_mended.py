"""Cases that the small tables do not hold: constants, large shifts, keys that only some slices know."""

import math

from featherfold.operators.aggregate import Slice, aggregate, aggregate_unfused
from featherfold.operators.density import class_medians
from featherfold.operators.screen import correlated_columns, correlation_pairs, distance_correlations, label_correlations


def _frame(spark):
    rows = [(float(i), 2.0, float(i * i % 7) if i % 3 else None, i % 2, 1e9 + i) for i in range(40)]
    return spark.createDataFrame(rows, "x double, same double, gaps double, y int, far double")


def test_correlations_with_a_constant_column(spark):
    df = _frame(spark)
    by = {r["feature"]: r["importance"] for r in label_correlations(df, ["x", "same", "gaps"], "y").collect()}
    assert by["same"] is None and by["x"] is not None
    pairs = {(r["a"], r["b"]): r["r"] for r in correlation_pairs(df, ["x", "same", "gaps", "far"]).collect()}
    assert len(pairs) == 6 and pairs["x", "same"] is None and pairs["same", "gaps"] is None
    assert math.isclose(pairs["x", "far"], 1.0, rel_tol=1e-9)
    both = [(i, i * i % 7) for i in range(40) if i % 3]
    mx, my = sum(a for a, _ in both) / len(both), sum(b for _, b in both) / len(both)
    want = sum((a - mx) * (b - my) for a, b in both) / math.sqrt(
        sum((a - mx) ** 2 for a, _ in both) * sum((b - my) ** 2 for _, b in both)
    )
    assert math.isclose(pairs["x", "gaps"], want, rel_tol=1e-9)
    assert correlated_columns(df, ["x", "same", "far"]) == ["far"]
    assert class_medians(df, "same", "y").first()["corr"] is None


def test_pairs_do_not_depend_on_the_number_of_columns(spark):
    df = _frame(spark).selectExpr("*", *[f"x * {i} + same AS k{i}" for i in range(1, 40)])
    few = {(r["a"], r["b"]): r["r"] for r in correlation_pairs(df, ["x", "gaps"]).collect()}
    many = {(r["a"], r["b"]): r["r"] for r in correlation_pairs(df, ["x", "gaps", "same", *[f"k{i}" for i in range(1, 40)]]).collect()}
    assert math.isclose(few["x", "gaps"], many["x", "gaps"], rel_tol=1e-12) and many["gaps", "same"] is None
    assert correlation_pairs(df, ["x"]).collect() == []


def test_distance_correlation_ignores_shift_and_scale(spark):
    df = _frame(spark).selectExpr("y", "gaps AS a", "gaps + 1e9 AS b", "gaps * 1e-6 AS c", "same")
    by = {r["feature"]: r["importance"] for r in distance_correlations(df, ["a", "b", "c", "same"], "y").collect()}
    assert math.isclose(by["a"], by["b"], rel_tol=1e-5) and math.isclose(by["a"], by["c"], rel_tol=1e-9)
    assert by["same"] == 0.0


def test_filtered_distinct_counts_keep_all_keys(spark):
    df = spark.createDataFrame([(1, "A", 5), (1, "A", 6), (2, "B", 7), (3, "C", 8)], "k int, t string, v int")
    slices = [Slice({"v": ["nunique"]}, "A_", "t = 'A'"), Slice({"v": ["nunique"]}, "B_", "t = 'B'")]
    for run in (aggregate, aggregate_unfused):
        got = {r[0]: tuple(r[1:]) for r in run(df, "k", slices).collect()}
        assert got == {1: (2, None), 2: (None, 1), 3: (None, None)}, run.__name__
