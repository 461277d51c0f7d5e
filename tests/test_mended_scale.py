"""Steps whose cost must follow the rows, not the shuffle or the scan that they come from."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from featherfold.catalog.screening import customers
from featherfold.models import blending, neighbours
from featherfold.models.training import logistic, training_rows, OutOfFold, assemble
from featherfold.operators.aggregate import WIDE, Slice, aggregate


def _wide_plan(spark, outputs):
    df = spark.range(0, 1000, 1, 4).select((F.col("id") % 7).alias("k"), *[(F.col("id") + i).alias(f"x{i}") for i in range(outputs)])
    return df, aggregate(df, "k", [Slice({f"x{i}": ["max"] for i in range(outputs)})])


def test_fits_run_in_a_few_tasks_per_core(spark):
    df = spark.range(0, 5000, 1, 200)
    most = 2 * spark.sparkContext.defaultParallelism
    with training_rows(df) as data:
        assert data.rdd.getNumPartitions() <= most
        assert data.count() == 5000
    assert not df.storageLevel.useMemory


def test_out_of_fold_fits_get_few_parts(spark):
    seen = []

    class Watched(OutOfFold):
        def _fit(self, data, fold):
            seen.append(data.rdd.getNumPartitions())
            return super()._fit(data, fold)

    rows = spark.range(0, 400, 1, 100).select("id", (F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 5).alias("x"))
    run = Watched(logistic("y"), "id", "y", folds=2).run(assemble(rows, ["x"]))
    assert run.oof.count() == 400
    assert max(seen) <= 2 * spark.sparkContext.defaultParallelism


def test_means_of_customers_do_not_depend_on_the_order_of_orders(spark, tmp_path):
    prices = [1e15, 0.1, -1e15, 0.3, 7.7, 1e-3]
    digests = set()
    for i, order in enumerate(([0, 1, 2, 3, 4, 5], [0, 2, 1, 3, 5, 4], [5, 3, 1, 0, 4, 2])):
        d = tmp_path / str(i)
        d.mkdir()
        pd.DataFrame({"o_orderkey": order, "o_custkey": [1] * 6, "o_totalprice": [prices[j] for j in order]}).to_parquet(d / "orders.parquet")
        pd.DataFrame({"c_custkey": [1, 2], "c_nationkey": [3, 4], "c_acctbal": [1.0, -1.0], "c_mktsegment": ["A", "B"]}).to_parquet(d / "customer.parquet")
        rows = {r["c_custkey"]: r["price_mean"] for r in customers(spark, str(d)).collect()}
        digests.add(rows[1])
        assert rows[2] == 0.0
    assert len(digests) == 1


def test_wide_aggregates_gather_the_rows_of_a_key_first(spark):
    df, wide = _wide_plan(spark, WIDE)
    _, narrow = _wide_plan(spark, WIDE - 1)
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "Rebalance" in plan(wide)
    assert "Rebalance" not in plan(narrow)
    assert {r["k"]: r["x0_MAX"] for r in wide.collect()} == {k: max(range(k, 1000, 7)) for k in range(7)}


def test_blended_rows_are_dealt_out_before_they_are_repeated(spark):
    scores = spark.range(0, 100, 1, 1).select((F.col("id") % 2).alias("y"), F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"))
    got = []
    plain = blending.auc
    try:
        blending.auc = lambda rows, *rest: got.append(rows.rdd.getNumPartitions()) or plain(rows, *rest)
        assert blending.score_weights(scores, "y", [{"a": 1.0, "b": 0.0}, {"a": 0.0, "b": 1.0}]).count() == 2
    finally:
        blending.auc = plain
    assert got[0] >= 16


def test_neighbour_tasks_hold_bounded_matrices():
    b = pd.DataFrame({"x": np.arange(10_000)})
    cut = list(neighbours._pieces(iter([b]), 2048))
    assert max(len(p) for p in cut) * 2048 <= neighbours.MOST_ENTRIES
    assert pd.concat(cut)["x"].tolist() == b["x"].tolist()
