"""The folds of the perceptron query are fitted side by side."""

import threading

from pyspark.sql import functions as F

from featherfold.catalog import QUERIES
from featherfold.models.training import OutOfFold


def test_all_folds_of_the_perceptron_overlap(spark, tmp_path, monkeypatch):
    ids = spark.range(120)
    ids.select(
        F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit("M").alias("c_mktsegment"),
        ((F.col("id") * 37 % 100) - 40.0).alias("c_acctbal"),
    ).write.parquet(str(tmp_path / "customer.parquet"))
    ids.where("id % 10 <> 0").select(
        F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), (F.col("id") * 13 % 50 + 0.5).alias("o_totalprice")
    ).write.parquet(str(tmp_path / "orders.parquet"))
    meet, inner, short = threading.Barrier(5, timeout=60), OutOfFold._fit, []

    def together(self, frame, fold):
        meet.wait()  # passes only while all the other folds are being fitted
        short.append(fold)
        self.estimator = self.estimator.copy({self.estimator.maxIter: 3})
        return inner(self, frame, fold)

    monkeypatch.setattr(OutOfFold, "_fit", together)
    rows = QUERIES["m11_perceptron_scores"](spark, str(tmp_path)).collect()
    assert sorted(short) == [0, 1, 2, 3, 4]
    assert sorted(r["c_custkey"] for r in rows) == list(range(120)) and all(0 <= r["MLP"] <= 1 for r in rows)
