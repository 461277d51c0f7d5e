"""Exact ROC AUC and the tables built from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import as_col
from ..operators.ordered import BIN, Cuts


def auc(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), name: str = "auc") -> DataFrame:
    """Area under the ROC curve per key; tied scores count half.

    Scores are counted per distinct value, cut into ranges, summed inside each
    range, and only one total per range is put in order.  No task sorts more than
    one range of one key.
    """
    keys = list(keys)
    rows = df.select(*keys, as_col(score).cast("double").alias("__s"), as_col(label).cast("int").alias("__y"))
    rows = rows.where(F.col("__s").isNotNull() & F.col("__y").isNotNull())
    cuts = Cuts(rows, "__s")
    pos, neg = F.sum("__y").alias("__pos"), F.sum(1 - F.col("__y")).alias("__neg")
    binned = cuts.apply(rows.groupBy(*keys, "__s").agg(pos, neg))
    group = [*keys, BIN]
    local = Window.partitionBy(*group).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("__neg").over(local), F.lit(0))
    area = F.col("__pos").cast("double") * (below + F.col("__neg") / 2)
    ranges = (
        binned.withColumn("__area", area)
        .groupBy(*group)
        .agg(F.sum("__pos").alias("__pos"), F.sum("__neg").alias("__neg"), F.sum("__area").alias("__area"))
    )
    before = Window.partitionBy(*keys).orderBy(BIN).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("__below", F.coalesce(F.sum("__neg").over(before), F.lit(0)))
    total = F.sum(F.col("__area") + F.col("__pos").cast("double") * F.col("__below"))
    pairs = F.sum("__pos").cast("double") * F.sum("__neg").cast("double")
    return placed.groupBy(*keys).agg(F.try_divide(total, pairs).alias(name))


def auc_value(df: DataFrame, score: str, label: str) -> float | None:
    return auc(df, score, label).collect()[0]["auc"]


def fold_metrics(valid: DataFrame, train: DataFrame, score: str, label: str, fold: str = "fold") -> DataFrame:
    """(fold, train, valid) with an ``overall`` row.

    ``valid`` holds each row once under the fold that scored it, ``train`` holds the rows
    each fold's model was fitted on.  Overall: AUC of all valid scores, mean of train AUCs.
    """
    v = auc(valid, score, label, [fold], "valid")
    t = auc(train, score, label, [fold], "train")
    per_fold = t.join(v, fold, "full").select(F.col(fold).cast("string").alias("fold"), "train", "valid")
    none = F.lit(None).cast("double")
    whole = auc(valid, score, label, (), "valid").select(none.alias("train"), "valid")
    mean = t.agg(F.avg("train").alias("train")).select("train", none.alias("valid"))
    overall = whole.unionByName(mean).agg(F.max("train").alias("train"), F.max("valid").alias("valid"))
    return per_fold.unionByName(overall.select(F.lit("overall").alias("fold"), "train", "valid"))
