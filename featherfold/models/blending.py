"""Blending and stacking of model scores."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bin_count
from .metrics import auc, auc_value
from .training import assemble, logistic, positive_score


def blend(scores: DataFrame, weights: Mapping[str, float], name: str = "TARGET") -> DataFrame:
    """Weighted sum of the score columns of one joined table."""
    total = sum((F.col(m) * F.lit(float(w)) for m, w in weights.items()), F.lit(0.0))
    return scores.withColumn(name, total)


def weight_vectors(models: Sequence[str], n: int, seed: int = 0) -> list[dict[str, float]]:
    """Seeded random weights, each vector summing to 1."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        raw = [rng.random() for _ in models]
        total = sum(raw)
        out.append({m: w / total for m, w in zip(models, raw)})
    return out


def score_weights(scores: DataFrame, label: str, vectors: Sequence[Mapping[str, float]]) -> DataFrame:
    """(vector, loss): 1 - AUC of every weight vector, all in one job.

    Each row is repeated once per vector, a number the caller sets.  Before that the rows are dealt out to a fixed
    number of tasks: parts that were joined up for their size would grow by that number in one task.
    """
    models = list(vectors[0])
    literals = F.array(
        *[F.struct(F.lit(i).alias("vector"), *[F.lit(float(v[m])).alias(f"__w_{m}") for m in models])
          for i, v in enumerate(vectors)]
    )
    dealt = scores.select(label, *models).repartition(bin_count(scores.sparkSession))
    rows = dealt.select(label, *models, F.inline(literals))
    total = sum((F.col(m) * F.col(f"__w_{m}") for m in models), F.lit(0.0))
    rows = rows.select("vector", label, total.alias("__blend"))
    return auc(rows, "__blend", label, ["vector"]).select("vector", (1 - F.col("auc")).alias("loss"))


def best_weights(scores: DataFrame, label: str, vectors: Sequence[Mapping[str, float]]) -> dict[str, float]:
    row = score_weights(scores, label, vectors).agg(F.min_by("vector", F.struct("loss", "vector")).alias("v")).collect()[0]
    return dict(vectors[row["v"]])


def penalty_sweep(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str, strengths: Sequence[float]
) -> DataFrame:
    """(c, auc, <model>...): hold-out AUC and normalised coefficients per inverse penalty."""
    spark = train.sparkSession
    data, held = assemble(train, features).select(label, "features").persist(), assemble(test, features)
    rows = []
    try:
        n = data.count()
        for c in strengths:
            model = logistic(label, regParam=1.0 / (c * n), standardization=False).fit(data)
            coef = model.coefficients.toArray()
            total = float(coef.sum()) or 1.0
            value = auc_value(positive_score(model.transform(held)), "score", label)
            rows.append((float(c), value, *[float(x) / total for x in coef]))
    finally:
        data.unpersist()
    schema = "c double, auc double, " + ", ".join(f"`{f}` double" for f in features)
    return spark.createDataFrame(rows, schema)
