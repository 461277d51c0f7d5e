"""Screening and modelling: exact forms against brute force, learners by invariants and bounds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featherfold.models.blending import best_weights, blend, penalty_sweep, weight_vectors
from featherfold.models.metrics import auc_value, fold_metrics
from featherfold.models.neighbours import nearest
from featherfold.models.training import (
    OutOfFold, assemble, boosted_trees, class_weights, grid, hold_out, logistic, pipeline, random_forest, random_maps, search,
    search_table, with_fold,
)
from featherfold.operators.screen import (
    anova_f, combined_selection, correlated_columns, correlation_pairs, distance_correlations, forest_ranks, lasso_ranks,
    permutation_importance, scaled_ranks,
)


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(5)
    n = 600
    y = (rng.random(n) < 0.3).astype(int)
    signal = y + rng.normal(size=n)
    return pd.DataFrame({
        "id": np.arange(n), "y": y, "signal": signal, "noise": rng.normal(size=n), "copy": signal * 2 + 1,
        "steps": rng.integers(0, 4, n).astype(float),
    })


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).cache()


COLUMNS = ["signal", "noise", "copy", "steps"]


def brute_dcor(x, y):
    a, b = np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None])
    a = a - a.mean(0) - a.mean(1)[:, None] + a.mean()
    b = b - b.mean(0) - b.mean(1)[:, None] + b.mean()
    return np.sqrt((a * b).mean() / np.sqrt((a * a).mean() * (b * b).mean()))


def test_distance_correlation_equals_pair_formula(df, pdf):
    got = {r["feature"]: r["importance"] for r in distance_correlations(df, COLUMNS, "y").collect()}
    for c in COLUMNS:
        assert got[c] == pytest.approx(brute_dcor(pdf[c].to_numpy(), pdf["y"].to_numpy().astype(float)), rel=1e-8)


def test_distance_correlation_of_constant_is_zero(df):
    out = distance_correlations(df.withColumn("c", F.lit(3.0)), ["c"], "y").collect()
    assert out[0]["importance"] == 0.0


def test_anova(df, pdf):
    got = {r["feature"]: r["importance"] for r in anova_f(df, COLUMNS, "y").collect()}
    for c in COLUMNS:
        g = [pdf.loc[pdf["y"] == k, c] for k in (0, 1)]
        between = sum(len(p) * (p.mean() - pdf[c].mean()) ** 2 for p in g)
        within = sum(((p - p.mean()) ** 2).sum() for p in g) / (len(pdf) - 2)
        assert got[c] == pytest.approx(between / within, rel=1e-9)


def test_correlation_ways_agree(df):
    with_gaps = df.withColumn("steps", F.when(F.col("steps") > 0, F.col("steps")))
    got = {(r["a"], r["b"]): r["r"] for r in correlation_pairs(with_gaps, COLUMNS).collect()}
    want = with_gaps.toPandas()[list(COLUMNS)].astype(float).corr()
    assert len(got) == len(COLUMNS) * (len(COLUMNS) - 1) // 2
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b], rel=1e-9, abs=1e-12)


def test_correlated_columns_keep_the_first(df):
    assert correlated_columns(df, COLUMNS) == ["copy"]
    negative = df.withColumn("mirror", -F.col("signal"))
    assert correlated_columns(negative, [*COLUMNS, "mirror"]) == ["copy"]
    assert correlated_columns(negative, [*COLUMNS, "mirror"], absolute=True) == ["copy", "mirror"]


def test_ranks_and_selection(spark, df):
    t = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "feature string, importance double")
    assert [(r["feature"], r["importance"]) for r in scaled_ranks(t).collect()] == [("b", 1.0), ("c", 0.5), ("a", 0.0)]
    assert combined_selection([t, scaled_ranks(t, -1)], 1, independent=["a"], add=["z"], remove=["q"]) == ["b", "z"]
    lasso = [r["feature"] for r in lasso_ranks(df, COLUMNS, "y", [0.001, 0.01]).collect()]
    forest = [r["feature"] for r in forest_ranks(df, ["signal", "noise"], "y", numTrees=10).collect()]
    assert lasso[0] in ("signal", "copy") and forest == ["signal", "noise"]


def test_permutation_importance_finds_signal(df):
    model = pipeline(["signal", "noise"], boosted_trees("y", maxIter=5, maxDepth=3)).fit(df)
    got = {r["feature"]: r["importance"] for r in permutation_importance(model, df, ["signal", "noise"], "id", "y").collect()}
    assert got["signal"] > 0.1 > abs(got["noise"])


def test_out_of_fold_covers_every_row_once(df):
    run = OutOfFold(boosted_trees("y", maxIter=5, maxDepth=3), "id", "y", folds=3).run(assemble(df, ["signal", "noise"]), assemble(df, ["signal", "noise"]))
    oof = run.oof.toPandas()
    assert sorted(oof["id"]) == list(range(600)) and oof["score"].between(0, 1).all()
    assert auc_value(run.oof, "score", "y") > 0.65
    assert run.test.count() == 600
    metrics = {r["fold"]: r for r in run.metrics().collect()}
    assert set(metrics) == {"0", "1", "2", "overall"} and metrics["overall"]["train"] > metrics["overall"]["valid"] - 0.05
    names = {r["feature"] for r in run.importances(["signal", "noise"]).collect()}
    assert names == {"signal", "noise"}


def test_out_of_fold_resumes(df, tmp_path):
    data = assemble(df, ["signal", "noise"])
    first = OutOfFold(random_forest("y", numTrees=5), "id", "y", "RF", folds=3, store=str(tmp_path)).run(data, data)
    again = OutOfFold(random_forest("y", numTrees=5), "id", "y", "RF", folds=3, store=str(tmp_path)).run(data, data)
    assert first.fitted == [0, 1, 2] and again.fitted == []
    assert sorted(map(tuple, first.oof.select("id", "RF").collect())) == sorted(map(tuple, again.oof.select("id", "RF").collect()))
    assert again.test.count() == 600


def test_hold_out_and_weights(df):
    train, test = hold_out(df, "id", 0.7)
    assert train.count() + test.count() == 600 and train.join(test, "id").count() == 0
    w = class_weights(df, "y").groupBy("y").agg(F.sum("weight").alias("w")).collect()
    assert [r["w"] for r in w] == pytest.approx([300.0, 300.0])


def test_fold_metrics_overall_row(df):
    scored = with_fold(df, "id", 3)
    out = {r["fold"]: r for r in fold_metrics(scored, scored, "signal", "y").collect()}
    assert out["overall"]["valid"] == pytest.approx(auc_value(df, "signal", "y"))
    assert out["overall"]["train"] == pytest.approx(np.mean([out[str(i)]["train"] for i in range(3)]))


def test_blend_prefers_the_signal(df):
    vectors = weight_vectors(["signal", "noise"], 15)
    best = best_weights(df, "y", vectors)
    assert best["signal"] > 0.5 and sum(best.values()) == pytest.approx(1)
    row = blend(df, {"signal": 0.5, "noise": 2.0}, "s").select("signal", "noise", "s").first()
    assert row["s"] == pytest.approx(row["signal"] * 0.5 + row["noise"] * 2)


def test_search_and_penalties(spark, df):
    data = assemble(with_fold(df, "id", 2), ["signal", "noise"])
    lr = logistic("y")
    maps = random_maps({lr.regParam: [0.0, 0.1], lr.elasticNetParam: lambda r: r.random()}, 3)
    table = search_table(search(lr, maps, data, "y", 2), spark, maps).collect()
    assert len(table) == 3 and table[0]["auc"] >= table[-1]["auc"] > 0.6
    sweep = penalty_sweep(*hold_out(df, "id", 0.7), ["signal", "noise"], "y", [0.01, 1]).collect()
    assert all(r["auc"] > 0.6 and r["signal"] + r["noise"] == pytest.approx(1) for r in sweep)


@pytest.mark.parametrize("block", [7, 20_000])
def test_nearest_equals_brute_force(spark, block):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(150, 4)), np.tile(rng.normal(size=4), (60, 1))])  # 60 copies of one vector
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    got = nearest(frame.where("id % 3 <> 0"), frame.where("id % 3 = 0"), "id", "v", k=5, pivots=8, block_rows=block).toPandas()
    train = [i for i in range(len(x)) if i % 3]
    for i in range(0, len(x), 3):
        d = [(float(np.sqrt(((x[j] - x[i]) ** 2).sum())), j) for j in train]
        assert sorted(got.loc[got["query"] == i, "neighbour"]) == sorted(j for _, j in sorted(d)[:5])


def test_nearest_from_other_folds_only(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 3))
    x[40:90] = x[40]
    frame = with_fold(spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>"), "id", 3)
    fold = {r["id"]: r["fold"] for r in frame.collect()}
    got = nearest(frame, frame, "id", "v", k=4, pivots=6, not_same="fold").toPandas()
    for i in range(len(x)):
        d = sorted((float(np.sqrt(((x[j] - x[i]) ** 2).sum())), j) for j in range(len(x)) if fold[j] != fold[i])
        assert sorted(got.loc[got["query"] == i, "neighbour"]) == sorted(j for _, j in d[:4])


def test_store_keeps_runs_apart_and_reads_finished_folds(df, tmp_path):
    data = assemble(df, ["signal", "noise"])
    forest = random_forest("y", numTrees=5)
    OutOfFold(forest, "id", "y", "RF", folds=5, store=str(tmp_path)).run(data)
    three = OutOfFold(forest, "id", "y", "RF", folds=3, store=str(tmp_path)).run(data)
    assert three.fitted == [0, 1, 2] and three.oof.count() == 600
    other = OutOfFold(random_forest("y", numTrees=6), "id", "y", "RF", folds=3, store=str(tmp_path)).run(data)
    assert other.fitted == [0, 1, 2]
    fewer = OutOfFold(forest, "id", "y", "RF", folds=3, store=str(tmp_path)).run(data.where("id < 500"))
    assert fewer.fitted == [0, 1, 2] and fewer.oof.count() == 500
    again = OutOfFold(forest, "id", "y", "RF", folds=3, store=str(tmp_path)).run(data)
    assert again.fitted == []
    assert sorted(map(tuple, again.importances(["signal", "noise"]).collect())) == sorted(map(tuple, three.importances(["signal", "noise"]).collect()))
    assert {r["fold"] for r in again.metrics().collect()} == {"0", "1", "2", "overall"}


def test_early_stopping_uses_the_own_fold(df):
    data = assemble(df, ["noise"])
    gbt = boosted_trees("y", maxIter=40, maxDepth=5, validationTol=0.01)
    run = OutOfFold(gbt, "id", "y", folds=2, early_stopping=True).run(data)
    assert run.oof.count() == 600 and all(m.stages[-1].getNumTrees < 40 for m in run.models.values())
    with pytest.raises(ValueError):
        OutOfFold(logistic("y"), "id", "y", early_stopping=True)


def test_search_folds_do_not_change_with_partitions(df):
    data = assemble(df, ["signal", "noise"])
    lr = logistic("y")
    maps = grid({lr.regParam: [0.0, 0.5]})
    a, b = (search(lr, maps, data.repartition(n), "y", key="id").avgMetrics for n in (1, 7))
    assert a == pytest.approx(b, abs=1e-6)
    with pytest.raises(ValueError):
        search(lr, maps, data, "y")
