"""Lasso path on fold moments, permutation scores and exact neighbours against plain solvers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featherfold.models import neighbours
from featherfold.models.neighbours import nearest, pivot_count
from featherfold.operators.gram import fold_moments, held_error, lasso_fit, lasso_path
from featherfold.operators.screen import permutation_importance

COLUMNS = ["a", "b", "c", "d", "flat"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 1500
    x = rng.standard_normal((n, 4)) * [1, 10, 0.1, 1] + [1e6, 0, 5, -3]
    y = 2 * (x[:, 0] - 1e6) + 0.3 * x[:, 1] + 0.1 * rng.standard_normal(n)
    rows = [(int(i % 3), *map(float, r), 7.0, float(v)) for i, (r, v) in enumerate(zip(x, y))]
    rows[5] = (*rows[5][:2], None, *rows[5][3:])
    return spark.createDataFrame(rows, "fold int, a double, b double, c double, d double, flat double, y double").repartition(6)


def plain(table):
    p = table.toPandas().fillna(0.0)
    return p["fold"].to_numpy(), p[COLUMNS].to_numpy(), p["y"].to_numpy()


def test_moments_do_not_lose_precision(table):
    fold, x, y = plain(table)
    got = fold_moments(table, [*COLUMNS, "y"], F.col("fold"))
    assert set(got) == {0, 1, 2}
    for f, m in got.items():
        z = np.column_stack([x, y])[fold == f]
        off = z - z.mean(axis=0)
        assert m.n == len(z) and np.allclose(m.mean, z.mean(axis=0), rtol=1e-12) and np.allclose(m.cross, off.T @ off, rtol=1e-9, atol=1e-6)


def slow_lasso(x, y, penalty):
    """Proximal gradient steps on the standardised columns."""
    dev = x.std(axis=0, ddof=1)
    live = dev > 0
    z = (x[:, live] - x[:, live].mean(axis=0)) / dev[live]
    t, w = y - y.mean(), np.zeros(live.sum())
    step = 1 / np.linalg.eigvalsh(z.T @ z / len(z))[-1]
    for _ in range(5000):
        w = w + step * (z.T @ (t - z @ w)) / len(z)
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
    out = np.zeros(x.shape[1])
    out[live] = w / dev[live]
    return out


def test_lasso_path_equals_a_plain_solver(table):
    fold, x, y = plain(table)
    penalties = [1e-3, 0.05, 1.0, 100.0]
    w, best, errors = lasso_path(table, COLUMNS, "y", penalties, F.col("fold"))
    want = {}
    for p in penalties:
        fits = [(f, slow_lasso(x[fold != f], y[fold != f], p)) for f in range(3)]
        want[p] = np.mean([
            np.mean((y[fold == f] - y[fold != f].mean() - (x[fold == f] - x[fold != f].mean(axis=0)) @ v) ** 2) for f, v in fits
        ])
        assert errors[p] == pytest.approx(want[p], rel=1e-6)
    assert best == min(want, key=want.get)
    assert np.allclose(w, slow_lasso(x, y, best), rtol=1e-5, atol=1e-8) and w[4] == 0
    total = fold_moments(table, [*COLUMNS, "y"])[0]
    assert (lasso_fit(total, 100.0) == 0).all() and held_error(total, total, np.zeros(5)) == pytest.approx(y.var())


def test_lasso_reads_the_rows_once(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    lasso_path(df.mapInArrow(count, df.schema), COLUMNS, "y", [0.1, 1.0, 10.0], F.col("fold"))
    assert read.value == df.count()


def test_lasso_of_an_empty_table(table):
    w, _, _ = lasso_path(table.limit(0), COLUMNS, "y", [0.1], F.col("fold"))
    assert (w == 0).all()


def test_permutation_scores_take_one_pass(spark):
    from pyspark.ml import PipelineModel

    from featherfold.models.training import logistic, pipeline

    rng = np.random.default_rng(1)
    rows = [(i, float(v), float(u), int(v + 0.3 * e > 0)) for i, (v, u, e) in enumerate(rng.standard_normal((600, 3)))]
    df = spark.createDataFrame(rows, "id long, x double, noise double, y int")
    model: PipelineModel = pipeline(["x", "noise"], logistic("y")).fit(df)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    found = permutation_importance(model, df.mapInArrow(count, df.schema), ["x", "noise"], "id", "y")
    one = {r["feature"]: r["importance"] for r in found.collect()}
    scans = read.value // 600
    assert set(one) == {"x", "noise"} and one["x"] > 0.3 and abs(one["noise"]) < 0.05
    read2 = spark.sparkContext.accumulator(0)

    def count2(batches):
        for b in batches:
            read2.add(b.num_rows)
            yield b

    permutation_importance(model, df.mapInArrow(count2, df.schema), ["x"], "id", "y").collect()
    assert read2.value // 600 == scans  # scans do not grow with the features


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(4, n // 100), 6)) * 50
    return centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, 6))


@pytest.mark.parametrize("pivots", [1, None, 300])
def test_nearest_with_ties_and_folds(spark, pivots):
    x = clustered(500)
    x[:60] = x[0]  # many equal rows
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, v array<double>, fold int")
    got = nearest(df, df, "id", "v", k=5, pivots=pivots, block_rows=64, not_same="fold").toPandas()
    for i in range(0, 500, 7):
        d = sorted((np.sqrt(((x[j] - x[i]) ** 2).sum()), j) for j in range(500) if j % 3 != i % 3)[:5]
        mine = got[got["query"] == i].sort_values(["distance", "neighbour"])
        assert mine["neighbour"].tolist() == [j for _, j in d]


def test_nearest_with_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 1.0])], "id long, v array<double>")
    assert nearest(df, df, "id", "v", k=10).count() == 4
    assert nearest(df.limit(0), df, "id", "v").count() == 0


def test_rows_sent_to_cells_grow_less_than_quadratically(spark, monkeypatch):
    sent = {}
    inner = neighbours._compare

    def counted(left, right, k, block_rows):
        sizes = {r["cell"]: r["n"] for r in left.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        sent[n] = sent.get(n, 0) + sum(sizes.get(r["cell"], 0) * r["n"] for r in right.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect())
        return inner(left, right, k, block_rows)

    monkeypatch.setattr(neighbours, "_compare", counted)
    for n in (1000, 4000):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(n))], "id long, v array<double>")
        nearest(df, df, "id", "v", k=5).collect()
    assert sent[4000] < 8 * sent[1000] and sent[4000] < 0.2 * 4000 * 4000  # pairs that are compared: 16 times if all were
    assert pivot_count(10**12) == neighbours.MOST_PIVOTS and pivot_count(0) == 1
