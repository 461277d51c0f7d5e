"""Neighbours in rounds: no row per query and cell is stored, and the rounds together are exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featherfold.models import neighbours
from featherfold.models.neighbours import nearest


def frame(spark, x, groups=3, kind="float"):
    return spark.createDataFrame([(i, v.tolist(), i % groups) for i, v in enumerate(x)], f"id long, v array<{kind}>, fold int")


@pytest.fixture
def stored(monkeypatch):
    held, inner = {}, neighbours._stored

    def keep(df, name):
        held.setdefault(name, []).append(inner(df, name))
        return held[name][-1]

    monkeypatch.setattr(neighbours, "_stored", keep)
    return held


def test_no_vector_is_stored_per_cell(spark, stored):
    x = np.random.default_rng(0).uniform(size=(900, 16))  # every query reaches most of the 30 cells
    df = frame(spark, x)
    nearest(df, df, "id", "v", k=5).collect()
    for name, frames in stored.items():
        for f in frames:
            assert f.count() <= 900 * (1 if "vec" in f.columns else 5), name


def test_queries_reach_few_cells_of_clustered_rows(spark, stored):
    compared = {}
    for n in (1000, 4000):
        rng = np.random.default_rng(0)
        centres = rng.standard_normal((max(4, n // 100), 6)) * 50
        df = frame(spark, centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, 6)), kind="double")
        stored.clear()
        nearest(df, df, "id", "v", k=5)
        sizes = np.zeros(2048)
        for r in stored["neighbours-rows"][0].groupBy("cell").count().collect():
            sizes[r["cell"]] = r["count"]
        for r in stored["neighbours-asked"][0].select("cells").collect():
            bits = np.unpackbits(np.frombuffer(r["cells"], dtype=np.uint8))
            compared[n] = compared.get(n, 0) + sizes[:len(bits)][bits.astype(bool)].sum()
    assert compared[4000] < 8 * compared[1000] and compared[4000] < 0.2 * 4000 * 4000


@pytest.mark.parametrize("most", [None, 40, 7])
def test_rounds_together_are_exact(spark, monkeypatch, most):
    rng = np.random.default_rng(5)
    x = np.float32(rng.integers(0, 4, (300, 3)) + 1000.0)  # many ties, far from zero
    x[100:180] = x[100]  # a cell of several blocks and slices
    if most:
        monkeypatch.setattr(neighbours, "ROUND_BYTES", most * (8 * 3 + 24))
    df = frame(spark, x)
    got = nearest(df, df, "id", "v", k=4, block_rows=32, not_same="fold").toPandas()
    for i in range(300):
        want = sorted((np.sqrt(((x[j].astype(float) - x[i]) ** 2).sum()), j) for j in range(300) if j % 3 != i % 3)[:4]
        mine = got[got["query"] == i].sort_values(["distance", "neighbour"])
        assert list(zip(mine["distance"], mine["neighbour"])) == want


def test_rounds_cover_each_row_once():
    sizes = np.array([3, 0, 25, 4, 4, 4, 0])
    rounds = neighbours._rounds(sizes, 10)
    assert rounds == [(0, 1, 0, 1), (2, 2, 0, 3), (2, 2, 1, 3), (2, 2, 2, 3), (3, 4, 0, 1), (5, 6, 0, 1)]


def test_no_queries_and_missing_ids(spark):
    df = frame(spark, np.arange(40.0).reshape(20, 2))
    assert nearest(df, df.limit(0), "id", "v", k=3).count() == 0
    odd = df.withColumn("id", F.when(F.col("id") != 4, F.col("id")))
    found = nearest(odd, odd, "id", "v", k=3).collect()
    assert len(found) == 60 and sum(r["query"] is None for r in found) == 3 and any(r["neighbour"] is None for r in found)
