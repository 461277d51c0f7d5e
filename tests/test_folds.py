"""Folds as concurrent jobs, and what a store knows after a fold has failed."""

import threading

import numpy as np
import pytest

from featherfold.models.training import OutOfFold, assemble, logistic
from featherfold.sources.files import score_models, write_csv


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), int(x + 0.5 * e > 0)) for i, (x, e) in enumerate(rng.standard_normal((300, 2)))]
    return assemble(spark.createDataFrame(rows, "id long, x double, y int"), ["x"])


def test_folds_overlap(data, monkeypatch):
    meet, inner = threading.Barrier(2, timeout=60), OutOfFold._fit

    def both(self, frame, fold):
        meet.wait()  # passes only while another fold is being fitted
        return inner(self, frame, fold)

    monkeypatch.setattr(OutOfFold, "_fit", both)
    run = OutOfFold(logistic("y"), "id", "y", "s", folds=4, parallelism=2).run(data)
    assert run.fitted == [0, 1, 2, 3] and run.oof.count() == 300


def test_a_failed_fold_leaves_the_others_finished(spark, data, monkeypatch, tmp_path):
    inner = OutOfFold._fit

    def broken(self, frame, fold):
        if fold == 2:
            raise RuntimeError("lost")
        return inner(self, frame, fold)

    make = lambda: OutOfFold(logistic("y"), "id", "y", "s", folds=3, store=str(tmp_path), parallelism=1)
    with monkeypatch.context() as m:
        m.setattr(OutOfFold, "_fit", broken)
        with pytest.raises(RuntimeError):
            make().run(data)
    rest = make().run(data)
    assert rest.fitted == [2] and sorted(rest.models) == [0, 1, 2]
    assert rest.oof.count() == 300 and make().run(data).fitted == []
    assert make().run(data, data).fitted == [0, 1, 2]  # test scores were not there yet
    alone = {r["id"]: r["s"] for r in OutOfFold(logistic("y"), "id", "y", "s", folds=3).run(data).oof.collect()}
    assert {r["id"]: r["s"] for r in rest.oof.collect()} == pytest.approx(alone)


def test_score_folders_are_found_by_spark(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "id long, score double")
    for name in ("A", "B b", "C"):
        write_csv(df, str(tmp_path / f"{name}_oof.csv"))
    write_csv(df, str(tmp_path / "A_test.csv"))
    assert score_models(spark, str(tmp_path), "oof.csv", without=["C"]) == ["A", "B b"]
    assert score_models(spark, str(tmp_path), "none.csv") == []
