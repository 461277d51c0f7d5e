"""Rows that are fitted and scored several times are read and joined once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featherfold.models.stacking import first_level
from featherfold.models.training import OutOfFold, assemble, hold_out, logistic, search, stored_rows


@pytest.fixture
def rows(spark):
    """(frame, counter): the counter adds one for each row each time that the frame is made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        made.add(1)
        return x

    rng = np.random.default_rng(5)
    data = [(i, float(x), int(x > 0)) for i, x in enumerate(rng.standard_normal(200))]
    df = spark.createDataFrame(data, "id long, x double, y int").repartition(3, "id")
    return df.withColumn("x", seen("x")), made


def test_stored_rows_come_back_whole(spark):
    df = spark.createDataFrame([(1, None, 0.5), (1, "a", None), (None, "b", 1.0)], "id long, s string, x double")
    back = stored_rows(assemble(df, ["x"]))
    assert back.dtypes == assemble(df, ["x"]).dtypes
    assert sorted(map(str, back.collect())) == sorted(map(str, assemble(df, ["x"]).collect()))


def test_folds_are_fitted_and_scored_on_rows_made_once(rows):
    df, made = rows
    run = OutOfFold(logistic("y"), "id", "y", folds=3).run(assemble(df, ["x"]))
    assert run.oof.count() == 200 and run.oof.where("score IS NULL").isEmpty()
    run.metrics().collect()
    assert made.value == 200


def test_both_levels_read_their_rows_once(rows):
    df, made = rows
    train, test = hold_out(df, "id", 0.7)
    one, two = first_level(train, test.drop("y"), ["x"], "id", "y", {"A": logistic("y"), "B": logistic("y", regParam=0.1)}, folds=2)
    for frame in (one, two):
        frame.agg(F.sum("A"), F.sum("B")).collect()
        assert "Join" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert one.count() + two.count() == 200
    assert made.value == 200


def test_a_search_over_stored_rows_does_not_make_them_again(rows):
    df, made = rows
    train, held = hold_out(stored_rows(assemble(df, ["x"])), "id", 0.7)
    lr = logistic("y")
    found = search(lr, [{lr.regParam: 0.0}, {lr.regParam: 0.1}], train, "y", folds=2, key="id")
    assert len(found.avgMetrics) == 2 and found.bestModel.transform(held).count() == held.count()
    assert made.value == 200
