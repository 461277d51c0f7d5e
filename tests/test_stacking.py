"""Two levels of models: no row is scored by a model that saw its label."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featherfold.models.metrics import auc_value
from featherfold.models.stacking import first_level, stacked, stacked_once
from featherfold.models.training import decision_tree, hold_out, logistic, random_forest


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(11)
    n = 900
    y = (rng.random(n) < 0.4).astype(int)
    rows = pd.DataFrame({"id": np.arange(n), "y": y, "a": y + rng.normal(size=n), "b": y + rng.normal(size=n), "noise": rng.normal(size=n)})
    df = spark.createDataFrame(rows).withColumn("noise", F.when(F.col("id") % 50 != 0, F.col("noise")))
    train, test = hold_out(df, "id", 0.75)
    return train.cache(), test.cache()


X = ["a", "b", "noise"]


def test_second_level_learns_and_scores_test_rows_once(frames):
    train, test = frames
    models = {"RF": random_forest("y", numTrees=8, maxDepth=4), "LR": logistic("y")}
    one, two = first_level(train, test.drop("y"), X, "id", "y", models, folds=3)
    assert one.count() == train.count() and two.count() == test.count()
    assert one.where("RF IS NULL OR LR IS NULL").isEmpty() and two.where("RF IS NULL OR LR IS NULL").isEmpty()
    run = stacked(one, two, [*X, "RF", "LR"], "id", "y", random_forest("y", numTrees=8, maxDepth=4), folds=3)
    line = stacked_once(one, two, ["RF", "LR"], "id", "y", (lr := logistic("y")), {lr.regParam: [0.0, 0.1]})
    tree = stacked_once(one, two, ["RF", "LR"], "id", "y", decision_tree("y", maxDepth=3), name="tree")
    for scores, name in ((run.test, "stacked"), (line, "stacked"), (tree, "tree")):
        joined = test.select("id", "y").join(scores, "id")
        assert joined.count() == test.count() == scores.count()
        assert auc_value(joined, name, "y") > 0.75
    assert run.oof.count() == train.count()


def test_labels_without_signal_gain_nothing_from_the_first_level(frames):
    """Scores out of fold don't carry a row's own label into the second level."""
    train, test = frames
    blind = train.withColumn("y", (F.xxhash64("id", F.lit("blind")) % 2 == 0).cast("int"))
    deep = {"RF": random_forest("y", numTrees=8, maxDepth=10, minInstancesPerNode=1)}
    one, _ = first_level(blind, test.drop("y"), X, "id", "y", deep, folds=3)
    assert abs(auc_value(one, "RF", "y") - 0.5) < 0.1


def test_model_named_as_a_column_is_refused(frames):
    train, test = frames
    with pytest.raises(ValueError):
        first_level(train, test, X, "id", "y", {"noise": logistic("y")})
