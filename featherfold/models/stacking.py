"""Two levels of models: out-of-fold scores of the first are features of the second, for train and test rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator
from pyspark.sql import DataFrame

from .training import FEATURES, OutOfFold, assemble, grid, positive_score, search, stored_rows, training_rows


def first_level(
    train: DataFrame, test: DataFrame, features: Sequence[str], key: str, label: str, models: Mapping[str, Estimator],
    folds: int = 5, seed: int = 250, store: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with a score column per model, joined by the id ``key``, which is unique in each.

    A train row has the score of the fold model that was not fitted on it, a test row the mean over the fold
    models.  Columns of ``train`` that a model's name would repeat are refused.  Both frames are read once and
    come back stored, so that a second level neither joins nor scores again for each of its passes.
    """
    clash = set(models) & set(train.columns)
    if clash:
        raise ValueError(f"models named as columns: {sorted(clash)}")
    train, test = stored_rows(train, "level-train"), stored_rows(test, "level-test")
    data = assemble(train, features).select(key, label, FEATURES)
    held = assemble(test, features).select(key, FEATURES)
    for name, learner in models.items():
        run = OutOfFold(learner, key, label, name, folds, seed, store).run(data, held)
        train = train.join(run.oof.select(key, name), key, "left")
        test = test.join(run.test.select(key, name), key, "left")
    return stored_rows(train, "level-train"), stored_rows(test, "level-test")


def stacked(
    train: DataFrame, test: DataFrame, columns: Sequence[str], key: str, label: str, learner: Estimator,
    name: str = "stacked", folds: int = 5, seed: int = 250, early_stopping: bool = False,
) -> OutOfFold:
    """A second-level learner on ``columns`` (features, scores of the first level, or both): out of fold for
    train rows, as the mean over the fold models for test rows."""
    run = OutOfFold(learner, key, label, name, folds, seed, early_stopping=early_stopping)
    return run.run(assemble(train, columns).select(key, label, FEATURES), assemble(test, columns).select(key, FEATURES))


def stacked_once(
    train: DataFrame, test: DataFrame, columns: Sequence[str], key: str, label: str, learner: Estimator,
    space: Mapping | None = None, name: str = "stacked", folds: int = 3,
) -> DataFrame:
    """(key, name) of the test rows by one second-level model fitted on all train rows.

    With ``space`` (parameter to values) the parameters are those of the best mean AUC over folds of the train rows.
    """
    data = assemble(train, columns).select(key, label, FEATURES)
    if space:
        model = search(learner, grid(space), data, label, folds=folds, key=key).bestModel
    else:
        with training_rows(data) as rows:
            model = learner.fit(rows)
    return positive_score(model.transform(assemble(test, columns)), name).select(key, name)
