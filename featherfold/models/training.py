"""Fitting: folds, hold-outs, learners, out-of-fold scores, tuning."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param
from pyspark.ml.tuning import CrossValidator
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions.scalar import as_col, hash_bucket
from ..session import shared_dir
from .metrics import auc_value, fold_metrics

FEATURES = "features"
ROWS_PER_TASK = 1_000_000  # of a fit, where that asks for more tasks than the cores do


def feature_names(df: DataFrame, skip: Sequence[str]) -> list[str]:
    """Feature columns by name: everything but ids, label and other listed columns."""
    return [c for c in df.columns if c not in set(skip)]


def assemble(df: DataFrame, features: Sequence[str], missing: float = 0.0) -> DataFrame:
    """Add the ``features`` vector; missing values become ``missing``."""
    filled = df.withColumns({f: F.coalesce(as_col(f).cast("double"), F.lit(missing)) for f in features})
    stage = VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="keep")
    return stage.transform(filled)


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="keep")


def category_indexers(columns: Sequence[str]) -> list[StringIndexer]:
    """Index text columns; unseen and missing values share the last index."""
    return [
        StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep", stringOrderType="alphabetAsc")
        for c in columns
    ]


def with_fold(df: DataFrame, key: str, folds: int, seed: int = 50, name: str = "fold") -> DataFrame:
    """Seeded fold number of each id: the same on every run, split and cluster size."""
    return df.withColumn(name, hash_bucket([key], folds, seed))


def hold_out(df: DataFrame, key: str, share: float, seed: int = 666) -> tuple[DataFrame, DataFrame]:
    """(train, test): about ``share`` of the ids train, by hash in steps of 1/1000."""
    bucket = hash_bucket([key], 1000, seed)
    cut = round(share * 1000)
    return df.where(bucket < cut), df.where(bucket >= cut)


def positive_score(df: DataFrame, name: str = "score") -> DataFrame:
    return df.withColumn(name, vector_to_array("probability")[1])


def stored_rows(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` written once to shared storage and read back.

    What is fitted and scored several times is then neither read nor joined again, and tasks over it carry the
    metrics of a scan, not those of the whole plan that made it.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def training_rows(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` cached for fits, in a few tasks a core.

    A learner runs several stages for each round, level or step, and each task of them sends its statistics on.
    Their number therefore follows the cores and, beyond a million rows each, the rows, but not the shuffle that the
    frame comes from.  The cache is filled by that shuffle's own tasks and its parts are read together, so no row moves.
    """
    data = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = data.count()
        yield data.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))
    finally:
        data.unpersist()


# --- learners -------------------------------------------------------------------


def boosted_trees(label: str, **params) -> GBTClassifier:
    # fixed values: row and column shares of the workload's boosted trees; rounds, step and depth are own defaults
    return GBTClassifier(labelCol=label, featuresCol=FEATURES, **{
        "maxIter": 100, "stepSize": 0.1, "maxDepth": 5, "subsamplingRate": 0.87,
        "featureSubsetStrategy": "0.66", "seed": 50, **params,
    })


def random_forest(label: str, **params) -> RandomForestClassifier:
    # fixed values: tree count and depth of the importance forest
    return RandomForestClassifier(labelCol=label, featuresCol=FEATURES, **{
        "numTrees": 250, "maxDepth": 6, "minInstancesPerNode": 15, "seed": 50, **params,
    })


def perceptron(label: str, inputs: int, hidden: Sequence[int] = (300,), **params) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(
        labelCol=label, featuresCol=FEATURES, layers=[inputs, *hidden, 2], **{"maxIter": 200, "seed": 50, **params}
    )


def logistic(label: str, **params) -> LogisticRegression:
    return LogisticRegression(labelCol=label, featuresCol=FEATURES, **params)


def decision_tree(label: str, **params) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(labelCol=label, featuresCol=FEATURES, **{"seed": 50, **params})


def class_weights(df: DataFrame, label: str, positive: float | None = None, name: str = "weight") -> DataFrame:
    """Row weights: ``n / (2 * class size)``, or a constant for the positive class."""
    y = as_col(label).cast("int")
    if positive is not None:
        return df.withColumn(name, F.when(y == 1, F.lit(float(positive))).otherwise(F.lit(1.0)))
    n, ones = df.agg(F.count(y), F.sum(y)).collect()[0]
    ones = ones or 0
    weights = {1: n / (2 * ones) if ones else 0.0, 0: n / (2 * (n - ones)) if n > ones else 0.0}
    return df.withColumn(name, F.when(y == 1, F.lit(weights[1])).otherwise(F.lit(weights[0])))


# --- out of fold ------------------------------------------------------------------


def _described(stage: Estimator) -> list:
    """Class and parameters of an estimator, without its random name."""
    if isinstance(stage, Pipeline):
        return [_described(s) for s in stage.getStages()]
    values = {p.name: str(v).replace(stage.uid, "") for p, v in stage.extractParamMap().items()}
    return [type(stage).__name__, sorted(values.items())]


def _identity(df: DataFrame) -> list:
    """Columns, row count and an order-free digest of a frame's rows."""
    values = [vector_to_array(as_col(f.name)) if isinstance(f.dataType, VectorUDT) else as_col(f.name) for f in df.schema.fields]
    total = F.sum(F.xxhash64(*values).cast("decimal(38,0)"))
    return [df.dtypes, *[str(v) for v in df.agg(F.count(F.lit(1)), total).first()]]


MANIFEST = "run string, fold int, parts string"


class OutOfFold:
    """K-fold scores of a learner: every train id once, test ids averaged over folds.

    ``parallelism`` folds are fitted at a time, as concurrent jobs over one cached frame.

    With ``store`` (a folder in shared storage) each fold's model and scores are written as
    ``model=<name>/run=<digest>/fold=<i>`` and a rerun skips the folds that the table ``manifest`` tells as complete.  The digest
    covers folds, seed, parameters, columns and rows, so a run never meets the folds of another one;
    finding it reads both frames once.  ``metrics`` and ``importances`` cover finished folds as well,
    as their models are read back.  Without a store the results stay lazy over the fitted models.

    ``early_stopping`` hands each fold's own rows to the learner as validation rows (learners with a
    ``validationIndicatorCol``), so that a fold stops when its held-out loss no longer falls.
    """

    def __init__(
        self, estimator: Estimator, key: str, label: str, name: str = "score", folds: int = 5, seed: int = 250,
        store: str | None = None, early_stopping: bool = False, parallelism: int = 2,
    ):
        self.estimator, self.key, self.label, self.name, self.parallelism = estimator, key, label, name, parallelism
        self.folds, self.seed, self.store, self.early_stopping = folds, seed, store, early_stopping
        if early_stopping and not estimator.hasParam("validationIndicatorCol"):
            raise ValueError("this learner takes no validation rows")
        self.models: dict[int, PipelineModel] = {}
        self.fitted: list[int] = []

    def _finished(self, spark: SparkSession, parts: str) -> set[int]:
        """Folds of this run that the store's manifest tells as complete with ``parts``."""
        try:
            rows = spark.read.schema(MANIFEST).parquet(f"{self.store}/manifest")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return set()
            raise
        own = rows.where((F.col("run") == self._run) & (F.col("parts") == parts))
        return {r["fold"] for r in own.select("fold").distinct().collect()}

    def _base(self, train: DataFrame, test: DataFrame | None) -> str:
        told = [
            self.key, self.label, self.folds, self.seed, self.early_stopping, _described(self.estimator),
            _identity(train), None if test is None else _identity(test),
        ]
        return f"{self.store}/model={self.name}/run={hashlib.md5(repr(told).encode()).hexdigest()}"

    def _scored(self, model, df: DataFrame, *keep: Column | str) -> DataFrame:
        return positive_score(model.transform(df), self.name).select(self.key, *keep, self.name)

    def _fit(self, data: DataFrame, fold: int) -> PipelineModel:
        if self.early_stopping:
            learner = self.estimator.copy({self.estimator.validationIndicatorCol: "__held"})
            model = learner.fit(data.withColumn("__held", F.col("fold") == fold))
        else:
            model = self.estimator.fit(data.where(F.col("fold") != fold))
        return model if isinstance(model, PipelineModel) else PipelineModel([model])

    def run(self, train: DataFrame, test: DataFrame | None = None) -> "OutOfFold":
        """Both frames carry a ``features`` column (see :func:`assemble`)."""
        spark = train.sparkSession
        self._run = self._base(train, test) if self.store else None
        rows = with_fold(train, self.key, self.folds, self.seed)
        parts = "oof" if test is None else "oof, test"
        finished = self._finished(spark, parts) if self._run else set()
        for i in sorted(finished):
            self.models[i] = PipelineModel.load(f"{self._run}/fold={i}/model")
        todo = [i for i in range(self.folds) if i not in finished]
        if todo:
            rows = stored_rows(rows, "fold-rows")
            try:
                with training_rows(rows) as data, ThreadPoolExecutor(max(1, self.parallelism)) as pool:

                    def one(i: int) -> PipelineModel:
                        model = self._fit(data, i)
                        if self._run:
                            base = f"{self._run}/fold={i}"
                            model.write().overwrite().save(f"{base}/model")
                            oof = self._scored(model, data.where(F.col("fold") == i), "fold", self.label)
                            oof.write.mode("overwrite").parquet(f"{base}/part=oof")
                            if test is not None:
                                self._scored(model, test).write.mode("overwrite").parquet(f"{base}/part=test")
                        return model

                    # folds are jobs of their own over one cached frame; each thread keeps the caller's job properties
                    jobs = {pool.submit(inheritable_thread_target(spark)(one), i): i for i in todo}
                    for job in as_completed(jobs):
                        i = jobs[job]
                        self.models[i] = job.result()
                        self.fitted.append(i)
                        if self._run:  # told by this thread alone, once all of the fold is there
                            done = spark.range(1).select(F.lit(self._run).alias("run"), F.lit(i).alias("fold"), F.lit(parts).alias("parts"))
                            done.write.mode("append").parquet(f"{self.store}/manifest")
            finally:
                self.fitted.sort()
        self._train = rows
        self.oof = self._oof_scores(spark, rows)
        self.test = None if test is None else self._test_scores(spark, test)
        return self

    def _paths(self, part: str) -> list[str]:
        return [f"{self._run}/fold={i}/part={part}" for i in range(self.folds)]

    def _all_scores(self, df: DataFrame) -> DataFrame:
        """``df`` with one score column ``__s<i>`` per fold model: one pass over the rows."""
        made = ["rawPrediction", "probability", "prediction"]
        for i in range(self.folds):
            before = set(df.columns)
            scored = positive_score(self.models[i].transform(df), f"__s{i}")
            df = scored.drop(*made, *[c for c in scored.columns if c not in before and not c.startswith("__s")])
        return df

    def _oof_scores(self, spark: SparkSession, data: DataFrame) -> DataFrame:
        if self._run:
            return spark.read.parquet(*self._paths("oof"))
        own = F.coalesce(*[F.when(F.col("fold") == i, F.col(f"__s{i}")) for i in range(self.folds)])
        return self._all_scores(data).select(self.key, "fold", self.label, own.alias(self.name))

    def _test_scores(self, spark: SparkSession, test: DataFrame) -> DataFrame:
        if self._run:
            rows = spark.read.parquet(*self._paths("test"))
            return rows.groupBy(self.key).agg(F.avg(self.name).alias(self.name))
        # one score column per fold on the same rows, so the average needs no shuffle
        columns = [F.col(f"__s{i}") for i in range(self.folds)]
        return self._all_scores(test).select(self.key, (sum(columns[1:], columns[0]) / len(columns)).alias(self.name))

    def metrics(self) -> DataFrame:
        """(fold, train, valid) AUCs with an overall row, over all folds."""
        others = F.array(*[F.struct(F.lit(i).alias("__model"), F.col(f"__s{i}").alias(self.name)) for i in range(self.folds)])
        rows = self._all_scores(self._train).select("fold", self.label, F.inline(others))
        fitted_on = rows.where(F.col("fold") != F.col("__model")).select(F.col("__model").alias("fold"), self.label, self.name)
        return fold_metrics(self.oof, fitted_on, self.name, self.label)

    def importances(self, features: Sequence[str]) -> DataFrame:
        """(feature, importance): mean of all fold models' importances."""
        spark = self.oof.sparkSession
        rows = []
        for _, model in sorted(self.models.items()):
            rows += [(f, float(v)) for f, v in zip(features, model.stages[-1].featureImportances.toArray())]
        table = spark.createDataFrame(rows, "feature string, importance double")
        return table.groupBy("feature").agg(F.avg("importance").alias("importance"))


def normalised_importances(table: DataFrame) -> DataFrame:
    """Add each feature's share of the total and sort; the table has one row per feature."""
    from pyspark.sql import Window

    share = F.try_divide(F.col("importance"), F.sum("importance").over(Window.partitionBy()))
    return table.withColumn("importance_normalized", share).orderBy(F.desc("importance"), "feature")


# --- tuning -------------------------------------------------------------------------


def random_maps(space: Mapping[Param, Callable[[random.Random], object] | Sequence], n: int, seed: int = 0) -> list[dict]:
    """Seeded random parameter maps: a list draws one of its items, a function draws freely."""
    rng = random.Random(seed)
    return [{p: (d(rng) if callable(d) else rng.choice(list(d))) for p, d in space.items()} for _ in range(n)]


def grid(space: Mapping[Param, Sequence]) -> list[dict]:
    out: list[dict] = [{}]
    for p, values in space.items():
        out = [{**m, p: v} for m in out for v in values]
    return out


def search(
    estimator: Estimator, maps: Sequence[dict], train: DataFrame, label: str, folds: int = 3, seed: int = 0,
    parallelism: int = 8, key: str | None = None,
):
    """Cross-validated choice among parameter maps by AUC.

    Folds are the column ``fold`` if present, else a seeded hash of the id column ``key``: never random
    rows, so the choice does not change with the partitioning.
    """
    if "fold" not in train.columns:
        if key is None:
            raise ValueError("give a fold column or the id column to make one from")
        train = with_fold(train, key, folds, seed)
    cv = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=list(maps),
        evaluator=BinaryClassificationEvaluator(labelCol=label, numBins=0),
        numFolds=folds,
        seed=seed,
        parallelism=parallelism,
        foldCol="fold",
    )
    with training_rows(train) as data:
        return cv.fit(data)


def winner_auc(cv_model, held: DataFrame, label: str) -> float | None:
    """Exact AUC of the search's best model on rows that the search never saw."""
    return auc_value(positive_score(cv_model.bestModel.transform(held), "__score"), "__score", label)


def search_table(cv_model, spark: SparkSession, maps: Sequence[dict]) -> DataFrame:
    """(trial, params, auc), best first: one row per trial."""
    rows = [
        (i, ", ".join(f"{p.name}={v}" for p, v in m.items()), float(a))
        for i, (m, a) in enumerate(zip(maps, cv_model.avgMetrics))
    ]
    return spark.createDataFrame(rows, "trial int, params string, auc double").orderBy(F.desc("auc"), "trial")


def pipeline(features: Sequence[str], learner: Estimator, categories: Sequence[str] = ()) -> Pipeline:
    """Index text columns, assemble, fit: one pipeline from named columns to scores."""
    inputs = [*features, *[f"{c}_index" for c in categories]]
    return Pipeline(stages=[*category_indexers(categories), assembler(inputs), learner])
