"""Fold, metric, learner, stacking and blending queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..models.blending import best_weights, blend, penalty_sweep, score_weights, weight_vectors
from ..models.metrics import auc, fold_metrics
from ..models.neighbours import neighbour_share
from ..models.stacking import first_level, stacked, stacked_once
from ..models.training import (
    OutOfFold, assemble, boosted_trees, class_weights, decision_tree, grid, hold_out, logistic, normalised_importances,
    perceptron, pipeline, positive_score, random_forest, random_maps, search, search_table, stored_rows,
    winner_auc, with_fold,
)
from ..operators.clean import Standardizer
from ..operators.combine import join_scores
from ..operators.screen import mean_importance
from ..plans.fixed import BLEND_WEIGHTS
from ..session import shared_dir
from ..sources.files import write_csv
from .base import bucket_sql, query, table
from .ordering import SCORES_SQL, model_scores
from .screening import CUSTOMER_X, LINES_SQL, customers, lines

TRIALS = 32  # fixed value: parameter maps that a search tries
MODELS = list(BLEND_WEIGHTS)
KEY, LABEL = "c_custkey", "TARGET"


@query(
    "m1_assemble_features",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity AS v0, l_discount AS v1, CASE WHEN l_tax > 0.02 THEN l_tax ELSE 0 END AS v2 FROM lineitem",
)
def m1(spark, d):
    df = table(spark, d, "lineitem").withColumn("tax", F.when(F.col("l_tax") > 0.02, F.col("l_tax")))
    v = vector_to_array("features")
    return assemble(df, ["l_quantity", "l_discount", "tax"]).select(
        "l_orderkey", "l_partkey", "l_suppkey", *[v[i].alias(f"v{i}") for i in range(3)]
    )


@query("m4_boosted_tree_pipeline")
def m4(spark, d):
    df = customers(spark, d)
    train, test = hold_out(df, KEY, 0.7)
    model = pipeline(CUSTOMER_X, boosted_trees(LABEL, maxBins=64), ["c_mktsegment"]).fit(train)
    return positive_score(model.transform(test)).select(KEY, LABEL, "score")


def _auc_sql(source: str, score: str, label: str, key: str = "1") -> str:
    return f"""(WITH r AS (SELECT {key} AS k, {label} AS y, rank() OVER (PARTITION BY {key} ORDER BY {score})
        + (count(*) OVER (PARTITION BY {key}, {score}) - 1) / 2e0 AS r FROM {source} WHERE {score} IS NOT NULL),
    s AS (SELECT k, sum(r) FILTER (WHERE y = 1) AS rs, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS p,
        CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS n FROM r GROUP BY k)
    SELECT k, (rs - p * (p + 1) / 2) / (p * n) AS auc FROM s)"""


@query("m5_auc", f"WITH {LINES_SQL} SELECT auc FROM {_auc_sql('lines', 'lift', 'y')}")
def m5(spark, d):
    return auc(lines(spark, d), "lift", "y")


@query("m5_auc_per_key", f"WITH {LINES_SQL} SELECT k AS l_linenumber, auc FROM {_auc_sql('lines', 'l_extendedprice', 'y', 'l_linenumber')}")
def m5b(spark, d):
    return auc(lines(spark, d), "l_extendedprice", "y", ["l_linenumber"])


@query("m6_out_of_fold_scores")
def m6(spark, d):
    df = assemble(customers(spark, d), CUSTOMER_X)
    return OutOfFold(boosted_trees(LABEL, maxIter=10, maxDepth=3), KEY, LABEL, "LGB").run(df).oof


@query("m6_test_scores_fold_mean")
def m6b(spark, d):
    train, test = hold_out(assemble(customers(spark, d), CUSTOMER_X), KEY, 0.75)
    return OutOfFold(boosted_trees(LABEL, maxIter=10, maxDepth=3), KEY, LABEL, "score", folds=3).run(train, test.drop(LABEL)).test


@query("m7_resumable_out_of_fold")
def m7(spark, d):
    store = shared_dir(spark, "oof-state")
    df = assemble(customers(spark, d), CUSTOMER_X)
    train, test = hold_out(df, KEY, 0.75)
    forest = random_forest(LABEL, numTrees=20)
    OutOfFold(forest, KEY, LABEL, "RF", folds=3, store=store).run(train, test)
    again = OutOfFold(forest, KEY, LABEL, "RF", folds=3, store=store).run(train, test)
    if again.fitted:
        raise RuntimeError("finished folds were fitted again")
    return again.oof.select(KEY, "fold", LABEL, "RF")


_SCORED = f"""scored AS (SELECT c_custkey, {bucket_sql('c_custkey', 4, 250)} AS fold, (c_acctbal + 1000) / 12000 + (c_custkey % 13) / 10e0 AS s,
    CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS y FROM customer)"""


@query(
    "m8_fold_metrics",
    f"""WITH {_SCORED}, v AS (SELECT * FROM {_auc_sql('scored', 's', 'y', 'fold')}), w AS (SELECT * FROM {_auc_sql('scored', 's', 'y')}),
    other AS (SELECT CAST(f AS INTEGER) AS fold, s, y FROM scored JOIN range(4) r(f) ON fold <> f), t AS (SELECT * FROM {_auc_sql('other', 's', 'y', 'fold')})
    SELECT CAST(v.k AS VARCHAR) AS fold, t.auc AS train, v.auc AS valid FROM v JOIN t ON v.k = t.k
    UNION ALL SELECT 'overall', (SELECT avg(auc) FROM t), (SELECT auc FROM w)""",
)
def m8(spark, d):
    s = (F.col("c_acctbal") + 1000) / 12000 + F.col("c_custkey") % 13 / 10
    df = with_fold(table(spark, d, "customer"), KEY, 4, 250).select(
        "fold", s.alias("s"), F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("y")
    )
    fitted_on = df.withColumn("fold", F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(3)), F.col("fold"))))
    return fold_metrics(df, fitted_on, "s", "y")


@query(
    "m9_mean_importance",
    """WITH t AS (SELECT p_brand AS feature, p_type, avg(p_size) AS importance FROM part GROUP BY p_brand, p_type),
    m AS (SELECT feature, avg(importance) AS importance FROM t GROUP BY feature)
    SELECT feature, importance, importance / sum(importance) OVER () AS importance_normalized FROM m""",
)
def m9(spark, d):
    """One table of importances per part type, all types, in one scan."""
    per_type = table(spark, d, "part").groupBy("p_type", F.col("p_brand").alias("feature")).agg(F.avg("p_size").alias("importance"))
    return normalised_importances(mean_importance([per_type.select("feature", "importance")]))


@query("m9_fold_model_importance")
def m9b(spark, d):
    """Mean importances of real fold models, sorted, with their shares."""
    df = assemble(customers(spark, d), CUSTOMER_X)
    run = OutOfFold(random_forest(LABEL, numTrees=40, maxDepth=5), KEY, LABEL, "RF").run(df)
    return normalised_importances(run.importances(CUSTOMER_X))


_FOLD_OF_CUSTOMER = f"SELECT c_custkey, {bucket_sql('c_custkey', 5, 250)} AS fold, true AS inside FROM customer"


@query("m6_early_stopped_folds", _FOLD_OF_CUSTOMER)
def m6c(spark, d):
    """Each fold stops on its own held-out rows: every id once, its fold, its score inside [0, 1]."""
    df = assemble(customers(spark, d), CUSTOMER_X)
    gbt = boosted_trees(LABEL, maxIter=20, maxDepth=3, validationTol=0.001)
    run = OutOfFold(gbt, KEY, LABEL, "LGB", early_stopping=True).run(df)
    return run.oof.select(KEY, "fold", F.col("LGB").between(0, 1).alias("inside"))


@query("m7_store_keeps_runs_apart", _FOLD_OF_CUSTOMER)
def m7b(spark, d):
    """Five folds after three in one store: all rows of the five come back, none of the three."""
    store = shared_dir(spark, "oof-runs")
    df = assemble(customers(spark, d), CUSTOMER_X)
    forest = random_forest(LABEL, numTrees=10)
    OutOfFold(forest, KEY, LABEL, "RF", folds=3, store=store).run(df)
    run = OutOfFold(forest, KEY, LABEL, "RF", folds=5, store=store).run(df)
    return run.oof.select(KEY, "fold", F.col("RF").between(0, 1).alias("inside"))


@query("m10_early_stopping")
def m10(spark, d):
    df = assemble(with_fold(customers(spark, d), KEY, 4), CUSTOMER_X).withColumn("held", F.col("fold") == 0)
    gbt = boosted_trees(LABEL, maxIter=40, maxDepth=3, validationTol=0.001).setValidationIndicatorCol("held")
    model = gbt.fit(df)
    return positive_score(model.transform(df)).select(KEY, "score")


@query("m11_random_forest_scores")
def m11(spark, d):
    df = assemble(customers(spark, d), CUSTOMER_X)
    return OutOfFold(random_forest(LABEL), KEY, LABEL, "RF").run(df).oof


@query("m11_perceptron_scores")
def m11b(spark, d):
    df = customers(spark, d)
    df = assemble(Standardizer.fit(df, CUSTOMER_X).transform(df), CUSTOMER_X)
    # a pass over the rows ends with its slowest task, and a fit takes hundreds of passes: other folds fill the idle cores
    return OutOfFold(perceptron(LABEL, len(CUSTOMER_X)), KEY, LABEL, "MLP", parallelism=5).run(df).oof


@query(
    "m12_neighbour_share",
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN label < 3 THEN 1 ELSE 0 END AS y, {bucket_sql('vec_id', 5, 50)} AS fold FROM embeddings),
    p AS (SELECT a.vec_id, b.y, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rn
    FROM e a JOIN e b ON a.fold <> b.fold) SELECT vec_id, avg(y) AS score FROM p WHERE rn <= 10 GROUP BY vec_id""",
)
def m12(spark, d):
    e = with_fold(table(spark, d, "embeddings"), "vec_id", 5).withColumn("y", F.when(F.col("label") < 3, 1).otherwise(0))
    return neighbour_share(e, e, "vec_id", "embedding", "y", 10, not_same="fold")


_BLEND = " + ".join(f"{w!r} * \"{m}\"" for m, w in BLEND_WEIGHTS.items())


@query("m13_weighted_blend", f"WITH {SCORES_SQL} SELECT c_custkey, CAST({_BLEND} AS DOUBLE) AS \"TARGET\" FROM scores")
def m13(spark, d):
    joined = join_scores(model_scores(spark, d), KEY, table(spark, d, "customer").select(KEY))
    return blend(joined, BLEND_WEIGHTS).select(KEY, "TARGET")


_VECTORS = weight_vectors(["LGB", "XG", "RF"], 20, seed=7)


def labelled_scores(spark, d):
    label = table(spark, d, "customer").select(KEY, F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("y"))
    s = model_scores(spark, d)
    return join_scores({m: s[m] for m in ("LGB", "XG", "RF")}, KEY, label)


_LABELS = "l AS (SELECT s.*, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS y FROM scores s JOIN customer USING (c_custkey))"
_VECTOR_ROWS = ", ".join(f"({i}, {v['LGB']!r}::DOUBLE, {v['XG']!r}::DOUBLE, {v['RF']!r}::DOUBLE)" for i, v in enumerate(_VECTORS))


@query(
    "m14_blend_weight_search",
    f"""WITH {SCORES_SQL}, {_LABELS}, w(vector, a, b, c) AS (VALUES {_VECTOR_ROWS}),
    m AS (SELECT vector, y, 0e0 + "LGB" * a + "XG" * b + "RF" * c AS s FROM l CROSS JOIN w)
    SELECT CAST(k AS INTEGER) AS vector, 1 - auc AS loss FROM {_auc_sql('m', 's', 'y', 'vector')}""",
)
def m14(spark, d):
    return score_weights(labelled_scores(spark, d), "y", _VECTORS)


@query(
    "m14_best_blend",
    f"""WITH {SCORES_SQL}, {_LABELS}, w(vector, a, b, c) AS (VALUES {_VECTOR_ROWS}),
    m AS (SELECT vector, y, 0e0 + "LGB" * a + "XG" * b + "RF" * c AS s FROM l CROSS JOIN w),
    best AS (SELECT k FROM {_auc_sql('m', 's', 'y', 'vector')} ORDER BY 1 - auc, k LIMIT 1)
    SELECT c_custkey, 0e0 + "LGB" * a + "XG" * b + "RF" * c AS score FROM scores, w, best WHERE vector = k""",
)
def m14b(spark, d):
    scores = labelled_scores(spark, d)
    return blend(scores, best_weights(scores, "y", _VECTORS), "score").select(KEY, "score")


@query("m15_stacked_features_and_scores")
def m15(spark, d):
    first = assemble(customers(spark, d), CUSTOMER_X)
    rf = OutOfFold(random_forest(LABEL, numTrees=20, maxDepth=4), KEY, LABEL, "RF", folds=3).run(first).oof
    both = customers(spark, d).join(rf.select(KEY, "RF"), KEY, "left")
    second = assemble(both, [*CUSTOMER_X, "RF"])
    return OutOfFold(boosted_trees(LABEL, maxIter=5, maxDepth=3), KEY, LABEL, "stacked", folds=3).run(second).oof


@query("m16_stacked_logistic")
def m16(spark, d):
    data = assemble(labelled_scores(spark, d), ["LGB", "XG", "RF"])
    lr = logistic("y")
    model = search(lr, grid({lr.regParam: [0.0, 0.01, 0.1]}), data, "y", folds=3, key=KEY)
    return positive_score(model.bestModel.transform(data)).select(KEY, "score")


@query("m16_stacked_decision_tree")
def m16b(spark, d):
    """Every row is scored by a tree that was not fitted on it."""
    data = assemble(labelled_scores(spark, d), ["LGB", "XG", "RF"])
    return OutOfFold(decision_tree("y", maxDepth=5), KEY, "y", "score").run(data).oof.select(KEY, "fold", "score")


def _two_levels(spark, d):
    """Train and test rows of the customers with out-of-fold scores of two first-level models."""
    train, test = hold_out(customers(spark, d), KEY, 0.75)
    models = {"RF": random_forest(LABEL, numTrees=50), "LR": logistic(LABEL, regParam=0.01)}
    return first_level(train, test.drop(LABEL), CUSTOMER_X, KEY, LABEL, models, folds=3)


@query("m15_stacked_test_scores")
def m15c(spark, d):
    """Rows that neither level was fitted on, scored by boosted trees over features and first-level scores."""
    learner = boosted_trees(LABEL, maxIter=40, maxDepth=3, validationTol=0.001)
    return stacked(*_two_levels(spark, d), [*CUSTOMER_X, "RF", "LR"], KEY, LABEL, learner, folds=3, early_stopping=True).test


@query("m16_stacked_test_scores")
def m16c(spark, d):
    """Rows that neither level was fitted on, scored from first-level scores alone."""
    train, test = _two_levels(spark, d)
    lr = logistic(LABEL)
    line = stacked_once(train, test, ["RF", "LR"], KEY, LABEL, lr, {lr.regParam: [0.0, 0.01, 0.1]}, "logistic")
    return line.join(stacked_once(train, test, ["RF", "LR"], KEY, LABEL, decision_tree(LABEL, maxDepth=5), name="tree"), KEY)


STRENGTHS = [0.0001, 0.001, 0.01, 0.1, 1, 10, 100, 1000]  # fixed values


@query("m17_penalty_sweep")
def m17(spark, d):
    train, test = hold_out(labelled_scores(spark, d), KEY, 0.75)
    return penalty_sweep(train, test, ["LGB", "XG", "RF"], "y", STRENGTHS)


@query("m18_parameter_search")
def m18(spark, d):
    data = assemble(with_fold(customers(spark, d), KEY, 2), CUSTOMER_X)
    gbt = boosted_trees(LABEL, maxIter=5)
    maps = random_maps({gbt.maxDepth: [2, 3, 4], gbt.stepSize: lambda r: round(0.05 + 0.3 * r.random(), 3)}, TRIALS)
    return search_table(search(gbt, maps, data, LABEL, folds=2), spark, maps)


@query("m18_winner_on_hold_out")
def m18b(spark, d):
    """Trials on the train rows, and the winner's AUC on rows that no trial saw."""
    train, held = hold_out(stored_rows(assemble(customers(spark, d), CUSTOMER_X)), KEY, 0.75)
    gbt = boosted_trees(LABEL, maxIter=5)
    maps = random_maps({gbt.maxDepth: [2, 3, 4], gbt.stepSize: lambda r: round(0.05 + 0.3 * r.random(), 3)}, TRIALS)
    found = search(gbt, maps, train, LABEL, folds=3, key=KEY)
    best = search_table(found, spark, maps).limit(1)  # the winner alone
    return best.withColumn("held_auc", F.lit(winner_auc(found, held, LABEL)).cast("double"))


@query(
    "m19_submission",
    f"WITH {SCORES_SQL} SELECT c_custkey AS \"SK_ID_CURR\", printf('%.8f', (\"LGB\" + \"XG\" + \"RF\") / 3) AS \"TARGET\" FROM scores",
)
def m19(spark, d):
    path = shared_dir(spark, "submission")
    s = labelled_scores(spark, d).select(F.col(KEY).alias("SK_ID_CURR"), ((F.col("LGB") + F.col("XG") + F.col("RF")) / 3).alias("TARGET"))
    write_csv(s, path, "%.8f")
    return spark.read.option("header", True).schema("SK_ID_CURR bigint, TARGET string").csv(path)


@query(
    "m20_class_weights",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS y FROM customer),
    n AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(y) AS p FROM c)
    SELECT c_custkey, y, CASE WHEN y = 1 THEN n / (2 * p) ELSE n / (2 * (n - p)) END AS weight,
    CASE WHEN y = 1 THEN 5e0 ELSE 1e0 END AS scaled FROM c, n""",
)
def m20(spark, d):
    df = table(spark, d, "customer").select(KEY, F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("y"))
    return class_weights(class_weights(df, "y"), "y", 5, "scaled")


# --- what is exact of the learners' results: every row once, its fold, its score inside [0, 1] -------------------


def _inside(df, score: str, *keep: str):
    return df.select(*keep, F.col(score).between(0, 1).alias("inside"))


def _folds_sql(folds: int, rows: str = "customer") -> str:
    return f"SELECT c_custkey, {bucket_sql('c_custkey', folds, 250)} AS fold, true AS inside FROM {rows}"


_HELD = f"{bucket_sql('c_custkey', 1000, 666)} >= "


@query("m4_scores_of_held_rows", f"SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS \"TARGET\", true AS inside FROM customer WHERE {_HELD} 700")
def m4_rows(spark, d):
    """The pipeline scores the rows that it was not fitted on, and those alone."""
    return _inside(m4(spark, d), "score", KEY, LABEL)


@query("m10_scores_of_all_rows", "SELECT c_custkey, true AS inside FROM customer")
def m10_rows(spark, d):
    return _inside(m10(spark, d), "score", KEY)


@query("m11_forest_folds", _folds_sql(5))
def m11_rows(spark, d):
    return _inside(m11(spark, d), "RF", KEY, "fold")


@query("m11_perceptron_folds", _folds_sql(5))
def m11b_rows(spark, d):
    return _inside(m11b(spark, d), "MLP", KEY, "fold")


@query("m15_stacked_folds", _folds_sql(3))
def m15_rows(spark, d):
    return _inside(m15(spark, d), "stacked", KEY, "fold")


@query("m16_tree_folds", f"WITH {SCORES_SQL} {_folds_sql(5, 'scores')}")
def m16_rows(spark, d):
    return _inside(m16b(spark, d), "score", KEY, "fold")


@query("m16_logistic_rows", f"WITH {SCORES_SQL} SELECT c_custkey, true AS inside FROM scores")
def m16b_rows(spark, d):
    return _inside(m16(spark, d), "score", KEY)


_TEST_ROWS = f"SELECT c_custkey, true AS inside FROM customer WHERE {_HELD} 750"


@query("m15_stacked_test_rows", _TEST_ROWS)
def m15c_rows(spark, d):
    """Each held row has a second-level score, and no other row has one."""
    return _inside(m15c(spark, d), "stacked", KEY)


@query("m16_stacked_test_rows", _TEST_ROWS)
def m16c_rows(spark, d):
    both = F.col("logistic").between(0, 1) & F.col("tree").between(0, 1)
    return m16c(spark, d).select(KEY, both.alias("inside"))


@query("m18_trials", f"SELECT CAST(i AS INTEGER) AS trial, true AS inside FROM range({TRIALS}) t(i)")
def m18_rows(spark, d):
    """Each trial of the search is told once, with an area under the curve in [0, 1]."""
    return _inside(m18(spark, d), "auc", "trial")


@query(
    "m17_penalties",
    f"SELECT CAST(c AS DOUBLE) AS c, true AS inside, true AS normalised FROM (SELECT unnest([{', '.join(f'{float(c)!r}::DOUBLE' for c in STRENGTHS)}]) AS c)",
)
def m17_rows(spark, d):
    """Each penalty once, with an area under the curve in [0, 1] and coefficients that sum to 1."""
    total = F.abs(F.col("LGB") + F.col("XG") + F.col("RF") - 1) < 1e-9
    return m17(spark, d).select("c", F.col("auc").between(0, 1).alias("inside"), total.alias("normalised"))
