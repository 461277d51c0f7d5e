"""Feature screening queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exact import float_sum_text
from ..models.training import boosted_trees, pipeline
from ..operators.screen import (
    anova_f, combined_selection, correlated_columns, correlation_pairs, distance_correlations, forest_ranks,
    independent_columns, label_correlations, lasso_ranks, permutation_importance, rank_union, scaled_ranks,
)
from .base import query, table

_LABEL = "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"
_X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
LINES_SQL = f"""lines AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
    l_extendedprice * 1.1 + l_quantity AS gross, CASE WHEN l_returnflag = 'R' THEN l_discount + 0.02 ELSE l_discount END AS lift, {_LABEL} AS y FROM lineitem)"""
FEATURES = [*_X, "gross", "lift"]


def lines(spark, d):
    """Line items with a planted signal (``lift``) and a planted near-copy (``gross``)."""
    y = F.col("l_returnflag") == "R"
    return table(spark, d, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("l_linenumber").cast("double").alias("l_linenumber"),
        (F.col("l_extendedprice") * 1.1 + F.col("l_quantity")).alias("gross"),
        F.when(y, F.col("l_discount") + 0.02).otherwise(F.col("l_discount")).alias("lift"),
        F.when(y, 1).otherwise(0).alias("y"),
    )


def customers(spark, d):
    """Customers with order statistics; a negative balance is the class, ``hint`` carries signal.

    The mean is of a sum that no order of rows changes: a rerun must know its rows again by their digest.
    """
    total = F.expr(float_sum_text("o_totalprice"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).cast("double").alias("orders"), F.try_divide(total, F.count("o_totalprice")).alias("price_mean"),
        F.max("o_totalprice").alias("price_max"),
    )
    c = table(spark, d, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("double").alias("nation"),
        (F.col("c_acctbal") / 1000 + F.col("c_custkey") % 7).alias("hint"), "c_mktsegment",
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("TARGET"),
    )
    return c.join(o, "c_custkey", "left").na.fill(0.0, ["orders", "price_mean", "price_max"])


CUSTOMER_X = ["nation", "hint", "orders", "price_mean", "price_max"]


@query(
    "f1_label_correlation",
    f"WITH {LINES_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, y) AS importance FROM lines" for c in FEATURES),
)
def f1(spark, d):
    return label_correlations(lines(spark, d), FEATURES, "y")


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]


@query(
    "f2_correlation_pairs",
    f"WITH {LINES_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lines" for a, b in _PAIRS),
)
def f2(spark, d):
    return correlation_pairs(lines(spark, d), FEATURES)


@query(
    "f3_correlated_feature_pruning",
    f"WITH {LINES_SQL} SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, lift, y FROM lines "
    "WHERE (SELECT corr(l_extendedprice, gross) > 0.97 FROM lines)",
)
def f3(spark, d):
    df = lines(spark, d)
    return df.drop(*correlated_columns(df, FEATURES))


def _dcor_sql(c: str) -> str:
    """Distance correlation with a 0/1 label by its pair sums, over value counts."""
    return f"""(WITH v AS (SELECT {c} AS x, y, CAST(count(*) AS DOUBLE) AS k FROM lines GROUP BY {c}, y),
    a AS (SELECT x, sum(k) AS k FROM v GROUP BY x),
    ra AS (SELECT x, sum(k) OVER w AS r, sum(k * x) OVER w AS p FROM a WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
    rc AS (SELECT x, y, k, sum(k) OVER w AS r, sum(k * x) OVER w AS p FROM v WINDOW w AS (PARTITION BY y ORDER BY x ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT sum(k) AS n, sum(k * x) AS s, sum(k * x * x) AS xx, sum(k * y) AS n1 FROM v),
    tc AS (SELECT y, sum(k) AS nc, sum(k * x) AS sc FROM v GROUP BY y),
    d AS (SELECT rc.k, n, s, xx, n1, rc.x * (2 * ra.r - n) + s - 2 * ra.p AS a, rc.x * (2 * rc.r - nc) + sc - 2 * rc.p AS w,
        CASE WHEN rc.y = 1 THEN n - n1 ELSE n1 END AS b FROM rc JOIN ra ON rc.x = ra.x JOIN tc ON rc.y = tc.y CROSS JOIN t),
    g AS (SELECT any_value(n) AS n, any_value(s) AS s, any_value(xx) AS xx, sum(k * a) AS a, sum(k * a * a) AS aa, sum(k * a * b) AS ab,
        sum(k * b) AS b, sum(k * b * b) AS bb, sum(k * (a - w)) AS c FROM d),
    m AS (SELECT c / n ** 2 - 2 * ab / n ** 3 + a * b / n ** 4 AS cov, (2 * n * xx - 2 * s * s) / n ** 2 - 2 * aa / n ** 3 + a * a / n ** 4 AS vx,
        b / n ** 2 - 2 * bb / n ** 3 + b * b / n ** 4 AS vy FROM g)
    SELECT '{c}' AS feature, CASE WHEN vx <= 0 OR vy <= 0 THEN 0 ELSE sqrt(greatest(cov, 0) / sqrt(vx * vy)) END AS importance FROM m)"""


@query(
    "f4_distance_correlation",
    f"WITH {LINES_SQL} " + " UNION ALL ".join(_dcor_sql(c) for c in FEATURES),
)
def f4(spark, d):
    return distance_correlations(lines(spark, d), FEATURES, "y")


def _anova_sql(c: str) -> str:
    return f"""(WITH g AS (SELECT y, CAST(count({c}) AS DOUBLE) AS n, avg({c}) AS m, var_pop({c}) * count({c}) AS q FROM lines GROUP BY y),
    o AS (SELECT avg({c}) AS mu FROM lines)
    SELECT '{c}' AS feature, (sum(n * (m - mu) ** 2) / (count(*) - 1)) / (sum(q) / (sum(n) - count(*))) AS importance FROM g, o)"""


@query("f5_anova_f", f"WITH {LINES_SQL} " + " UNION ALL ".join(_anova_sql(c) for c in FEATURES))
def f5(spark, d):
    return anova_f(lines(spark, d), FEATURES, "y")


@query("f6_lasso_importance")
def f6(spark, d):
    return lasso_ranks(lines(spark, d), FEATURES, "y", [1e-4, 1e-3, 1e-2])


@query("f7_forest_importance")
def f7(spark, d):
    return forest_ranks(customers(spark, d), CUSTOMER_X, "TARGET")


@query("f8_boosted_importance")
def f8(spark, d):
    from ..models.training import OutOfFold, assemble

    df = assemble(customers(spark, d), CUSTOMER_X)
    run = OutOfFold(boosted_trees("TARGET", maxIter=10, maxDepth=3), "c_custkey", "TARGET", folds=3).run(df)
    return scaled_ranks(run.importances(CUSTOMER_X))


_SELECT_K = 3


def selected(spark, d) -> list[str]:
    df = lines(spark, d)
    absolute = label_correlations(df, FEATURES, "y").withColumn("importance", F.abs("importance"))
    dcor = distance_correlations(df, FEATURES, "y")
    return combined_selection(
        [absolute, anova_f(df, FEATURES, "y"), dcor], _SELECT_K, independent_columns(dcor), add=["l_tax"], remove=["gross"]
    )


def _top_names(sql: str, name: str) -> str:
    return f"{name} AS (SELECT feature FROM ({sql}) ORDER BY importance DESC, feature LIMIT {_SELECT_K})"


_SELECTION_SQL = (
    f"WITH {LINES_SQL}, "
    + _top_names(" UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, y)) AS importance FROM lines" for c in FEATURES), "a")
    + ", "
    + _top_names(" UNION ALL ".join(_anova_sql(c) for c in FEATURES), "b")
    + ", "
    + f"dc AS ({' UNION ALL '.join(_dcor_sql(c) for c in FEATURES)}), "
    + _top_names("SELECT * FROM dc", "c")
    + " SELECT feature FROM ((SELECT feature FROM a UNION SELECT feature FROM b UNION SELECT feature FROM c)"
    " EXCEPT SELECT feature FROM dc WHERE importance = 0) WHERE feature <> 'gross' UNION SELECT 'l_tax'"
)


@query("f9_combined_selection", _SELECTION_SQL)
def f9(spark, d):
    return spark.createDataFrame([(n,) for n in selected(spark, d)], "feature string")


@query("f9_all_rankings", f"""WITH {LINES_SQL} {" UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, y) AS importance, 'correlation' AS ranking FROM lines" for c in FEATURES)}
    UNION ALL SELECT feature, importance, 'anova' FROM ({' UNION ALL '.join(_anova_sql(c) for c in FEATURES)})""")
def f9b(spark, d):
    df = lines(spark, d)
    return rank_union({"correlation": label_correlations(df, FEATURES, "y"), "anova": anova_f(df, FEATURES, "y")})


@query(
    "f10_project_to_selected",
    "SELECT l_quantity, l_discount, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem",
)
def f10(spark, d):
    from ..sources.files import select_names

    return select_names(lines(spark, d), ["l_quantity", "l_discount", "not_there"], ["y"])


@query("f11_permutation_importance")
def f11(spark, d):
    df = customers(spark, d)
    model = pipeline(CUSTOMER_X, boosted_trees("TARGET", maxIter=10, maxDepth=3)).fit(df)
    return permutation_importance(model, df.select("c_custkey", "TARGET", *CUSTOMER_X), CUSTOMER_X, "c_custkey", "TARGET")


# --- what is exact of the learners' rankings: every feature once, scaled to [0, 1] with both ends taken -----------------


def _scaled_sql(features) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, true AS scaled" for c in features)


def _scaled(ranks):
    ends = F.collect_set("importance").over(Window.partitionBy())  # a row per feature
    return ranks.select("feature", (F.col("importance").between(0, 1) & F.array_contains(ends, 0.0) & F.array_contains(ends, 1.0)).alias("scaled"))


@query("f6_lasso_features", _scaled_sql(FEATURES))
def f6_rows(spark, d):
    return _scaled(f6(spark, d))


@query("f7_forest_features", _scaled_sql(CUSTOMER_X))
def f7_rows(spark, d):
    return _scaled(f7(spark, d))


@query("f8_boosted_features", _scaled_sql(CUSTOMER_X))
def f8_rows(spark, d):
    return _scaled(f8(spark, d))


@query("f11_permuted_features", " UNION ALL ".join(f"SELECT '{c}' AS feature, true AS bounded" for c in CUSTOMER_X))
def f11_rows(spark, d):
    """Each feature once; what is lost or won of an area under the curve is at most 1."""
    return f11(spark, d).select("feature", F.col("importance").between(-1, 1).alias("bounded"))
