"""Scans, sinks, profiles and column selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import hash_bucket
from ..models.training import hold_out, with_fold
from ..operators.clean import align_columns, columns_like, normalise_types
from ..operators.combine import map_tables, stack_splits
from ..operators.profile import (
    class_ratio, describe, histogram, mostly_null_columns, null_ratios, single_value_columns, text_columns,
    two_value_columns, useless_columns, value_counts,
)
from ..plans.starmap import columns_of
from ..session import shared_dir
from ..sources.files import (
    gather_csv_scores, gather_scores, load_names, read_csv, read_parquet, save_names, select_names, write_csv,
    write_parquet, write_scores,
)
from .base import bucket_sql, credit, credit_sql, names_sql, q, query, table

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("a1_csv_scan_schema", _ORDERS)
def a1(spark, d):
    path = shared_dir(spark, "orders-csv")
    orders = table(spark, d, "orders").select(*_ORDER_COLUMNS)
    write_csv(orders.withColumn("Unnamed: 0", F.monotonically_increasing_id()), path)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string, `Unnamed: 0` bigint"
    return read_csv(spark, path, schema)


@query("a2_csv_scan_inferred", _ORDERS)
def a2(spark, d):
    path = shared_dir(spark, "orders-csv")
    write_csv(table(spark, d, "orders").select(*_ORDER_COLUMNS), path)
    df = read_csv(spark, path)
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("o_orderkey", "o_custkey")})


@query(
    "a3_csv_sink_float_format",
    "SELECT c_custkey, printf('%.8f', c_acctbal / 7) AS score FROM customer",
)
def a3(spark, d):
    path = shared_dir(spark, "submission")
    write_csv(table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 7).alias("score")), path, "%.8f")
    return spark.read.option("header", True).schema("c_custkey bigint, score string").csv(path)


_SPLIT = f"{bucket_sql('c_custkey', 1000, 666)} < 750"


@query(
    "a4_stack_train_test",
    f"""SELECT c_custkey, c_acctbal, CASE WHEN {_SPLIT} THEN 'train' ELSE 'test' END AS "set",
        CASE WHEN {_SPLIT} THEN (CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) END AS "TARGET" FROM customer""",
)
def a4(spark, d):
    df = table(spark, d, "customer").select(
        "c_custkey", "c_acctbal", F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("TARGET")
    )
    train, test = hold_out(df, "c_custkey", 0.75)
    return stack_splits(train, test, "TARGET")


@query(
    "a5_table_batch",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST({n} AS INTEGER) AS column_count FROM {t}"
        for t, n in (("customer", 5), ("supplier", 4), ("part", 6))
    ),
)
def a5(spark, d):
    tables = {n: table(spark, d, n) for n in ("customer", "supplier", "part")}
    counts = map_tables(
        tables, lambda df: df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("column_count"))
    )
    out = None
    for n, df in counts.items():
        part = df.select(F.lit(n).alias("table_name"), "row_count", "column_count")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "a6_saved_folds_and_names",
    f"SELECT {bucket_sql('c_custkey', 5, 50)} AS fold, c_custkey, c_acctbal FROM customer",
)
def a6(spark, d):
    data, names = shared_dir(spark, "folds"), shared_dir(spark, "names")
    write_parquet(with_fold(table(spark, d, "customer"), "c_custkey", 5), data, ["fold"])
    save_names(spark, ["c_acctbal", "c_custkey"], names)
    return select_names(spark.read.parquet(data), load_names(spark, names), ["fold"])


@query(
    "a7_gather_score_files",
    """SELECT c_custkey, c_acctbal / 1e4 AS "LGB", c_nationkey / 2.5e1 AS "XG", (c_custkey % 10) / 1e1 AS "RF" FROM customer""",
)
def a7(spark, d):
    path = shared_dir(spark, "oof")
    c = table(spark, d, "customer")
    scores = {"LGB": F.col("c_acctbal") / 1e4, "XG": F.col("c_nationkey") / 25.0, "RF": (F.col("c_custkey") % 10) / 10.0}
    for model, score in scores.items():
        write_csv(c.select("c_custkey", score.alias("score")), f"{path}/{model}_oof.csv")
    write_csv(c.select("c_custkey", F.lit(0.5).alias("score")), f"{path}/OLD_oof.csv")
    return gather_csv_scores(spark, path, "c_custkey", ending="oof.csv", without=["OLD"])


@query(
    "a7_gather_score_parquet",
    """SELECT c_custkey, c_acctbal / 1e4 AS "LGB", c_nationkey / 2.5e1 AS "XG" FROM customer""",
)
def a7b(spark, d):
    path = shared_dir(spark, "scores")
    c = table(spark, d, "customer")
    for model, score in {"LGB": F.col("c_acctbal") / 1e4, "XG": F.col("c_nationkey") / 25.0}.items():
        write_scores(c.select("c_custkey", score.alias("score")), path, model, "oof")
        write_scores(c.select("c_custkey", (score * 2).alias("score")), path, model, "test")
    return gather_scores(spark, path, "c_custkey", ["LGB", "XG"], "oof")


@query(
    "a8_null_ratios",
    f"WITH {credit_sql('application')} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) - count({q(c)}) AS DOUBLE) / count(*) AS null_ratio FROM application"
        for c in columns_of("application")
    ),
)
def a8(spark, d):
    return null_ratios(credit(spark, d, "application"))


_KEPT = [c for c in columns_of("previous") if c not in ("RATE_INTEREST_PRIMARY", "RATE_INTEREST_PRIVILEGED")]


@query("a9_drop_mostly_null", f"WITH {credit_sql('previous')} SELECT {names_sql(_KEPT)} FROM previous")
def a9(spark, d):
    df = credit(spark, d, "previous")
    return df.drop(*mostly_null_columns(df, 0.9))


def _distinct_sql(source: str, columns, test: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column" FROM {source} HAVING count(DISTINCT {q(c)})
            + (CASE WHEN count(*) > count({q(c)}) THEN 1 ELSE 0 END) {test}"""
        for c in columns
    )


@query(
    "a10_two_value_columns",
    f"WITH {credit_sql('bureau')} " + _distinct_sql("bureau", columns_of("bureau"), "= 2"),
)
def a10(spark, d):
    return spark.createDataFrame(
        [(c,) for c in two_value_columns(credit(spark, d, "bureau"))], "column string"
    )


def _with_constants(df):
    return df.withColumns({"ONE": F.lit(1), "NONE": F.lit(None).cast("double"), "HALF": F.when(F.col("SK_ID_CURR") % 2 == 0, 1)})


@query(
    "a11_single_value_columns",
    f"WITH {credit_sql('application')}, t AS (SELECT *, 1 AS \"ONE\", CAST(NULL AS DOUBLE) AS \"NONE\","
    f" CASE WHEN \"SK_ID_CURR\" % 2 = 0 THEN 1 END AS \"HALF\" FROM application) "
    + _distinct_sql("t", [*columns_of("application"), "ONE", "NONE", "HALF"], "<= 1"),
)
def a11(spark, d):
    df = _with_constants(credit(spark, d, "application"))
    return spark.createDataFrame([(c,) for c in single_value_columns(df)], "column string")


@query(
    "a12_drop_useless_columns",
    f"WITH {credit_sql('application')} SELECT {names_sql(columns_of('application'))}, "
    f"CASE WHEN \"SK_ID_CURR\" % 2 = 0 THEN 1 END AS \"HALF\" FROM application",
)
def a12(spark, d):
    train, test = hold_out(_with_constants(credit(spark, d, "application")), "SK_ID_CURR", 0.75)
    gone = useless_columns(train, keep=("SK_ID_CURR", "TARGET"))
    return train.drop(*gone).unionByName(test.drop(*gone))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "a13_describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
        quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max
        FROM lineitem"""
        for c in _MEASURES
    ),
)
def a13(spark, d):
    return describe(table(spark, d, "lineitem"), _MEASURES)


@query("a14_value_counts", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY o_orderpriority")
def a14(spark, d):
    return value_counts(table(spark, d, "orders"), "o_orderpriority")


@query(
    "a14_class_ratio",
    "SELECT CAST(count(*) FILTER (WHERE c_acctbal < 0) AS DOUBLE) / count(*) FILTER (WHERE c_acctbal >= 0) AS ratio FROM customer",
)
def a14b(spark, d):
    return class_ratio(credit(spark, d, "application"), "TARGET")


_BINS = 10


@query(
    "a15_histogram",
    f"""WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / {_BINS} AS w FROM orders),
    b AS (SELECT CAST(least(floor((o_totalprice - lo) / w), {_BINS - 1}) AS INTEGER) AS bucket FROM orders, e),
    n AS (SELECT bucket, count(*) AS n FROM b GROUP BY bucket)
    SELECT CAST(i AS INTEGER) AS bucket, lo + i * w AS low, lo + (i + 1) * w AS high, coalesce(n.n, 0) AS count
    FROM range({_BINS}) r(i) CROSS JOIN e LEFT JOIN n ON n.bucket = i""",
)
def a15(spark, d):
    return histogram(table(spark, d, "orders"), "o_totalprice", _BINS)


@query(
    "a16_align_columns",
    f"WITH {credit_sql('bureau', 'previous')} SELECT \"SK_ID_CURR\", \"AMT_ANNUITY\", \"CREDIT_DAY_OVERDUE\" FROM bureau",
)
def a16(spark, d):
    left, _ = align_columns(credit(spark, d, "bureau"), credit(spark, d, "previous"), "CREDIT_DAY_OVERDUE")
    return left


@query(
    "a17_columns_by_pattern",
    f"WITH {credit_sql('application')} SELECT "
    + names_sql([c for c in columns_of("application") if "FLAG_DOC" in c])
    + ", \"ORGANIZATION_TYPE\", \"NAME_EDUCATION_TYPE\", \"OCCUPATION_TYPE\", \"CODE_GENDER\" FROM application",
)
def a17(spark, d):
    df = credit(spark, d, "application")
    return df.select(*columns_like(df, contains="FLAG_DOC"), *text_columns(df))


@query(
    "a18_drop_columns",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem",
)
def a18(spark, d):
    df = read_parquet(spark, f"{d.rstrip('/')}/lineitem.parquet")
    return df.drop("l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query(
    "a19_normalise_types",
    f"""WITH {credit_sql('application')} SELECT coalesce("SK_ID_CURR", 0) AS "SK_ID_CURR", CAST("TARGET" AS BOOLEAN) AS "TARGET",
    CAST("AMT_CREDIT" AS FLOAT) AS "AMT_CREDIT", "CNT_CHILDREN", CAST("FLAG_EMAIL" AS BOOLEAN) AS "FLAG_EMAIL",
    "CODE_GENDER" FROM application""",
)
def a19(spark, d):
    df = credit(spark, d, "application")
    df = df.select("SK_ID_CURR", "TARGET", "AMT_CREDIT", "CNT_CHILDREN", "FLAG_EMAIL", "CODE_GENDER")
    return normalise_types(df, ["SK_ID_CURR"])


@query("a20_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def a20(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query(
    "a21_drop_rows_with_nulls",
    f"""WITH {credit_sql('application')} SELECT "SK_ID_CURR", "EXT_SOURCE_1", "EXT_SOURCE_3", "OWN_CAR_AGE" FROM application
    WHERE "EXT_SOURCE_1" IS NOT NULL AND "EXT_SOURCE_3" IS NOT NULL AND "OWN_CAR_AGE" IS NOT NULL""",
)
def a21(spark, d):
    df = credit(spark, d, "application")
    return df.select("SK_ID_CURR", "EXT_SOURCE_1", "EXT_SOURCE_3", "OWN_CAR_AGE").na.drop()


@query(
    "m2_hold_out_split",
    f"SELECT c_custkey, {_SPLIT} AS in_train FROM customer",
)
def m2(spark, d):
    df = table(spark, d, "customer").select("c_custkey")
    train, test = hold_out(df, "c_custkey", 0.75)
    return train.withColumn("in_train", F.lit(True)).unionByName(test.withColumn("in_train", F.lit(False)))


@query("m3_fold_assignment", f"SELECT o_orderkey, {bucket_sql('o_orderkey', 5, 250)} AS fold FROM orders")
def m3(spark, d):
    return table(spark, d, "orders").select("o_orderkey", hash_bucket(["o_orderkey"], 5, 250).alias("fold"))
