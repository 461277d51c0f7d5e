"""Filters, cleaning, encoding and outlier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.clean import (
    LabelEncoder, OneHotEncoder, abs_caps_to_null, caps_to_null, fill_missing, recode_flags, replace_infinity,
    sentinels_to_null,
)
from ..operators.combine import keep_members
from ..operators.outliers import (
    extreme_values, log_of_negatives, negative_flag_rate, outlier_report, parents_of, rows_at_extremes,
)
from ..operators.dictionary import DictionaryEncoder
from .base import credit, credit_sql, q, query, table


@query(
    "b1_row_filter",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_discount FROM lineitem
    WHERE l_returnflag = 'R' AND l_linestatus <> 'O' AND l_quantity > 25""",
)
def b1(spark, d):
    rows = table(spark, d, "lineitem").where(
        (F.col("l_returnflag") == "R") & (F.col("l_linestatus") != "O") & (F.col("l_quantity") > 25)
    )
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount")


@query(
    "b2_recent_rows",
    f"""WITH {credit_sql('bureau')} SELECT "SK_ID_BUREAU", "DAYS_CREDIT", "AMT_CREDIT_SUM" FROM bureau WHERE "DAYS_CREDIT" >= -30 * 12""",
)
def b2(spark, d):
    return credit(spark, d, "bureau").where(F.col("DAYS_CREDIT") >= -30 * 12).select(
        "SK_ID_BUREAU", "DAYS_CREDIT", "AMT_CREDIT_SUM"
    )


@query(
    "b3_membership_filter",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 4e5)""",
)
def b3(spark, d):
    big = table(spark, d, "orders").where(F.col("o_totalprice") > 4e5).select(F.col("o_custkey").alias("c_custkey"))
    return keep_members(table(spark, d, "customer").select("c_custkey", "c_name"), big, "c_custkey")


_SENTINELS = ["DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION"]


@query(
    "b4_sentinel_to_null",
    f"WITH {credit_sql('previous')} SELECT \"SK_ID_PREV\", "
    + ", ".join(f"NULLIF({q(c)}, 365243) AS {q(c)}" for c in _SENTINELS)
    + " FROM previous",
)
def b4(spark, d):
    return sentinels_to_null(credit(spark, d, "previous").select("SK_ID_PREV", *_SENTINELS), _SENTINELS, 365243)


@query(
    "b5_range_cap",
    f"""WITH {credit_sql('previous')} SELECT "SK_ID_PREV",
    CASE WHEN "DAYS_LAST_DUE" <= 36500 THEN "DAYS_LAST_DUE" END AS "DAYS_LAST_DUE",
    CASE WHEN "DAYS_DECISION" >= -1200 THEN "DAYS_DECISION" END AS "DAYS_DECISION",
    CASE WHEN abs("AMT_APPLICATION") <= 3e5 THEN "AMT_APPLICATION" END AS "AMT_APPLICATION" FROM previous""",
)
def b5(spark, d):
    df = credit(spark, d, "previous").select("SK_ID_PREV", "DAYS_LAST_DUE", "DAYS_DECISION", "AMT_APPLICATION")
    df = caps_to_null(df, {"DAYS_LAST_DUE": (None, 36500), "DAYS_DECISION": (-1200, None)})
    return abs_caps_to_null(df, {"AMT_APPLICATION": 3e5})


@query(
    "b6_fill_missing",
    f"""WITH {credit_sql('application')} SELECT "SK_ID_CURR", coalesce("EXT_SOURCE_1", 999999) AS "EXT_SOURCE_1",
    coalesce("OWN_CAR_AGE", 999999) AS "OWN_CAR_AGE", coalesce("OCCUPATION_TYPE", 'NaN') AS "OCCUPATION_TYPE" FROM application""",
)
def b6(spark, d):
    df = credit(spark, d, "application").select("SK_ID_CURR", "EXT_SOURCE_1", "OWN_CAR_AGE", "OCCUPATION_TYPE")
    return fill_missing(fill_missing(df, 999999), "NaN", ["OCCUPATION_TYPE"])


@query(
    "b7_infinity_to_constant",
    """SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_discount = 0 THEN 0e0 ELSE l_tax / l_discount END AS r FROM lineitem""",
)
def b7(spark, d):
    # raw input with infinities, as another tool may have written it
    inf = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_tax", "l_discount"))
    return replace_infinity(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", inf.alias("r")), 0.0)


@query(
    "b8_flag_recode",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS closed,
    CASE WHEN o_totalprice > 2e5 THEN 1 ELSE 0 END AS large FROM orders""",
)
def b8(spark, d):
    df = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").alias("closed"), (F.col("o_totalprice") > 2e5).alias("large")
    )
    return recode_flags(recode_flags(df, ["closed"], 1, -1), ["large"])


_FENCED = ["AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE", "CREDIT_DAY_OVERDUE", "DAYS_CREDIT", "AMT_ANNUITY"]


def _fence_sql(source: str, columns) -> str:
    return ", ".join(
        f"""f{i} AS (SELECT '{c}' AS "column", quantile_cont(CAST({q(c)} AS DOUBLE), 0.25) AS q1,
        quantile_cont(CAST({q(c)} AS DOUBLE), 0.75) AS q3 FROM {source})"""
        for i, c in enumerate(columns)
    )


@query(
    "b9_outlier_report",
    f"WITH {credit_sql('bureau')}, {_fence_sql('bureau', _FENCED)} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", min(q1 - 1.5 * (q3 - q1)) AS low, min(q3 + 1.5 * (q3 - q1)) AS high,
        count(*) FILTER (WHERE {q(c)} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
        FROM bureau, f{i} WHERE q3 > q1
        HAVING count(*) FILTER (WHERE {q(c)} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) > 0"""
        for i, c in enumerate(_FENCED)
    ),
)
def b9(spark, d):
    return outlier_report(credit(spark, d, "bureau"), _FENCED)


@query(
    "b9_outlier_screen",
    f"WITH {credit_sql('bureau')}, {_fence_sql('bureau', ['AMT_CREDIT_SUM', 'AMT_CREDIT_SUM_DEBT', 'AMT_CREDIT_SUM_OVERDUE', 'AMT_CREDIT_MAX_OVERDUE', 'AMT_CREDIT_SUM_LIMIT', 'AMT_ANNUITY'])} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column" FROM bureau, f{i} WHERE q3 > q1
        HAVING count(*) FILTER (WHERE {q(c)} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) > 0"""
        for i, c in enumerate(["AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_MAX_OVERDUE", "AMT_CREDIT_SUM_LIMIT", "AMT_ANNUITY"])
    ),
)
def b9b(spark, d):
    """All AMT_ columns go through the automatic screen first."""
    df = credit(spark, d, "bureau")
    amounts = [c for c in df.columns if c.startswith("AMT_")]
    return outlier_report(df.select(*amounts)).select("column")


_PROBED = ["DAYS_LAST_DUE", "DAYS_TERMINATION", "AMT_APPLICATION", "RATE_INTEREST_PRIMARY"]


def _extremes_sql(source: str, columns) -> str:
    parts = []
    for i, c in enumerate(columns):
        up, down = "q3 + 1.5 * (q3 - q1)", "q1 - 1.5 * (q3 - q1)"
        days = " OR ".join(f"abs({v} / 365) > 100" for v in ("hi", "lo")) if c.startswith("DAYS") else "TRUE"
        parts.append(
            f"""x{i} AS (SELECT '{c}' AS "column", CAST(max({q(c)}) FILTER (WHERE {q(c)} >= {up}) AS DOUBLE) AS hi,
            CAST(min({q(c)}) FILTER (WHERE {q(c)} <= {down}) AS DOUBLE) AS lo FROM {source}, f{i} WHERE q3 > q1),
            e{i} AS (SELECT "column", 'max' AS side, hi AS value FROM x{i} WHERE hi IS NOT NULL AND ({days})
            UNION ALL SELECT "column", 'min', lo FROM x{i} WHERE lo IS NOT NULL AND ({days}))"""
        )
    return ", ".join(parts)


@query(
    "b10_extreme_values",
    f"WITH {credit_sql('previous')}, {_fence_sql('previous', _PROBED)}, {_extremes_sql('previous', _PROBED)} "
    + " UNION ALL ".join(f"SELECT * FROM e{i}" for i in range(len(_PROBED))),
)
def b10(spark, d):
    return extreme_values(credit(spark, d, "previous"), _PROBED)


@query(
    "b10_extreme_parents",
    f"WITH {credit_sql('previous', 'application')}, {_fence_sql('previous', ['DAYS_LAST_DUE'])}, {_extremes_sql('previous', ['DAYS_LAST_DUE'])} "
    """SELECT "SK_ID_CURR", "TARGET", "AMT_INCOME_TOTAL" FROM application WHERE "SK_ID_CURR" IN
    (SELECT "SK_ID_CURR" FROM previous WHERE "DAYS_LAST_DUE" IN (SELECT value FROM e0))""",
)
def b10b(spark, d):
    prev = credit(spark, d, "previous")
    rows = rows_at_extremes(prev, "DAYS_LAST_DUE", extreme_values(prev, ["DAYS_LAST_DUE"]))
    parent = credit(spark, d, "application").select("SK_ID_CURR", "TARGET", "AMT_INCOME_TOTAL")
    return parents_of(rows, parent, "SK_ID_CURR")


@query(
    "b11_log_of_negatives",
    f"""WITH {credit_sql('previous', 'application')}, n AS (SELECT "SK_ID_CURR", ln(-("AMT_APPLICATION" - "AMT_CREDIT")) AS v
    FROM previous WHERE "AMT_APPLICATION" - "AMT_CREDIT" < 0)
    SELECT n."SK_ID_CURR" AS "SK_ID_CURR_l", v AS "APP_CREDIT_DIFF", a."TARGET", a."SK_ID_CURR" AS "SK_ID_CURR_r"
    FROM n LEFT JOIN application a ON n."SK_ID_CURR" = a."SK_ID_CURR" """,
)
def b11(spark, d):
    prev = credit(spark, d, "previous").select(
        "SK_ID_CURR", (F.col("AMT_APPLICATION") - F.col("AMT_CREDIT")).alias("APP_CREDIT_DIFF")
    )
    return log_of_negatives(prev, "APP_CREDIT_DIFF", credit(spark, d, "application"), "SK_ID_CURR", "TARGET")


@query(
    "b12_negative_flag_rate",
    f"""WITH {credit_sql('previous', 'application')}, n AS (SELECT "SK_ID_CURR", CAST(floor(("AMT_APPLICATION" - "AMT_CREDIT") / 1e3) AS BIGINT) AS v
    FROM previous WHERE "AMT_APPLICATION" - "AMT_CREDIT" < 0),
    j AS (SELECT DISTINCT a."SK_ID_CURR", v, "TARGET" FROM n RIGHT JOIN application a ON n."SK_ID_CURR" = a."SK_ID_CURR" WHERE v IS NOT NULL)
    SELECT CAST(count(*) FILTER (WHERE "TARGET" = 1) AS DOUBLE) / count(*) FILTER (WHERE "TARGET" = 0) AS ratio FROM j""",
)
def b12(spark, d):
    prev = credit(spark, d, "previous").select(
        "SK_ID_CURR", F.floor((F.col("AMT_APPLICATION") - F.col("AMT_CREDIT")) / 1e3).alias("DIFF")
    )
    return negative_flag_rate(prev, "DIFF", credit(spark, d, "application"), "SK_ID_CURR", "TARGET")


@query(
    "p14_label_encode",
    f"""WITH {credit_sql('application')} SELECT "SK_ID_CURR", CASE "CODE_GENDER" WHEN 'F' THEN 0 WHEN 'M' THEN 1 END AS "CODE_GENDER",
    CASE "NAME_EDUCATION_TYPE" WHEN 'Higher' THEN 0 WHEN 'Secondary' THEN 1 END AS "NAME_EDUCATION_TYPE", "ORGANIZATION_TYPE" FROM application""",
)
def p14(spark, d):
    df = credit(spark, d, "application").select("SK_ID_CURR", "CODE_GENDER", "NAME_EDUCATION_TYPE", "ORGANIZATION_TYPE")
    return LabelEncoder.fit(df).transform(df)


@query(
    "p15_one_hot",
    "SELECT o_orderkey, "
    + ", ".join(
        f"CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END AS \"o_orderpriority_{v}\""
        for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    )
    + ", "
    + ", ".join(f"CASE WHEN o_orderstatus = '{v}' THEN 1 ELSE 0 END AS \"o_orderstatus_{v}\"" for v in "FOP")
    + " FROM orders",
)
def p15(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return OneHotEncoder.fit(df).transform(df)


@query(
    "p15_dictionary_index",
    """WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_name END AS name, c_mktsegment FROM customer),
    n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM (SELECT DISTINCT name FROM v WHERE name IS NOT NULL)),
    m AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS i FROM (SELECT DISTINCT c_mktsegment FROM v WHERE c_mktsegment IS NOT NULL))
    SELECT c_custkey, coalesce(n.i, (SELECT count(*) FROM n)) AS name_index, coalesce(m.i, (SELECT count(*) FROM m)) AS c_mktsegment_index
    FROM v LEFT JOIN n USING (name) LEFT JOIN m USING (c_mktsegment)""",
)
def p15_dictionary(spark, d):
    """Numbers of the values of a column of as many values as rows, some missing, and of one of few."""
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")).alias("name"))
    return DictionaryEncoder.fit(df, ["name", "c_mktsegment"]).index(df).select("c_custkey", "name_index", "c_mktsegment_index")
