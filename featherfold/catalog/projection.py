"""Derived columns: ratios, differences, row-wise statistics, bands, dates, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import (
    age_band, flag, floor_at_zero, pick, ratio, row_kurtosis, row_mean, row_missing, row_sum, strict_sum,
)
from ..models.training import hold_out
from ..operators.aggregate import Slice, add_differences, add_ratios, aggregate
from ..operators.clean import Standardizer, date_columns
from ..operators.screen import scaled_ranks
from ..plans import fixed as X
from ..plans.credit import application_columns, card_columns, instalment_columns, previous_columns
from .base import bucket_sql, credit, credit_sql, q, query, ratio_sql, table


def _ratios_sql(ratios) -> str:
    return ", ".join(f"{ratio_sql(q(a), q(b))} AS {q(n)}" for n, (a, b) in ratios.items())


def _diffs_sql(diffs) -> str:
    return ", ".join(f"{q(a)} - {q(b)} AS {q(n)}" for n, (a, b) in diffs.items())


@query(
    "p1_ratio_columns",
    f"WITH {credit_sql('application')} SELECT \"SK_ID_CURR\", {_ratios_sql(X.APPLICATION_RATIOS)} FROM application",
)
def p1(spark, d):
    return add_ratios(credit(spark, d, "application"), X.APPLICATION_RATIOS).select("SK_ID_CURR", *X.APPLICATION_RATIOS)


@query(
    "p2_difference_columns",
    f"WITH {credit_sql('application')} SELECT \"SK_ID_CURR\", {_diffs_sql(X.APPLICATION_DIFFERENCES)} FROM application",
)
def p2(spark, d):
    return add_differences(credit(spark, d, "application"), X.APPLICATION_DIFFERENCES).select(
        "SK_ID_CURR", *X.APPLICATION_DIFFERENCES
    )


_PAYMENTS = ratio_sql('"AMT_CREDIT"', '"AMT_ANNUITY"')


@query(
    "p3_compound_arithmetic",
    f"""WITH {credit_sql('application')} SELECT "SK_ID_CURR", ({_PAYMENTS}) / NULLIF("DAYS_EMPLOYED", 0) AS "ANN_LENGTH_EMPLOYED_RATIO",
    "DAYS_BIRTH" * (-1e0 / 365) + ({_PAYMENTS}) * (1e0 / 12) AS age_finish,
    ({_PAYMENTS}) * (1e0 / 12) / NULLIF("DAYS_BIRTH", 0) * (-1e0 / 365) AS "ANN_LENGTH_AGE_RATIO" FROM application""",
)
def p3(spark, d):
    return application_columns(credit(spark, d, "application")).select(
        "SK_ID_CURR", "ANN_LENGTH_EMPLOYED_RATIO", "age_finish", "ANN_LENGTH_AGE_RATIO"
    )


@query(
    "p3_simple_interest",
    f"""WITH {credit_sql('previous')} SELECT "SK_ID_PREV",
    ("AMT_ANNUITY" * "CNT_PAYMENT" / NULLIF("AMT_CREDIT", 0) - 1) / NULLIF("CNT_PAYMENT", 0) AS "SIMPLE_INTERESTS",
    NULLIF("DAYS_TERMINATION", 365243) - "DAYS_DECISION" AS "APP_DURATION",
    NULLIF("DAYS_LAST_DUE", 365243) - NULLIF("DAYS_FIRST_DRAWING", 365243) AS "APP_PAY_DURATION" FROM previous""",
)
def p3b(spark, d):
    return previous_columns(credit(spark, d, "previous")).select(
        "SK_ID_PREV", "SIMPLE_INTERESTS", "APP_DURATION", "APP_PAY_DURATION"
    )


_EXT = [q(c) for c in X.EXT_SOURCES]


@query(
    "p4_row_mean",
    f"""WITH {credit_sql('application')} SELECT "SK_ID_CURR",
    ({' + '.join(f'coalesce({c}, 0)' for c in _EXT)}) / NULLIF({' + '.join(f'CAST({c} IS NOT NULL AS INTEGER)' for c in _EXT)}, 0) AS mean
    FROM application""",
)
def p4(spark, d):
    return credit(spark, d, "application").select("SK_ID_CURR", row_mean(X.EXT_SOURCES).alias("mean"))


_SPARSE = ["EXT_SOURCE_1", "EXT_SOURCE_3", "OWN_CAR_AGE", "DAYS_EMPLOYED"]


@query(
    "p5_row_sum",
    f"WITH {credit_sql('application')} SELECT \"SK_ID_CURR\", CAST({' + '.join(f'coalesce({q(c)}, 0)' for c in _SPARSE)} AS DOUBLE) AS total FROM application",
)
def p5(spark, d):
    return credit(spark, d, "application").select("SK_ID_CURR", row_sum(_SPARSE).alias("total"))


@query(
    "p6_null_propagating_sum",
    f"""WITH {credit_sql('application')} SELECT "SK_ID_CURR", {' + '.join(q(c) for c in X.DOCUMENT_FLAGS)} AS document_sum,
    {' + '.join(q(c) for c in _SPARSE)} AS strict FROM application""",
)
def p6(spark, d):
    return credit(spark, d, "application").select(
        "SK_ID_CURR", strict_sum(X.DOCUMENT_FLAGS).alias("document_sum"), strict_sum(_SPARSE).alias("strict")
    )


_KURT = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "FLAG_EMAIL", "FLAG_PHONE", "FLAG_OWN_CAR"]


@query(
    "p7_row_kurtosis",
    f"""WITH {credit_sql('application')}, l AS (SELECT "SK_ID_CURR", unnest([{', '.join(f'CAST({q(c)} AS DOUBLE)' for c in _KURT)}]) AS v FROM application),
    m AS (SELECT "SK_ID_CURR", v, avg(v) OVER (PARTITION BY "SK_ID_CURR") AS mu FROM l WHERE v IS NOT NULL),
    s AS (SELECT "SK_ID_CURR", CAST(count(*) AS DOUBLE) AS n, sum((v - mu) ** 2) AS m2, sum((v - mu) ** 4) AS m4 FROM m GROUP BY "SK_ID_CURR")
    SELECT "SK_ID_CURR", CASE WHEN n >= 4 THEN CASE WHEN m2 < 1e-14 THEN 0e0 ELSE
    n * (n + 1) * (n - 1) * m4 / ((n - 2) * (n - 3) * m2 * m2) - 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)) END END AS kurt FROM s""",
)
def p7(spark, d):
    return credit(spark, d, "application").select("SK_ID_CURR", row_kurtosis(_KURT).alias("kurt"))


@query(
    "p8_row_missing_count",
    f"""WITH {credit_sql('application')} SELECT "SK_ID_CURR", {' + '.join(f'CAST({q(c)} IS NULL AS INTEGER)' for c in [*_SPARSE, 'OCCUPATION_TYPE'])} AS missing
    FROM application""",
)
def p8(spark, d):
    return credit(spark, d, "application").select("SK_ID_CURR", row_missing([*_SPARSE, "OCCUPATION_TYPE"]).alias("missing"))


@query(
    "p9_age_band",
    f"""WITH {credit_sql('application')}, a AS (SELECT "SK_ID_CURR", -"DAYS_BIRTH" / 365.0 AS y FROM application)
    SELECT "SK_ID_CURR", CASE WHEN y < 27 THEN 1 WHEN y < 40 THEN 2 WHEN y < 50 THEN 3 WHEN y < 65 THEN 4 WHEN y < 99 THEN 5 ELSE 0 END AS band FROM a""",
)
def p9(spark, d):
    return credit(spark, d, "application").select("SK_ID_CURR", age_band("DAYS_BIRTH").alias("band"))


_DELAY = '"DAYS_ENTRY_PAYMENT" - "DAYS_INSTALMENT"'


@query(
    "p10_floor_at_zero",
    f"""WITH {credit_sql('installments')} SELECT "SK_ID_PREV", "AMT_INSTALMENT", greatest(coalesce({_DELAY}, 0), 0) AS dpd,
    greatest(coalesce(-({_DELAY}), 0), 0) AS dbd FROM installments""",
)
def p10(spark, d):
    delay = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    return credit(spark, d, "installments").select(
        "SK_ID_PREV", "AMT_INSTALMENT", floor_at_zero(delay).alias("dpd"), floor_at_zero(-delay).alias("dbd")
    )


@query(
    "p11_threshold_flags",
    f"""WITH {credit_sql('installments')} SELECT "SK_ID_PREV", "AMT_INSTALMENT", CASE WHEN {_DELAY} >= 7 THEN 1 ELSE 0 END AS dpd_7,
    CASE WHEN {_DELAY} >= 15 THEN 1 ELSE 0 END AS dpd_15, CASE WHEN "AMT_PAYMENT" / NULLIF("AMT_INSTALMENT", 0) > 0.95 THEN 1 ELSE 0 END AS full
    FROM installments""",
)
def p11(spark, d):
    delay = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    return credit(spark, d, "installments").select(
        "SK_ID_PREV", "AMT_INSTALMENT", flag(delay >= 7).alias("dpd_7"), flag(delay >= 15).alias("dpd_15"),
        flag(ratio("AMT_PAYMENT", "AMT_INSTALMENT") > 0.95).alias("full"),
    )


@query(
    "p12_conditional_pick",
    f"""WITH {credit_sql('installments')} SELECT "SK_ID_PREV", "AMT_INSTALMENT",
    CASE WHEN {_DELAY} > 0 THEN "AMT_PAYMENT" ELSE 0e0 END AS late_amount FROM installments""",
)
def p12(spark, d):
    delay = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    return credit(spark, d, "installments").select(
        "SK_ID_PREV", "AMT_INSTALMENT", pick(delay > 0, "AMT_PAYMENT").alias("late_amount")
    )


@query(
    "p12_late_payment_columns",
    f"""WITH {credit_sql('installments')}, p AS (SELECT *, CASE WHEN -({_DELAY}) > 0 THEN 1 ELSE 0 END AS late,
    "AMT_PAYMENT" / NULLIF("AMT_INSTALMENT", 0) AS perc FROM installments)
    SELECT "SK_ID_PREV", "AMT_INSTALMENT", late AS "LATE_PAYMENT", CASE WHEN late = 1 THEN perc ELSE 0 END AS "LATE_PAYMENT_RATIO",
    CASE WHEN (CASE WHEN late = 1 THEN perc ELSE 0 END) > 0.05 THEN 1 ELSE 0 END AS "SIGNIFICANT_LATE_PAYMENT" FROM p""",
)
def p12b(spark, d):
    return instalment_columns(credit(spark, d, "installments")).select(
        "SK_ID_PREV", "AMT_INSTALMENT", "LATE_PAYMENT", "LATE_PAYMENT_RATIO", "SIGNIFICANT_LATE_PAYMENT"
    )


@query(
    "p13_abs_log_round",
    "SELECT c_custkey, abs(c_acctbal) AS magnitude, ln(abs(c_acctbal) + 1) AS log_value, round(c_acctbal / 7, 5) AS rounded FROM customer",
)
def p13(spark, d):
    x = F.col("c_acctbal")
    return table(spark, d, "customer").select(
        "c_custkey", F.abs(x).alias("magnitude"), F.ln(F.abs(x) + 1).alias("log_value"), F.round(x / 7, 5).alias("rounded")
    )


@query(
    "p16_prefixed_names",
    """SELECT l_suppkey, min(l_quantity) AS "SUP_l_quantity_MIN", max(l_quantity) AS "SUP_l_quantity_MAX",
    avg(l_discount) AS "SUP_l_discount_MEAN" FROM lineitem GROUP BY l_suppkey""",
)
def p16(spark, d):
    spec = {"l_quantity": ["min", "max"], "l_discount": ["mean"]}
    return aggregate(table(spark, d, "lineitem"), "l_suppkey", [Slice(spec, "SUP_")])


_RELATIVE = ["ATM", "OTHER", "POS"]


@query(
    "p17_name_derived_columns",
    f"WITH {credit_sql('credit')} SELECT \"ROW_ID\", "
    + ", ".join(f"CAST(\"CNT_DRAWINGS_{n}_CURRENT\" AS DOUBLE) / NULLIF(\"CNT_DRAWINGS_CURRENT\", 0) AS \"RELATIVE_DRAWINGS_{n}_CURRENT\"" for n in _RELATIVE)
    + " FROM credit",
)
def p17(spark, d):
    return card_columns(credit(spark, d, "credit")).select("ROW_ID", *[f"RELATIVE_DRAWINGS_{n}_CURRENT" for n in _RELATIVE])


@query(
    "p18_scaled_ranks",
    """WITH t AS (SELECT p_brand AS feature, avg(p_retailprice) AS v FROM part GROUP BY p_brand)
    SELECT feature, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 5) AS importance FROM t""",
)
def p18(spark, d):
    t = table(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("importance"))
    return scaled_ranks(t)


@query(
    "p19_standardise",
    f"""WITH s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s, avg(c_nationkey) AS mn, stddev_samp(c_nationkey) AS sn
    FROM customer WHERE {bucket_sql('c_custkey', 1000, 666)} < 700)
    SELECT c_custkey, (c_acctbal - m) / s AS c_acctbal, (c_nationkey - mn) / sn AS c_nationkey FROM customer, s""",
)
def p19(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    train, _ = hold_out(df, "c_custkey", 0.7)
    return Standardizer.fit(train, ["c_acctbal", "c_nationkey"]).transform(df)


@query(
    "p20_share_of_total",
    "SELECT p_type AS feature, sum(p_retailprice) AS importance, sum(p_retailprice) / sum(sum(p_retailprice)) OVER () AS importance_normalized FROM part GROUP BY p_type",
)
def p20(spark, d):
    from ..models.training import normalised_importances

    t = table(spark, d, "part").groupBy(F.col("p_type").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))
    return normalised_importances(t)


@query(
    "t1_day_offset_to_date",
    f"""WITH {credit_sql('bureau')} SELECT "SK_ID_BUREAU", CAST(DATE '2016-01-01' + CAST("DAYS_CREDIT" AS INTEGER) AS DATE) AS "TSD_CREDIT",
    CAST(DATE '2016-01-01' + CAST("DAYS_CREDIT_ENDDATE" AS INTEGER) AS DATE) AS "TSD_CREDIT_ENDDATE" FROM bureau""",
)
def t1(spark, d):
    return date_columns(credit(spark, d, "bureau").select("SK_ID_BUREAU", "DAYS_CREDIT", "DAYS_CREDIT_ENDDATE"))


@query(
    "t2_month_offset_to_timestamp",
    f"""WITH {credit_sql('credit')} SELECT "ROW_ID", TIMESTAMP '2016-01-01 00:00:00' + to_seconds("MONTHS_BALANCE" * 2629746) AS "TSM_BALANCE" FROM credit""",
)
def t2(spark, d):
    return date_columns(credit(spark, d, "credit").select("ROW_ID", "MONTHS_BALANCE"))
