"""Grouped aggregates, feature frames, roll-ups along relationships and the whole build."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import ratio
from ..operators.aggregate import (
    Slice, add_ratios, aggregate, group_statistics, merge_specs, roll_up, shares,
)
from ..operators.density import class_density, class_medians
from ..operators.graph import Entity, EntitySet, Relationship, chain
from ..operators.partial import aggregate_by_part
from ..operators.profile import two_value_columns
from ..plans import fixed as X
from ..plans.credit import (
    CUSTOMER, attach, application_features, balance_per_loan, build_features, bureau_features, card_features,
    cash_features, cash_per_loan, cash_columns, child_features, cross_table_ratios, instalment_features, latest_of_part,
    previous_features, relative_name,
)
from ..plans.starmap import CARD_TIES, SHARE_COLUMNS, columns_of, credit_tables
from .base import agg_sql, base, bucket_sql, credit, credit_sql, names_sql, q, query, ratio_sql, slices_sql, table

# --- generic aggregates over the star schema ------------------------------------

_ORDER_SPEC = {"o_totalprice": ["min", "max", "mean", "sum", "var"], "o_orderkey": ["size"], "o_orderstatus": ["nunique"]}


@query(
    "g1_spec_aggregate",
    f"WITH {slices_sql('orders', 'o_custkey', [('ORD_', _ORDER_SPEC, None)])} SELECT * FROM features",
)
def g1(spark, d):
    return aggregate(table(spark, d, "orders"), "o_custkey", [Slice(_ORDER_SPEC, "ORD_")])


_LATE = "l_shipdate >= '1995-01-01'"


@query(
    "g1_exact_whole_sums",
    f"""SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS "l_linenumber_SUM",
    CAST(sum(l_linenumber) FILTER (WHERE {_LATE}) AS BIGINT) AS "LATE_l_linenumber_SUM" FROM lineitem GROUP BY l_suppkey""",
)
def g1_whole(spark, d):
    spec = {"l_linenumber": ["sum"]}
    return aggregate(table(spark, d, "lineitem"), "l_suppkey", [Slice(spec), Slice(spec, "LATE_", _LATE)])


#: Keys far beyond 53 bits, so that sums of doubles are wrong and sums of longs overflow.
_BIG = "4611686018427387904 + l_orderkey"


@query(
    "g1_exact_decimal_sums",
    f"""WITH t AS (SELECT l_suppkey, {_BIG} AS big, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem)
    SELECT l_suppkey, CAST(sum(big) AS DECIMAL(38,0)) AS "big_SUM", CAST(sum(price) AS DECIMAL(38,2)) AS "price_SUM" FROM t GROUP BY l_suppkey""",
)
def g1_decimal(spark, d):
    t = table(spark, d, "lineitem").selectExpr("l_suppkey", f"{_BIG} AS big", "CAST(l_extendedprice AS DECIMAL(18,2)) AS price")
    return aggregate(t, "l_suppkey", [Slice({"big": ["sum"], "price": ["sum"]})])


@query(
    "g1_order_free_sums",
    """SELECT l_suppkey, fsum(l_extendedprice) AS "l_extendedprice_FSUM", fsum(l_tax) AS "l_tax_FSUM" FROM lineitem GROUP BY l_suppkey""",
)
def g1_float(spark, d):
    """Sums of doubles that come out the same bit for bit in any order of rows."""
    return aggregate(table(spark, d, "lineitem"), "l_suppkey", [Slice({"l_extendedprice": ["fsum"], "l_tax": ["fsum"]})])


_LINE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey"]
_FIRST_LAST = {"l_quantity": ["first", "last"], "l_extendedprice": ["first", "last", "sum"], "l_partkey": ["nunique", "size"]}


@query(
    "g1_spec_first_last",
    f"WITH {slices_sql('lineitem', 'l_orderkey', [('', _FIRST_LAST, None)], _LINE_ORDER)} SELECT * FROM features",
)
def g1b(spark, d):
    return aggregate(table(spark, d, "lineitem"), "l_orderkey", [Slice(_FIRST_LAST)], _LINE_ORDER)


@query(
    "flagship_customer_features",
    f"""WITH {slices_sql('orders', 'o_custkey', [('ORD_', _ORDER_SPEC, None)])}
    SELECT c.c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, {', '.join(q(n) for n in Slice(_ORDER_SPEC, 'ORD_').outputs())},
    c_acctbal / NULLIF("ORD_o_totalprice_SUM", 0) AS "BALANCE_TO_SPEND" FROM customer c LEFT JOIN features f ON c.c_custkey = f.o_custkey""",
)
def flagship(spark, d):
    out = roll_up(table(spark, d, "orders"), table(spark, d, "customer"), "c_custkey", [Slice(_ORDER_SPEC, "ORD_")], "o_custkey")
    return add_ratios(out, {"BALANCE_TO_SPEND": ("c_acctbal", "ORD_o_totalprice_SUM")})


_BALANCE_SPEC = merge_specs(X.BALANCE_SPEC, shares(SHARE_COLUMNS["bureau_balance"]))


@query(
    "g2_grandchild_per_child",
    f"WITH {credit_sql('bureau_balance')}, {slices_sql('bureau_balance', 'SK_ID_BUREAU', [('', _BALANCE_SPEC, None)])} SELECT * FROM features",
)
def g2(spark, d):
    return balance_per_loan(credit(spark, d, "bureau_balance"), SHARE_COLUMNS["bureau_balance"])


@query(
    "g3_two_level_roll_up",
    """WITH o AS (SELECT l_orderkey, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY l_orderkey)
    SELECT o_custkey, avg(qty) AS "CUST_LINE_l_quantity_SUM_MEAN", max(qty) AS "CUST_LINE_l_quantity_SUM_MAX",
    coalesce(sum(CAST(n AS DOUBLE)), 0) AS "CUST_LINE_l_partkey_SIZE_SUM", count(*) AS "CUST_o_orderkey_SIZE"
    FROM orders LEFT JOIN o ON o_orderkey = l_orderkey GROUP BY o_custkey""",
)
def g3(spark, d):
    lines = [Slice({"l_quantity": ["sum"], "l_partkey": ["size"]}, "LINE_")]
    orders = roll_up(table(spark, d, "lineitem"), table(spark, d, "orders"), "o_orderkey", lines, "l_orderkey")
    spec = {"LINE_l_quantity_SUM": ["mean", "max"], "LINE_l_partkey_SIZE": ["sum"], "o_orderkey": ["size"]}
    return aggregate(orders, "o_custkey", [Slice(spec, "CUST_", doubles=True)])


_STATUS_SPEC = {"o_totalprice": ["max", "sum", "mean", "var"], "o_orderkey": ["size"]}
_STATUS_SLICES = [("ALL_", _STATUS_SPEC, None), ("OPEN_", _STATUS_SPEC, "o_orderstatus = 'O'"), ("DONE_", _STATUS_SPEC, "o_orderstatus = 'F'")]


@query(
    "g4_filtered_by_flag",
    f"WITH {slices_sql('orders', 'o_custkey', _STATUS_SLICES)} SELECT * FROM features",
)
def g4(spark, d):
    return aggregate(table(spark, d, "orders"), "o_custkey", [Slice(s, p, w) for p, s, w in _STATUS_SLICES])


_KINDS = {"URGENT_": "1-URGENT", "HIGH_": "2-HIGH", "MEDIUM_": "3-MEDIUM", "NONE_": "4-NOT SPECIFIED", "LOW_": "5-LOW"}
_KIND_SPEC = {"o_totalprice": ["mean", "max"]}


@query(
    "g5_per_category",
    "WITH " + slices_sql("orders", "o_custkey", [("", {"o_orderkey": ["size"]}, None)]
                         + [(p, _KIND_SPEC, f"o_orderpriority = '{v}'") for p, v in _KINDS.items()])
    + " SELECT * FROM features",
)
def g5(spark, d):
    kinds = [Slice(_KIND_SPEC, p, f"o_orderpriority = '{v}'") for p, v in _KINDS.items()]
    return aggregate(table(spark, d, "orders"), "o_custkey", [Slice({"o_orderkey": ["size"]}), *kinds])


_RECENT_SPEC = {"AMT_CREDIT_SUM": ["max", "sum"], "AMT_CREDIT_MAX_OVERDUE": ["max", "mean"]}


@query(
    "g6_recency_window",
    f"""WITH {credit_sql('bureau')}, {slices_sql('bureau', 'SK_ID_CURR', [
        ('', {'DAYS_CREDIT': ['max']}, None), ('LAST6M_', _RECENT_SPEC, '"DAYS_CREDIT" >= -180'),
        ('LAST12M_', _RECENT_SPEC, '"DAYS_CREDIT" >= -360')])} SELECT * FROM features""",
)
def g6(spark, d):
    slices = [Slice({"DAYS_CREDIT": ["max"]})]
    slices += [Slice(_RECENT_SPEC, f"LAST{m}M_", f"DAYS_CREDIT >= {-30 * m}") for m in (6, 12)]
    return aggregate(credit(spark, d, "bureau"), CUSTOMER, slices)


_HISTORY_SPEC = {"AMT_PAYMENT": ["min", "max", "mean", "sum"], "SK_ID_PREV": ["size"]}


@query(
    "g7_loan_history_window",
    f"""WITH {credit_sql('installments')}, t AS (SELECT *, max("DAYS_INSTALMENT") OVER (PARTITION BY "SK_ID_PREV") AS seen FROM installments),
    {slices_sql('t', 'SK_ID_CURR', [('', {'SK_ID_PREV': ['size']}, None), ('INS_36M_', _HISTORY_SPEC, 'seen >= -1080'),
        ('INS_60M_', _HISTORY_SPEC, 'seen >= -1800')])} SELECT * FROM features""",
)
def g7(spark, d):
    slices = [Slice({"SK_ID_PREV": ["size"]})] + [Slice(_HISTORY_SPEC, f"INS_{m}M_", f"seen >= {-30 * m}") for m in (36, 60)]
    return aggregate_by_part(
        credit(spark, d, "installments"), CUSTOMER, "SK_ID_PREV", slices, {"seen": latest_of_part("SK_ID_PREV", "DAYS_INSTALMENT")}
    )


@query("g8_group_size", "SELECT l_suppkey, count(*) AS \"LINE_COUNT\" FROM lineitem GROUP BY l_suppkey")
def g8(spark, d):
    names = {("l_suppkey", "size"): "LINE_COUNT"}
    return aggregate(table(spark, d, "lineitem"), "l_suppkey", [Slice({"l_suppkey": ["size"]}, names=names)])


@query(
    "g9_group_statistics",
    """SELECT l_orderkey, l_partkey, l_suppkey, median(l_extendedprice) OVER w AS price_median,
    stddev_samp(l_extendedprice) OVER w AS price_std, avg(l_quantity) OVER w AS quantity_mean, sum(l_tax) OVER w AS tax_sum
    FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus, l_linenumber)""",
)
def g9(spark, d):
    df = group_statistics(
        table(spark, d, "lineitem"),
        ["l_returnflag", "l_linestatus", "l_linenumber"],
        {
            "price_median": ("l_extendedprice", "median"), "price_std": ("l_extendedprice", "std"),
            "quantity_mean": ("l_quantity", "mean"), "tax_sum": ("l_tax", "sum"),
        },
    )
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "price_median", "price_std", "quantity_mean", "tax_sum")


@query(
    "g9_group_statistics_null_keys",
    f"""WITH {credit_sql('application')} SELECT "SK_ID_CURR",
    CASE WHEN "OCCUPATION_TYPE" IS NOT NULL THEN median("EXT_SOURCE_1") OVER w END AS ext_median,
    CASE WHEN "OCCUPATION_TYPE" IS NOT NULL THEN avg("AMT_INCOME_TOTAL") OVER w END AS income_mean FROM application
    WINDOW w AS (PARTITION BY "OCCUPATION_TYPE", "CODE_GENDER")""",
)
def g9b(spark, d):
    stats = {"ext_median": ("EXT_SOURCE_1", "median"), "income_mean": ("AMT_INCOME_TOTAL", "mean")}
    df = group_statistics(credit(spark, d, "application"), ["OCCUPATION_TYPE", "CODE_GENDER"], stats)
    return df.select(CUSTOMER, *stats)


@query(
    "g10_binary_shares",
    f"""WITH {credit_sql('bureau')} SELECT "SK_ID_CURR", {', '.join(f'avg({q(c)}) AS {q(c + "_MEAN")}' for c in SHARE_COLUMNS['bureau'])}
    FROM bureau GROUP BY "SK_ID_CURR" """,
)
def g10(spark, d):
    df = credit(spark, d, "bureau")
    return aggregate(df, CUSTOMER, [Slice(shares(two_value_columns(df)))])


def _cash_loans_sql() -> str:
    done, month = q("NAME_CONTRACT_STATUS_Completed"), ["MONTHS_BALANCE"]
    first, last = agg_sql("first", q("CNT_INSTALMENT"), month), agg_sql("last", q("CNT_INSTALMENT"), month)
    left = agg_sql("last", q("CNT_INSTALMENT_FUTURE"), month)
    return f"""loans AS (SELECT "SK_ID_PREV", {agg_sql('first', q('SK_ID_CURR'), month)} AS "SK_ID_CURR",
    max("MONTHS_BALANCE") AS "MONTHS_BALANCE_MAX", avg({done}) AS "POS_LOAN_COMPLETED_MEAN",
    CASE WHEN {first} - {last} > 0 AND avg({done}) > 0 THEN 1 ELSE 0 END AS "POS_COMPLETED_BEFORE_MEAN",
    CAST({left} AS DOUBLE) / NULLIF({last}, 0) AS "POS_REMAINING_INSTALMENTS_RATIO",
    CAST(sum(CASE WHEN "SK_DPD" > 0 THEN 1 ELSE 0 END) AS BIGINT) AS "LATE_PAYMENT_SUM",
    {first} AS f, {last} AS l, {left} AS r FROM cash GROUP BY "SK_ID_PREV")"""


_LOAN_SUMS = ["POS_LOAN_COMPLETED_MEAN", "POS_COMPLETED_BEFORE_MEAN", "POS_REMAINING_INSTALMENTS_RATIO"]


@query(
    "g11_per_loan_summary",
    f"""WITH {credit_sql('cash')}, {_cash_loans_sql()} SELECT "SK_ID_CURR", coalesce(sum("POS_LOAN_COMPLETED_MEAN"), 0) AS "POS_LOAN_COMPLETED_MEAN",
    CAST(sum("POS_COMPLETED_BEFORE_MEAN") AS BIGINT) AS "POS_COMPLETED_BEFORE_MEAN",
    coalesce(sum("POS_REMAINING_INSTALMENTS_RATIO"), 0) AS "POS_REMAINING_INSTALMENTS_RATIO" FROM loans GROUP BY "SK_ID_CURR" """,
)
def g11(spark, d):
    loans = cash_per_loan(cash_columns(credit(spark, d, "cash")))
    return loans.groupBy(CUSTOMER).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _LOAN_SUMS])


@query(
    "g12_aggregate_ratio",
    """SELECT l_suppkey, sum(l_tax) / NULLIF(sum(l_discount), 0) AS rate FROM lineitem GROUP BY l_suppkey""",
)
def g12(spark, d):
    t = aggregate(table(spark, d, "lineitem"), "l_suppkey", [Slice({"l_tax": ["sum"], "l_discount": ["sum"]})])
    return t.select("l_suppkey", ratio("l_tax_SUM", "l_discount_SUM").alias("rate"))


@query(
    "g13_all_column_mean",
    f"WITH {credit_sql('cash')}, {_cash_loans_sql()} SELECT \"SK_ID_CURR\", avg(\"LATE_PAYMENT_SUM\") AS \"LATE_PAYMENT_SUM\" FROM loans GROUP BY \"SK_ID_CURR\"",
)
def g13(spark, d):
    loans = cash_per_loan(cash_columns(credit(spark, d, "cash")))
    names = {("LATE_PAYMENT_SUM", "mean"): "LATE_PAYMENT_SUM"}
    return aggregate(loans, CUSTOMER, [Slice({"LATE_PAYMENT_SUM": ["mean"]}, names=names)])


_LABELLED = "SELECT l_extendedprice, l_quantity, l_discount, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem"


def labelled_lines(spark, d):
    y = F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y")
    return table(spark, d, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", y)


@query(
    "g14_class_medians",
    f"""WITH t AS ({_LABELLED}) SELECT corr(l_extendedprice, y) AS corr, median(l_extendedprice) FILTER (WHERE y = 0) AS median_0,
    median(l_extendedprice) FILTER (WHERE y = 1) AS median_1 FROM t""",
)
def g14(spark, d):
    return class_medians(labelled_lines(spark, d), "l_extendedprice", "y")


_GRID = 50


@query(
    "g15_class_density",
    f"""WITH t AS ({_LABELLED}), s AS (SELECT y, count(*) AS n, stddev_samp(l_extendedprice) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h,
    min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM t GROUP BY y),
    g AS (SELECT y, n, h, CAST(i AS INTEGER) AS point, lo - 3 * h + (hi - lo + 6 * h) / {_GRID - 1} * i AS x FROM s CROSS JOIN range({_GRID}) r(i))
    SELECT g.y, point, x, sum(exp(-0.5 * ((x - l_extendedprice) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density
    FROM g JOIN t ON g.y = t.y GROUP BY g.y, point, x""",
)
def g15(spark, d):
    return class_density(labelled_lines(spark, d), "l_extendedprice", "y", points=_GRID)


# --- feature frames of the credit workload ----------------------------------------


def _derived(source: str, out: str, ratios=None, diffs=None, extra=None) -> str:
    items = [f"{ratio_sql(q(a), q(b))} AS {q(n)}" for n, (a, b) in (ratios or {}).items()]
    items += [f"{q(a)} - {q(b)} AS {q(n)}" for n, (a, b) in (diffs or {}).items()]
    items += [f"{e} AS {q(n)}" for n, e in (extra or {}).items()]
    return f"{out} AS (SELECT *, {', '.join(items)} FROM {source})"


def _bureau_sql(name: str, fanout: bool = False) -> str:
    statuses = SHARE_COLUMNS["bureau_balance"]
    share = merge_specs(X.BALANCE_SPEC, {} if fanout else shares(statuses))
    per_loan = slices_sql("bureau_balance", "SK_ID_BUREAU", [("", share, None, {(c, "mean"): c for c in statuses})], name="bb")
    months = f"LEFT JOIN (SELECT {names_sql(['SK_ID_BUREAU', *statuses])} FROM bureau_balance) m ON b.\"SK_ID_BUREAU\" = m.\"SK_ID_BUREAU\"" if fanout else ""
    held = ["MONTHS_BALANCE_MIN", "MONTHS_BALANCE_MAX", "MONTHS_BALANCE_MEAN", "MONTHS_BALANCE_SIZE"]
    joined = (
        f"bj AS (SELECT b.*, {', '.join(f'bb.{q(c)}' for c in held)}, "
        f"{', '.join(('m.' if fanout else 'bb.') + q(c) for c in statuses)} FROM bureau b "
        f"LEFT JOIN bb ON b.\"SK_ID_BUREAU\" = bb.\"SK_ID_BUREAU\" {months})"
    )
    cols = _derived("bj", "bc", X.BUREAU_RATIOS, X.BUREAU_DIFFERENCES, {"STATUS_12345": " + ".join(q(c) for c in X.STATUS_SUM)})
    slices = [
        ("BURO_", merge_specs(X.BUREAU_SPEC, shares(SHARE_COLUMNS["bureau"]), shares(["STATUS_C"])), None),
        ("BURO_ACTIVE_", X.BUREAU_ACTIVE_SPEC, '"CREDIT_ACTIVE_Active" = 1'),
        ("BURO_CLOSED_", X.BUREAU_CLOSED_SPEC, '"CREDIT_ACTIVE_Closed" = 1'),
    ]
    slices += [(p, X.BUREAU_TYPE_SPEC, f"\"CREDIT_TYPE_{k}\" = 1") for k, p in X.LOAN_TYPES.items()]
    slices += [(f"BURO_LAST{m}M_", X.BUREAU_RECENT_SPEC, f"\"DAYS_CREDIT\" >= {-30 * m}") for m in (6, 12)]
    last = agg_sql("last", q("AMT_CREDIT_MAX_OVERDUE"), ["DAYS_CREDIT"])
    totals = ", ".join(f"{ratio_sql(q(a), q(b))} AS {q(n)}" for n, (a, b) in X.BUREAU_TOTAL_RATIOS.items())
    return (
        f"{per_loan}, {joined}, {cols}, {slices_sql('bc', 'SK_ID_CURR', slices, name='bf')}, "
        f"bl AS (SELECT \"SK_ID_CURR\", {last} AS \"BURO_LAST_LOAN_MAX_OVERDUE\" FROM bc GROUP BY \"SK_ID_CURR\"), "
        f"{name} AS (SELECT bf.*, \"BURO_LAST_LOAN_MAX_OVERDUE\", {totals} FROM bf LEFT JOIN bl ON bf.\"SK_ID_CURR\" = bl.\"SK_ID_CURR\")"
    )


def _previous_sql(name: str) -> str:
    clean = ", ".join(f"NULLIF({q(c)}, 365243) AS {q(c)}" for c in X.PREVIOUS_DAY_COLUMNS)
    paid = 'CAST("AMT_ANNUITY" * "CNT_PAYMENT" AS DOUBLE) / NULLIF("AMT_CREDIT", 0)'
    cols = _derived("ps", "pc", X.PREVIOUS_RATIOS, X.PREVIOUS_DIFFERENCES, {"SIMPLE_INTERESTS": f'({paid} - 1) / NULLIF("CNT_PAYMENT", 0)'})
    slices = [
        ("PREV_", merge_specs(X.PREVIOUS_SPEC, shares(SHARE_COLUMNS["previous"])), None),
        ("APPROVED_", X.PREVIOUS_SPEC, '"NAME_CONTRACT_STATUS_Approved" = 1'),
        ("REFUSED_", X.PREVIOUS_SPEC, '"NAME_CONTRACT_STATUS_Refused" = 1'),
    ]
    slices += [(f"PREV_LAST{m}M_", X.PREVIOUS_RECENT_SPEC, f'"DAYS_DECISION" >= {-30 * m}') for m in (6, 12)]
    return f"ps AS (SELECT * REPLACE ({clean}) FROM previous), {cols}, {slices_sql('pc', 'SK_ID_CURR', slices, name=name)}"


def _instalment_sql(name: str) -> str:
    delay = '"DAYS_ENTRY_PAYMENT" - "DAYS_INSTALMENT"'
    one = _derived(
        "installments", "i1", {"PAYMENT_PERC": ("AMT_PAYMENT", "AMT_INSTALMENT")}, {"PAYMENT_DIFF": ("AMT_INSTALMENT", "AMT_PAYMENT")},
        {"DPD": f"greatest(coalesce({delay}, 0), 0)", "DBD": f"greatest(coalesce(-({delay}), 0), 0)",
         "seen": 'max("DAYS_INSTALMENT") OVER (PARTITION BY "SK_ID_PREV")'},
    )
    share = 'CASE WHEN "DBD" > 0 THEN "PAYMENT_PERC" ELSE 0 END'
    two = _derived(
        "i1", "i2", extra={
            "LATE_PAYMENT": 'CASE WHEN "DBD" > 0 THEN 1 ELSE 0 END', "LATE_PAYMENT_RATIO": share,
            "SIGNIFICANT_LATE_PAYMENT": f"CASE WHEN ({share}) > 0.05 THEN 1 ELSE 0 END",
            "DPD_7": 'CASE WHEN "DPD" >= 7 THEN 1 ELSE 0 END', "DPD_15": 'CASE WHEN "DPD" >= 15 THEN 1 ELSE 0 END',
        },
    )
    slices = [("INSTAL_", merge_specs(X.INSTALMENT_SPEC, shares(SHARE_COLUMNS["installments"])), None)]
    slices += [(f"INS_{m}M_", X.INSTALMENT_RECENT_SPEC, f"seen >= {-30 * m}") for m in (36, 60)]
    rate = ratio_sql('"INSTAL_AMT_PAYMENT_SUM"', '"INSTAL_AMT_INSTALMENT_SUM"')
    return (
        f"{one}, {two}, {slices_sql('i2', 'SK_ID_CURR', slices, name='inst')}, "
        f"{name} AS (SELECT *, {rate} AS \"INSTAL_TOTAL_PAYMENT_RATE\", \"INSTAL_SK_ID_PREV_SIZE\" AS \"INSTAL_COUNT\" FROM inst)"
    )


def _cash_sql(name: str) -> str:
    cols = _derived(
        "cash", "cc", X.CASH_RATIOS, None,
        {"INSTALMENT_BALANCE_RATIO": ratio_sql('"CNT_INSTALMENT_FUTURE"', 'abs("MONTHS_BALANCE")'),
         "LATE_PAYMENT": 'CASE WHEN "SK_DPD" > 0 THEN 1 ELSE 0 END'},
    )
    spec = {c: [f for f in fs if f not in ("first", "last")] for c, fs in X.CASH_SPEC.items()}
    spec = merge_specs(spec, shares(SHARE_COLUMNS["cash"]))
    ends = {"POS_CNT_INSTALMENT_FIRST": ("first", "f"), "POS_CNT_INSTALMENT_LAST": ("last", "l"), "POS_CNT_INSTALMENT_FUTURE_LAST": ("last", "r")}
    totals = ", ".join(f"{agg_sql(f, c, ['SK_ID_PREV'])} AS {q(n)}" for n, (f, c) in ends.items())
    return (
        f"{cols}, {slices_sql('cc', 'SK_ID_CURR', [('POS_', spec, None)], name='cf')}, {_cash_loans_sql()}, "
        f"ct AS (SELECT \"SK_ID_CURR\", {totals}, coalesce(sum(\"POS_LOAN_COMPLETED_MEAN\"), 0) AS \"POS_LOAN_COMPLETED_MEAN\", "
        f"CAST(sum(\"POS_COMPLETED_BEFORE_MEAN\") AS BIGINT) AS \"POS_COMPLETED_BEFORE_MEAN\", "
        f"coalesce(sum(\"POS_REMAINING_INSTALMENTS_RATIO\"), 0) AS \"POS_REMAINING_INSTALMENTS_RATIO\" FROM loans GROUP BY \"SK_ID_CURR\"), "
        f"cl AS (SELECT \"SK_ID_CURR\", avg(\"LATE_PAYMENT_SUM\") AS \"LATE_PAYMENT_SUM\" FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY \"SK_ID_CURR\" ORDER BY \"SK_ID_PREV\" DESC) AS rn FROM loans) WHERE rn <= 3 GROUP BY \"SK_ID_CURR\"), "
        f"{name} AS (SELECT cf.*, ct.* EXCLUDE (\"SK_ID_CURR\"), cl.\"LATE_PAYMENT_SUM\", \"POS_MONTHS_BALANCE_SIZE\" AS \"POS_COUNT\" "
        f"FROM cf LEFT JOIN ct ON cf.\"SK_ID_CURR\" = ct.\"SK_ID_CURR\" LEFT JOIN cl ON cf.\"SK_ID_CURR\" = cl.\"SK_ID_CURR\")"
    )


def _card_sql(name: str) -> str:
    extra = {relative_name(c): ratio_sql(q(c), q("CNT_DRAWINGS_CURRENT")) for c in X.CARD_DRAWINGS}
    extra |= {
        "INSTALMENT_MATURE_BALANCE_RATIO": ratio_sql('"CNT_INSTALMENT_MATURE_CUM"', 'abs("MONTHS_BALANCE")'),
        "LATE_PAYMENT": 'CASE WHEN "SK_DPD" > 0 THEN 1 ELSE 0 END',
        "seen": 'max("MONTHS_BALANCE") OVER (PARTITION BY "SK_ID_PREV")',
        "rn": 'row_number() OVER (PARTITION BY "SK_ID_PREV" ORDER BY "MONTHS_BALANCE" DESC, "ROW_ID")',
    }
    cols = _derived("credit", "kc", X.CARD_RATIOS, X.CARD_DIFFERENCES, extra)
    spec = merge_specs(
        X.CARD_SPEC, {relative_name(c): X.CARD_RELATIVE_FUNCTIONS for c in X.CARD_DRAWINGS}, shares(SHARE_COLUMNS["credit"]),
        {"MONTHS_BALANCE": ["size"]},
    )
    slices = [("CC_", spec, None, {("MONTHS_BALANCE", "size"): "CC_COUNT"})]
    slices += [(f"INS_{m}M_", X.CARD_RECENT_SPEC, f"seen >= {-30 * m}") for m in (12, 24, 48)]
    slices += [("CC_LAST_", X.CARD_LAST_SPEC, "rn = 1")]
    return f"{cols}, {slices_sql('kc', 'SK_ID_CURR', slices, name=name)}"


@query("g_bureau_features", f"WITH {credit_sql('bureau', 'bureau_balance')}, {_bureau_sql('out')} SELECT * FROM out")
def g_bureau(spark, d):
    return bureau_features(
        credit(spark, d, "bureau"), credit(spark, d, "bureau_balance"), SHARE_COLUMNS["bureau"], SHARE_COLUMNS["bureau_balance"]
    )


@query("g_bureau_features_fanout", f"WITH {credit_sql('bureau', 'bureau_balance')}, {_bureau_sql('out', True)} SELECT * FROM out")
def g_bureau_fanout(spark, d):
    return bureau_features(credit(spark, d, "bureau"), credit(spark, d, "bureau_balance"), SHARE_COLUMNS["bureau"], [], True)


@query("g_previous_features", f"WITH {credit_sql('previous')}, {_previous_sql('out')} SELECT * FROM out")
def g_previous(spark, d):
    return previous_features(credit(spark, d, "previous"), SHARE_COLUMNS["previous"])


@query("g_instalment_features", f"WITH {credit_sql('installments')}, {_instalment_sql('out')} SELECT * FROM out")
def g_instalment(spark, d):
    return instalment_features(credit(spark, d, "installments"), SHARE_COLUMNS["installments"])


@query("g_cash_features", f"WITH {credit_sql('cash')}, {_cash_sql('out')} SELECT * FROM out")
def g_cash(spark, d):
    return cash_features(credit(spark, d, "cash"), SHARE_COLUMNS["cash"])


@query("g_card_features", f"WITH {credit_sql('credit')}, {_card_sql('out')} SELECT * FROM out")
def g_card(spark, d):
    return card_features(credit(spark, d, "credit"), SHARE_COLUMNS["credit"], ties=CARD_TIES)


def _application_sql(name: str, source: str = "application", split: str = "") -> str:
    pay = ratio_sql('"AMT_CREDIT"', '"AMT_ANNUITY"')
    ext = [q(c) for c in X.EXT_SOURCES]
    docs, live = X.DOCUMENT_FLAGS, ["FLAG_OWN_CAR", "FLAG_EMAIL", "FLAG_PHONE"]
    s = " + ".join(q(c) for c in docs)
    mu = f"(({s}) / 20e0)"
    m2 = " + ".join(f"({q(c)} - mu) ** 2" for c in docs)
    m4 = " + ".join(f"({q(c)} - mu) ** 4" for c in docs)
    n = 20
    extra = {
        "NEW_EXT_SOURCES_MEAN": f"({' + '.join(f'coalesce({c}, 0)' for c in ext)}) / NULLIF({' + '.join(f'CAST({c} IS NOT NULL AS INTEGER)' for c in ext)}, 0)",
        "document_sum": s,
        "ANN_LENGTH_EMPLOYED_RATIO": f"({pay}) / NULLIF(\"DAYS_EMPLOYED\", 0)",
        "age_finish": f"\"DAYS_BIRTH\" * (-1e0 / 365) + ({pay}) * (1e0 / 12)",
        "ANN_LENGTH_AGE_RATIO": f"({pay}) * (1e0 / 12) / NULLIF(\"DAYS_BIRTH\", 0) * (-1e0 / 365)",
        "NEW_DOC_IND_KURT": f"CASE WHEN ({m2}) < 1e-14 THEN 0e0 ELSE {float(n * (n + 1) * (n - 1)) / ((n - 2) * (n - 3))!r} * ({m4}) / (({m2}) ** 2) - {3.0 * (n - 1) ** 2 / ((n - 2) * (n - 3))!r} END",
        "NEW_LIVE_IND_SUM": f"CAST({' + '.join(q(c) for c in live)} AS DOUBLE)",
        "AGE_RANGE": "CASE WHEN -\"DAYS_BIRTH\" / 365.0 < 27 THEN 1 WHEN -\"DAYS_BIRTH\" / 365.0 < 40 THEN 2 WHEN -\"DAYS_BIRTH\" / 365.0 < 50 THEN 3 "
                     "WHEN -\"DAYS_BIRTH\" / 365.0 < 65 THEN 4 WHEN -\"DAYS_BIRTH\" / 365.0 < 99 THEN 5 ELSE 0 END",
        "AMT_MISSING_FIELDS": " + ".join(f"CAST({q(c)} IS NULL AS INTEGER)" for c in columns_of("application")),
    }
    cols = _derived("a0", "a1", X.APPLICATION_RATIOS, X.APPLICATION_DIFFERENCES, extra)
    groups = []
    for n_, (c, f) in X.GROUP_STATISTICS.items():
        call = f"median({q(c)})" if f == "median" else agg_sql(f, q(c))
        groups.append(f"CASE WHEN \"OCCUPATION_TYPE\" IS NOT NULL THEN {call} OVER w END AS {q(n_)}")
    return (
        f"a0 AS (SELECT *, {mu} AS mu FROM {source}), {cols}, {name} AS (SELECT * EXCLUDE (mu), {', '.join(groups)} "
        f"FROM a1 WINDOW w AS (PARTITION BY {split}{names_sql(X.GROUP_KEYS)}))"
    )


@query("g9_application_features", f"WITH {credit_sql('application')}, {_application_sql('out')} SELECT * FROM out")
def g_application(spark, d):
    return application_features(credit(spark, d, "application"))


_PARTS = ("bureau", "cash", "credit", "installments", "previous")
_BUILDERS = {
    "bureau": _bureau_sql, "cash": _cash_sql, "credit": _card_sql, "installments": _instalment_sql, "previous": _previous_sql,
}


def _wide_sql(source: str = "application", name: str | None = None) -> str:
    ctes = [credit_sql("application", "bureau", "bureau_balance", "cash", "credit", "installments", "previous")]
    ctes += [build(f"out_{n}") for n, build in _BUILDERS.items()]
    if source != "application":
        ctes.append(source)
        ctes.append(_application_sql("out_app", name or source.split(" ")[0], "in_train, "))
    else:
        ctes.append(_application_sql("out_app"))
    joins = " ".join(f"LEFT JOIN out_{n} ON out_app.\"SK_ID_CURR\" = out_{n}.\"SK_ID_CURR\"" for n in _PARTS)
    columns = ", ".join(f"out_{n}.* EXCLUDE (\"SK_ID_CURR\")" for n in _PARTS)
    ctes.append(f"wide AS (SELECT out_app.*, {columns} FROM out_app {joins})")
    posts = ", ".join(f"{ratio_sql(q(a), q(b))} AS {q(n)}" for n, (a, b) in X.CROSS_TABLE_RATIOS.items())
    return f"WITH {', '.join(ctes)} SELECT *, {posts} FROM wide"


@query("e4_whole_feature_build", _wide_sql())
def e4(spark, d):
    tables = credit_tables(spark, base(spark, d))
    parts = child_features(tables, SHARE_COLUMNS, CARD_TIES)
    return cross_table_ratios(attach(application_features(tables["application"]), list(parts.values()), CUSTOMER))


_SPLITS = f"split_rows AS (SELECT *, {bucket_sql(q('SK_ID_CURR'), 1000, 666)} < 750 AS in_train FROM application)"


@query("e4_split_build", _wide_sql(_SPLITS))
def e4b(spark, d):
    """Train and test built together: group statistics stay within each split."""
    from ..models.training import hold_out

    tables = credit_tables(spark, base(spark, d))
    train, test = hold_out(tables["application"], CUSTOMER, 0.75)
    a, b = build_features(
        train.withColumn("in_train", F.lit(True)), test.withColumn("in_train", F.lit(False)), tables,
        shares_of=SHARE_COLUMNS, drop_useless=False, card_ties=CARD_TIES,
    )
    return a.unionByName(b)


_PLANTED = {"PLANTED_CONSTANT": "7", "PLANTED_SPARSE": 'CASE WHEN "SK_ID_CURR" % 50 = 0 THEN 1e0 END'}
_PLANTED_SPLITS = (
    f"planted AS (SELECT *, {', '.join(f'{x} AS {q(c)}' for c, x in _PLANTED.items())} FROM application), "
    f"split_rows AS (SELECT *, {bucket_sql(q('SK_ID_CURR'), 1000, 666)} < 750 AS in_train FROM planted)"
)


def _kept_sql() -> str:
    """Names of the columns of the train rows of the wide frame that are neither mostly missing nor of one value."""
    wide = _wide_sql(_PLANTED_SPLITS, "split_rows")
    return f"""{wide[: wide.rindex(' SELECT *, ')]},
    train AS (SELECT * EXCLUDE ("in_train", "TARGET", "SK_ID_CURR") FROM wide WHERE in_train),
    s AS (UNPIVOT (SELECT {{'n': count(COLUMNS(*)), 'same': min(COLUMNS(*)) IS NOT DISTINCT FROM max(COLUMNS(*))}} FROM train)
      ON COLUMNS(*) INTO NAME "column" VALUE state)
    SELECT "column" FROM s, (SELECT count(*) AS rows FROM train)
    WHERE state.n > 0 AND (rows - state.n) / rows <= 0.97 AND NOT (state.same AND state.n = rows)
    UNION ALL SELECT unnest(['SK_ID_CURR', 'TARGET', {', '.join(f"'{n}'" for n in X.CROSS_TABLE_RATIOS)}])"""


@query("e4_build_without_useless", _kept_sql())
def e4c(spark, d):
    """Columns of the train frame once useless ones are dropped, of a parent with a constant and a sparse column."""
    from ..models.training import hold_out

    tables = credit_tables(spark, base(spark, d))
    planted = {"PLANTED_CONSTANT": F.lit(7), "PLANTED_SPARSE": F.when(F.col(CUSTOMER) % 50 == 0, 1.0)}
    train, test = hold_out(tables["application"].withColumns(planted), CUSTOMER, 0.75)
    a, b = build_features(train, test, tables, shares_of=SHARE_COLUMNS, card_ties=CARD_TIES)
    if a.columns != b.columns:
        raise ValueError("train and test have different columns")
    # names alone are told, but from the rows: a column without any value would not be told
    return a.agg(*[F.count(F.lit(1)).alias(c) for c in a.columns]).unpivot([], a.columns, "column", "n").select("column")


# --- entities and relationships ------------------------------------------------------


def star_entities(spark, d) -> EntitySet:
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey"}
    es = EntitySet("star")
    for n, k in keys.items():
        es.add(Entity(n, table(spark, d, n), k, "o_orderdate" if n == "orders" else None))
    es.add(Entity("lineitem", table(spark, d, "lineitem"), "line_index", "l_shipdate", made_index=True))
    return es.relate(
        *chain(
            ["region", "nation", "customer", "orders", "lineitem"],
            [("r_regionkey", "n_regionkey"), ("n_nationkey", "c_nationkey"), ("c_custkey", "o_custkey"), ("o_orderkey", "l_orderkey")],
        )
    )


_INDEXES = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey"}


@query(
    "e1_entity_index_check",
    " UNION ALL ".join(
        f"SELECT '{t}' AS entity, CAST({k} AS VARCHAR) AS key, count(*) AS count FROM {t} GROUP BY {k} HAVING count(*) > 1"
        for t, k in [*_INDEXES.items(), ("(SELECT row_number() OVER () AS line_index FROM lineitem)", "line_index")]
    ).replace("'(SELECT row_number() OVER () AS line_index FROM lineitem)'", "'lineitem'"),
)
def e1(spark, d):
    """Keys that occur more than once, of all five entities."""
    es = star_entities(spark, d)
    out = None
    for name, entity in es.entities.items():
        key = F.col(entity.key).cast("string").alias("key")
        part = es.duplicate_keys(name).select(F.lit(name).alias("entity"), key, "count")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "e1_made_index",
    "SELECT count(*) AS row_count, count(*) AS distinct_keys FROM lineitem",
)
def e1b(spark, d):
    lines = star_entities(spark, d).entities["lineitem"].frame()
    return lines.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("line_index").alias("distinct_keys"))


def _relation_sql(parent: str, pk: str, child: str, ck: str) -> str:
    return f"""SELECT '{parent}-{child}' AS relationship, count(*) AS child_rows,
    count(*) FILTER (WHERE {ck} NOT IN (SELECT {pk} FROM {parent})) AS orphans FROM {child}"""


@query(
    "e2_relationship_check",
    " UNION ALL ".join(
        [
            _relation_sql("region", "r_regionkey", "nation", "n_regionkey"),
            _relation_sql("nation", "n_nationkey", "customer", "c_nationkey"),
            _relation_sql("customer", "c_custkey", "orders", "o_custkey"),
            _relation_sql("orders", "o_orderkey", "lineitem", "l_orderkey"),
            _relation_sql("customer", "c_custkey", "events", "user_id"),
        ]
    ),
)
def e2(spark, d):
    es = star_entities(spark, d).add(Entity("events", table(spark, d, "events"), "event_id", "ts"))
    return es.relate(Relationship("customer", "c_custkey", "events", "user_id")).report()


_ROLL_SPECS = {
    "nation": {"CUST_ORD_LINE_l_extendedprice_SUM_SUM_SUM": ["sum"], "CUST_c_acctbal_MEAN": ["max"], "n_nationkey": ["size"]},
    "customer": {"ORD_LINE_l_extendedprice_SUM_SUM": ["sum"], "c_acctbal": ["mean"], "c_custkey": ["size"]},
    "orders": {"LINE_l_extendedprice_SUM": ["sum", "mean"], "o_totalprice": ["max"]},
    "lineitem": {"l_extendedprice": ["sum"], "l_discount": ["mean"]},
}
_ROLL_PREFIX = {"nation": "NAT_", "customer": "CUST_", "orders": "ORD_", "lineitem": "LINE_"}
_EDGES = [
    ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("customer", "c_custkey", "orders", "o_custkey"),
    ("nation", "n_nationkey", "customer", "c_nationkey"), ("region", "r_regionkey", "nation", "n_regionkey"),
]


def _roll_sql() -> str:
    ctes, source = [], "lineitem"
    for i, (parent, pk, child, ck) in enumerate(_EDGES):
        ctes.append(slices_sql(source, ck, [(_ROLL_PREFIX[child], _ROLL_SPECS[child], None)], name=f"f{i}"))
        ctes.append(f"p{i} AS (SELECT {parent}.*, f{i}.* EXCLUDE ({ck}) FROM {parent} LEFT JOIN f{i} ON {pk} = f{i}.{ck})")
        source = f"p{i}"
    return f"WITH {', '.join(ctes)} SELECT * FROM p{len(_EDGES) - 1}"


@query("e3_relationship_roll_up", _roll_sql())
def e3(spark, d):
    return star_entities(spark, d).roll_up("region", _ROLL_SPECS, _ROLL_PREFIX)
