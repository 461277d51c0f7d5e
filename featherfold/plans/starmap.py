"""The credit tables as views over an order/customer star schema.

Lets the whole feature build run on any data set with customers, orders, line
items and events.  Each table is one SELECT, written so that it reads the same in
Spark SQL and in other ANSI engines; ``days`` is the only dialect-bound function.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

ANCHOR = "2001-12-01"

_DAYS = {
    "spark": "datediff(CAST({c} AS DATE), DATE'" + ANCHOR + "')",
    "duckdb": "CAST(date_diff('day', DATE '" + ANCHOR + "', CAST({c} AS DATE)) AS INTEGER)",
}
_QUOTE = {"spark": "`", "duckdb": '"'}


def _flags(prefix: str, cases: Mapping[str, str]) -> dict[str, str]:
    return {f"{prefix}{n}": f"CASE WHEN {cond} THEN 1 ELSE 0 END" for n, cond in cases.items()}


def _application() -> dict[str, str]:
    k = "c_custkey"
    out = {
        "SK_ID_CURR": k,
        "TARGET": "CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END",
        "AMT_INCOME_TOTAL": "(c_acctbal + 1.1e3) * 1.2e1",
        "AMT_CREDIT": f"({k} * 7919 % 1000) * 4.5e2 + 4.5e4",
        "AMT_ANNUITY": f"NULLIF(({k} * 31 % 97) * 2.5e2, 0)",
        "AMT_GOODS_PRICE": f"({k} * 7919 % 1000) * 4e2 + 4e4",
        "EXT_SOURCE_1": f"CASE WHEN {k} % 3 <> 0 THEN ({k} * 17 % 101) / 1e2 END",
        "EXT_SOURCE_2": f"(c_acctbal + 1e3) / 1.2e4 + ({k} * 13 % 7) / 5e1",
        "EXT_SOURCE_3": f"CASE WHEN {k} % 5 <> 0 THEN ({k} * 19 % 103) / 1e2 END",
        "OWN_CAR_AGE": f"CASE WHEN c_nationkey % 2 = 0 THEN {k} % 20 END",
        "DAYS_BIRTH": f"-(7500 + {k} * 37 % 18000)",
        "DAYS_EMPLOYED": f"CASE WHEN {k} % 11 <> 0 THEN -({k} * 53 % 7000) END",
        "DAYS_LAST_PHONE_CHANGE": f"-({k} * 29 % 4000)",
        "DAYS_REGISTRATION": f"-({k} * 41 % 9000)",
        "DAYS_ID_PUBLISH": f"-({k} * 43 % 6000)",
        "CNT_FAM_MEMBERS": f"1 + {k} % 5",
        "CNT_CHILDREN": f"{k} % 4",
        "OBS_30_CNT_SOCIAL_CIRCLE": f"{k} * 3 % 11",
        "OBS_60_CNT_SOCIAL_CIRCLE": f"{k} * 3 % 10",
        "ORGANIZATION_TYPE": "c_mktsegment",
        "NAME_EDUCATION_TYPE": "CASE WHEN c_nationkey % 3 = 0 THEN 'Higher' ELSE 'Secondary' END",
        "OCCUPATION_TYPE": f"CASE WHEN {k} % 7 <> 0 THEN (CASE WHEN c_nationkey % 2 = 0 THEN 'Core' ELSE 'Sales' END) END",
        "CODE_GENDER": f"CASE WHEN {k} % 2 = 0 THEN 'F' ELSE 'M' END",
    }
    out |= _flags("FLAG_", {"OWN_CAR": "c_nationkey % 2 = 0", "EMAIL": f"{k} % 9 = 0", "PHONE": f"{k} % 4 = 1"})
    out |= _flags("FLAG_DOCUMENT_", {str(i): f"({k} + {i}) % {i + 7} = 1" for i in range(2, 22)})
    return out


def _bureau() -> dict[str, str]:
    k = "o_orderkey"
    days = "{days:o_orderdate}"
    out = {
        "SK_ID_BUREAU": k,
        "SK_ID_CURR": "o_custkey",
        "DAYS_CREDIT": days,
        "DAYS_CREDIT_ENDDATE": f"CASE WHEN {k} % 13 <> 0 THEN {days} + {k} * 17 % 900 END",
        "DAYS_ENDDATE_FACT": f"CASE WHEN o_orderstatus = 'F' THEN {days} + {k} * 7 % 800 END",
        "DAYS_CREDIT_UPDATE": f"{days} + {k} % 60",
        "CREDIT_DAY_OVERDUE": f"CASE WHEN {k} % 17 = 0 THEN {k} % 90 ELSE 0 END",
        "AMT_CREDIT_MAX_OVERDUE": f"CASE WHEN {k} % 4 <> 0 THEN ({k} * 11 % 50) * 1e1 END",
        "AMT_CREDIT_SUM": "o_totalprice",
        "AMT_CREDIT_SUM_DEBT": f"CASE WHEN {k} % 5 <> 0 THEN ({k} % 5 - 1) * 1.5e4 END",
        "AMT_CREDIT_SUM_OVERDUE": f"CASE WHEN {k} % 10 = 3 THEN ({k} * 3 % 100) * 1e1 ELSE 0e0 END",
        "AMT_CREDIT_SUM_LIMIT": f"CASE WHEN {k} % 3 <> 0 THEN ({k} * 23 % 40) * 5e2 END",
        "AMT_ANNUITY": f"CASE WHEN {k} % 6 <> 0 THEN ({k} * 29 % 31) * 1e3 END",
        "CNT_CREDIT_PROLONG": f"CASE WHEN {k} % 19 = 0 THEN 1 ELSE 0 END",
    }
    status = {"Active": "O", "Closed": "F", "Sold": "P"}
    out |= _flags("CREDIT_ACTIVE_", {n: f"o_orderstatus = '{s}'" for n, s in status.items()})
    kinds = {
        "Consumer credit": "1-URGENT", "Credit card": "2-HIGH", "Mortgage": "3-MEDIUM",
        "Car loan": "4-NOT SPECIFIED", "Microloan": "5-LOW",
    }
    out |= _flags("CREDIT_TYPE_", {n: f"o_orderpriority = '{p}'" for n, p in kinds.items()})
    return out


def _balance() -> dict[str, str]:
    out = {"SK_ID_BUREAU": "l_orderkey", "MONTHS_BALANCE": "-(l_linenumber * 5 + l_suppkey % 5)"}
    codes = {"0": "< 20", "1": "BETWEEN 20 AND 24", "2": "BETWEEN 25 AND 28", "3": "= 29", "4": "= 30", "5": "= 31",
             "C": "BETWEEN 32 AND 40", "X": "> 40"}
    return out | _flags("STATUS_", {n: f"l_quantity {test}" for n, test in codes.items()})


def _previous() -> dict[str, str]:
    k = "o_orderkey"
    days = "{days:o_orderdate}"
    out = {
        "SK_ID_PREV": k,
        "SK_ID_CURR": "o_custkey",
        "AMT_APPLICATION": f"o_totalprice + ({k} * 3 % 21 - 10) * 1e3",
        "AMT_CREDIT": f"CASE WHEN {k} % 23 <> 0 THEN o_totalprice ELSE 0e0 END",
        "AMT_ANNUITY": f"CASE WHEN {k} % 8 <> 0 THEN 1e3 + ({k} * 37 % 101) * 1e2 END",
        "AMT_DOWN_PAYMENT": f"CASE WHEN {k} % 2 = 0 THEN ({k} * 5 % 60) * 1e2 END",
        "AMT_GOODS_PRICE": f"CASE WHEN {k} % 9 <> 0 THEN 5e3 + ({k} * 41 % 301) * 1e3 END",
        "HOUR_APPR_PROCESS_START": f"{k} * 7 % 24",
        "RATE_DOWN_PAYMENT": f"CASE WHEN {k} % 2 = 0 THEN ({k} * 5 % 60) / 1e2 END",
        "RATE_INTEREST_PRIMARY": f"CASE WHEN {k} % 12 = 0 THEN ({k} % 7) / 1e1 END",
        "RATE_INTEREST_PRIVILEGED": f"CASE WHEN {k} % 12 = 0 THEN ({k} % 11) / 1e1 END",
        "DAYS_DECISION": days,
        "DAYS_FIRST_DRAWING": f"CASE WHEN {k} % 3 = 0 THEN 365243 ELSE {days} + {k} % 30 END",
        "DAYS_FIRST_DUE": f"CASE WHEN {k} % 7 = 0 THEN 365243 ELSE {days} + 30 END",
        "DAYS_LAST_DUE_1ST_VERSION": f"CASE WHEN {k} % 5 = 0 THEN 365243 ELSE {days} + {k} * 3 % 400 END",
        "DAYS_LAST_DUE": f"CASE WHEN {k} % 4 = 0 THEN 365243 ELSE {days} + {k} * 3 % 380 END",
        "DAYS_TERMINATION": f"CASE WHEN {k} % 6 = 0 THEN 365243 ELSE {days} + {k} * 3 % 420 END",
        "CNT_PAYMENT": f"CASE WHEN {k} % 10 <> 0 THEN {k} % 9 * 6 END",
    }
    out |= _flags(
        "NAME_CONTRACT_STATUS_",
        {"Approved": "o_orderstatus = 'F'", "Refused": "o_orderstatus = 'P'", "Canceled": "o_orderstatus = 'O'"},
    )
    return out | _flags(
        "NAME_CONTRACT_TYPE_",
        {"Consumer loans": f"{k} % 3 = 0", "Cash loans": f"{k} % 3 = 1", "Revolving loans": f"{k} % 3 = 2"},
    )


def _instalments() -> dict[str, str]:
    due = "({days:l_shipdate} - 200)"
    return {
        "SK_ID_PREV": "l_orderkey",
        "SK_ID_CURR": "o_custkey",
        "NUM_INSTALMENT_VERSION": "l_linenumber % 3",
        "DAYS_INSTALMENT": due,
        "DAYS_ENTRY_PAYMENT": f"CASE WHEN l_partkey % 29 <> 0 THEN {due} + l_partkey % 41 - 20 END",
        "AMT_INSTALMENT": "CASE WHEN l_suppkey % 37 <> 0 THEN l_extendedprice ELSE 0e0 END",
        "AMT_PAYMENT": "CASE WHEN l_partkey % 29 <> 0 THEN l_extendedprice * (1e0 - l_discount) END",
    }


def _cash() -> dict[str, str]:
    out = {
        "SK_ID_PREV": "l_orderkey",
        "SK_ID_CURR": "o_custkey",
        "MONTHS_BALANCE": "-(l_partkey % 96)",
        "CNT_INSTALMENT": "CASE WHEN l_suppkey % 31 <> 0 THEN l_linenumber * 6 END",
        "CNT_INSTALMENT_FUTURE": "CASE WHEN l_suppkey % 31 <> 0 THEN l_partkey % 24 END",
        "SK_DPD": "CASE WHEN l_partkey % 10 = 7 THEN l_suppkey % 30 ELSE 0 END",
        "SK_DPD_DEF": "CASE WHEN l_partkey % 20 = 7 THEN l_suppkey % 15 ELSE 0 END",
    }
    return out | _flags("NAME_CONTRACT_STATUS_", {"Completed": "l_returnflag = 'R'", "Active": "l_returnflag <> 'R'"})


def _card() -> dict[str, str]:
    k = "event_id"
    kind = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
    return {
        "ROW_ID": k,
        "SK_ID_CURR": "user_id",
        "SK_ID_PREV": f"user_id * 5 + {kind}",
        "MONTHS_BALANCE": f"-({k} * 7 % 96)",
        "AMT_BALANCE": "value * 1e2",
        "AMT_CREDIT_LIMIT_ACTUAL": f"({k} * 3 % 10) * 4.5e3",
        "AMT_DRAWINGS_ATM_CURRENT": f"CASE WHEN {k} % 6 <> 0 THEN ({k} % 5) * 2.5e2 END",
        "AMT_DRAWINGS_CURRENT": f"({k} % 5) * 2.5e2 + ({k} % 7) * 1e2",
        "AMT_DRAWINGS_OTHER_CURRENT": f"CASE WHEN {k} % 6 <> 0 THEN ({k} % 3) * 1e1 END",
        "AMT_DRAWINGS_POS_CURRENT": f"CASE WHEN {k} % 6 <> 0 THEN ({k} % 7) * 1e2 END",
        "AMT_INST_MIN_REGULARITY": f"({k} * 11 % 8) * 1.5e2",
        "AMT_PAYMENT_CURRENT": f"CASE WHEN {k} % 8 <> 0 THEN value * 3e1 END",
        "AMT_PAYMENT_TOTAL_CURRENT": "value * 2.5e1",
        "AMT_RECEIVABLE_PRINCIPAL": "value * 9e1",
        "AMT_RECIVABLE": "value * 9.5e1",
        "AMT_TOTAL_RECEIVABLE": "value * 9.6e1",
        "CNT_DRAWINGS_ATM_CURRENT": f"CASE WHEN {k} % 6 <> 0 THEN {k} % 5 END",
        "CNT_DRAWINGS_CURRENT": f"{k} % 5 + {k} % 7 + {k} % 3",
        "CNT_DRAWINGS_OTHER_CURRENT": f"CASE WHEN {k} % 6 <> 0 THEN {k} % 3 END",
        "CNT_DRAWINGS_POS_CURRENT": f"CASE WHEN {k} % 6 <> 0 THEN {k} % 7 END",
        "CNT_INSTALMENT_MATURE_CUM": f"CASE WHEN {k} % 14 <> 0 THEN {k} % 33 END",
        "SK_DPD": f"CASE WHEN {k} % 15 = 2 THEN {k} % 40 ELSE 0 END",
        "SK_DPD_DEF": f"CASE WHEN {k} % 30 = 2 THEN {k} % 20 ELSE 0 END",
        "NAME_CONTRACT_STATUS_Active": "CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END",
    }


_ITEMS = "{lineitem} JOIN {orders} ON l_orderkey = o_orderkey"
_TABLES = {
    "application": (_application, "{customer}"),
    "bureau": (_bureau, "{orders}"),
    "bureau_balance": (_balance, "{lineitem}"),
    "previous": (_previous, "{orders}"),
    "installments": (_instalments, _ITEMS),
    "cash": (_cash, _ITEMS),
    "credit": (_card, "{events}"),
}

# 0/1 columns of each table, so that no profiling pass is needed to find them
SHARE_COLUMNS = {
    "bureau": [n for n in _bureau() if n.startswith(("CREDIT_ACTIVE_", "CREDIT_TYPE_"))] + ["CNT_CREDIT_PROLONG"],
    "bureau_balance": [n for n in _balance() if n.startswith("STATUS_")],
    "previous": [n for n in _previous() if n.startswith("NAME_CONTRACT_")],
    "installments": ["LATE_PAYMENT", "SIGNIFICANT_LATE_PAYMENT", "DPD_7", "DPD_15"],
    "cash": ["NAME_CONTRACT_STATUS_Completed", "NAME_CONTRACT_STATUS_Active", "LATE_PAYMENT"],
    "credit": ["NAME_CONTRACT_STATUS_Active", "LATE_PAYMENT"],
}
CARD_TIES = ["ROW_ID"]


def columns_of(table: str) -> list[str]:
    return list(_TABLES[table][0]())


def select_text(table: str, dialect: str) -> str:
    """SELECT text of one credit table; base tables stay as ``{name}`` place-holders."""
    columns, source = _TABLES[table]
    q = _QUOTE[dialect]
    items = []
    for name, expr in columns().items():
        for c in ("o_orderdate", "l_shipdate"):
            expr = expr.replace("{days:" + c + "}", _DAYS[dialect].format(c=c))
        items.append(f"{expr} AS {q}{name}{q}")
    return f"SELECT {', '.join(items)} FROM {source}"


def base_tables_of(table: str) -> list[str]:
    """The star-schema tables one credit table is read from."""
    return re.findall(r"{(\w+)}", _TABLES[table][1])


def credit_table(spark: SparkSession, table: str, base: Mapping[str, DataFrame]) -> DataFrame:
    """One credit table over the star-schema frames in ``base``."""
    return spark.sql(select_text(table, "spark"), **{n: base[n] for n in base_tables_of(table)})


def credit_tables(spark: SparkSession, base: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {t: credit_table(spark, t, base) for t in _TABLES}
