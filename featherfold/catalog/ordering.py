"""Ordered operators, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.aggregate import Slice, aggregate, aggregate_unfused, roll_up
from ..operators.combine import (
    attach, common_names, join_scores, keep_members, left_join_suffixed, stack_splits,
    with_borrowed_columns,
)
from ..operators.ordered import (
    first_value, head_and_rest, last_rows, last_value, latest_row, number_rows, row_slice, tag_groups, top_k,
)
from ..plans import fixed as X
from ..plans.credit import CUSTOMER, LOAN, application_columns
from .base import credit, credit_sql, names_sql, q, query, table

_TIES = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice"]


@query(
    "w1_last_value_by_date",
    """SELECT o_custkey, last(o_totalprice ORDER BY o_orderdate, o_totalprice) AS last_price FROM orders GROUP BY o_custkey""",
)
def w1(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(last_value("o_totalprice", ["o_orderdate"]).alias("last_price"))


@query(
    "w2_latest_row_per_key",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_shipdate DESC, {', '.join(_TIES)}) AS rn FROM lineitem) WHERE rn = 1""",
)
def w2(spark, d):
    rows = latest_row(table(spark, d, "lineitem").select(*_LINE), ["l_orderkey"], "l_shipdate", _TIES)
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


@query(
    "w3_last_rows_mean",
    """SELECT o_custkey, avg(o_totalprice) AS recent_mean FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders) WHERE rn <= 3 GROUP BY o_custkey""",
)
def w3(spark, d):
    rows = last_rows(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3)
    return rows.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("recent_mean"))


@query(
    "w4_latest_rows_aggregate",
    f"""WITH {credit_sql('credit')}, r AS (SELECT *, row_number() OVER (PARTITION BY "SK_ID_PREV" ORDER BY "MONTHS_BALANCE" DESC, "ROW_ID") AS rn FROM credit)
    SELECT "SK_ID_CURR", avg("AMT_BALANCE") AS "CC_LAST_AMT_BALANCE_MEAN", max("AMT_BALANCE") AS "CC_LAST_AMT_BALANCE_MAX" FROM r WHERE rn = 1 GROUP BY "SK_ID_CURR" """,
)
def w4(spark, d):
    rows = latest_row(credit(spark, d, "credit"), [LOAN], "MONTHS_BALANCE", ["ROW_ID"])
    return aggregate(rows, CUSTOMER, [Slice(X.CARD_LAST_SPEC, "CC_LAST_")])


@query(
    "w5_first_and_last_value",
    f"""WITH {credit_sql('cash')} SELECT "SK_ID_PREV", first("CNT_INSTALMENT" ORDER BY "MONTHS_BALANCE", "CNT_INSTALMENT") FILTER (WHERE "CNT_INSTALMENT" IS NOT NULL) AS first_count,
    last("CNT_INSTALMENT" ORDER BY "MONTHS_BALANCE", "CNT_INSTALMENT") FILTER (WHERE "CNT_INSTALMENT" IS NOT NULL) AS last_count FROM cash GROUP BY "SK_ID_PREV" """,
)
def w5(spark, d):
    month = ["MONTHS_BALANCE"]
    return credit(spark, d, "cash").groupBy(LOAN).agg(
        first_value("CNT_INSTALMENT", month).alias("first_count"), last_value("CNT_INSTALMENT", month).alias("last_count")
    )



@query(
    "w6_same_group_number",
    """WITH k AS (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem),
    n AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('-', CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), '0'))) AS group_id FROM k)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, group_id FROM lineitem JOIN n USING (l_suppkey, l_linenumber)""",
)
def w6(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return tag_groups(df, ["l_suppkey", "l_linenumber"], "group_id")


def _ages(a: str) -> str:
    return ", ".join(f"{q(x)} - {q(y)} AS {q(n)}" for n, (x, y) in X.APPLICATION_DIFFERENCES.items() if n.startswith("AGE_"))


@query(
    "w6_same_user_tag",
    f"""WITH {credit_sql('application')}, a AS (SELECT "SK_ID_CURR", {_ages('a')} FROM application),
    k AS (SELECT DISTINCT {names_sql(X.SAME_USER_KEYS)} FROM a WHERE {' AND '.join(f'{q(c)} IS NOT NULL' for c in X.SAME_USER_KEYS)}),
    n AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('-', {', '.join(f'CAST({q(c)} AS VARCHAR)' for c in X.SAME_USER_KEYS)}, '0'))) AS "USER_ID" FROM k)
    SELECT "SK_ID_CURR", "USER_ID" FROM a LEFT JOIN n USING ({names_sql(X.SAME_USER_KEYS)})""",
)
def w6b(spark, d):
    return tag_groups(application_columns(credit(spark, d, "application")), X.SAME_USER_KEYS, "USER_ID").select(CUSTOMER, "USER_ID")


@query("w7_sorted", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def w7(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


@query("w8_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 320")
def w8(spark, d):
    return top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 320, ["o_orderkey"])


@query("w9_row_slice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 50")
def w9(spark, d):
    return row_slice(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 50, 100)


@query("w9_all_but_head", "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE rn > 1000")
def w9b(spark, d):
    return head_and_rest(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000)[1]


@query(
    "w_seeded_shuffle_numbers",
    "SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws('-', CAST(o_orderkey AS VARCHAR), '7'))) AS position FROM orders",
)
def w_shuffle(spark, d):
    return number_rows(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "position", 7)


# --- joins --------------------------------------------------------------------------


@query(
    "j1_features_to_parent",
    """WITH o AS (SELECT o_custkey, count(*) AS "ORD_o_orderkey_SIZE" FROM orders GROUP BY o_custkey),
    e AS (SELECT user_id, avg(value) AS "EV_value_MEAN" FROM events GROUP BY user_id)
    SELECT c_custkey, c_name, "ORD_o_orderkey_SIZE", "EV_value_MEAN" FROM customer LEFT JOIN o ON c_custkey = o_custkey LEFT JOIN e ON c_custkey = user_id""",
)
def j1(spark, d):
    o = aggregate(table(spark, d, "orders"), "o_custkey", [Slice({"o_orderkey": ["size"]}, "ORD_")])
    e = aggregate(table(spark, d, "events"), "user_id", [Slice({"value": ["mean"]}, "EV_")])
    parent = table(spark, d, "customer").select("c_custkey", "c_name")
    return attach(parent, [o.withColumnRenamed("o_custkey", "c_custkey"), e.withColumnRenamed("user_id", "c_custkey")], "c_custkey")


_J2 = {"l_quantity": ["mean", "max"]}


@query(
    "j2_aggregates_joined_unfused",
    """WITH a AS (SELECT l_suppkey, avg(l_quantity) AS "ALL_l_quantity_MEAN", max(l_quantity) AS "ALL_l_quantity_MAX" FROM lineitem GROUP BY l_suppkey),
    r AS (SELECT l_suppkey, avg(l_quantity) AS "RET_l_quantity_MEAN", max(l_quantity) AS "RET_l_quantity_MAX" FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey)
    SELECT * FROM a LEFT JOIN r USING (l_suppkey)""",
)
def j2(spark, d):
    slices = [Slice(_J2, "ALL_"), Slice(_J2, "RET_", "l_returnflag = 'R'")]
    return aggregate_unfused(table(spark, d, "lineitem"), "l_suppkey", slices)


@query("j3_semi_join", "SELECT * FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def j3(spark, d):
    nations = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return keep_members(table(spark, d, "supplier"), nations, "s_nationkey").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query(
    "j4_right_join",
    "SELECT c_custkey, event_id, value FROM (SELECT * FROM events WHERE event_type = 'error') e RIGHT JOIN customer ON user_id = c_custkey",
)
def j4(spark, d):
    errors = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("c_custkey"), "event_id", "value")
    return errors.join(table(spark, d, "customer").select("c_custkey"), "c_custkey", "right")


@query(
    "j5_suffixed_join",
    f"""WITH {credit_sql('previous', 'application')} SELECT p."SK_ID_CURR", "SK_ID_PREV", p."AMT_CREDIT" AS "AMT_CREDIT_l", a."AMT_CREDIT" AS "AMT_CREDIT_r", a."TARGET"
    FROM previous p LEFT JOIN application a ON p."SK_ID_CURR" = a."SK_ID_CURR" """,
)
def j5(spark, d):
    left = credit(spark, d, "previous").select("SK_ID_CURR", "SK_ID_PREV", "AMT_CREDIT")
    right = credit(spark, d, "application").select("SK_ID_CURR", "AMT_CREDIT", "TARGET")
    return left_join_suffixed(left, right, CUSTOMER)


@query(
    "j6_borrowed_text_columns",
    f"""WITH {credit_sql('application')} SELECT "SK_ID_CURR", "AMT_CREDIT", {names_sql(X.GROUP_TEXTS)} FROM application""",
)
def j6(spark, d):
    raw = credit(spark, d, "application")
    return with_borrowed_columns(raw.select(CUSTOMER, "AMT_CREDIT"), raw, CUSTOMER, X.GROUP_TEXTS)


@query(
    "j7_one_to_many",
    """SELECT o_orderkey, o_custkey, l_partkey, l_suppkey, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""",
)
def j7(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey", "l_quantity")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left")


def model_scores(spark, d):
    """Five score tables derived from the customers, some of them incomplete."""
    c = table(spark, d, "customer")
    x = F.col("c_acctbal")
    return {
        "LGB": c.select("c_custkey", ((x + 1000) / 12000).alias("LGB")),
        "XG": c.select("c_custkey", (1 - (x + 1000) / 12000 + F.col("c_nationkey") / 100).alias("XG")),
        "CB": c.where(F.col("c_nationkey") > 2).select("c_custkey", (F.col("c_custkey") % 17 / 17).alias("CB")),
        "ET": c.where(F.col("c_mktsegment") != "BUILDING").select("c_custkey", (F.col("c_nationkey") / 25).alias("ET")),
        "RF": c.select("c_custkey", (F.col("c_custkey") % 11 / 11).alias("RF")),
    }


SCORES_SQL = """scores AS (SELECT c_custkey, (c_acctbal + 1000) / 12000 AS "LGB", 1 - (c_acctbal + 1000) / 12000 + c_nationkey / 1e2 AS "XG",
    CASE WHEN c_nationkey > 2 THEN c_custkey % 17 / 17e0 END AS "CB", CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey / 25e0 END AS "ET",
    c_custkey % 11 / 11e0 AS "RF" FROM customer)"""


@query("j8_scores_by_id", f"WITH {SCORES_SQL} SELECT c_custkey, \"LGB\" * 0.5 + \"RF\" * 0.5 AS score FROM scores")
def j8(spark, d):
    s = model_scores(spark, d)
    joined = join_scores({"LGB": s["LGB"], "RF": s["RF"]}, "c_custkey")
    return joined.select("c_custkey", (F.col("LGB") * 0.5 + F.col("RF") * 0.5).alias("score"))


@query("j9_multi_model_join", f"WITH {SCORES_SQL} SELECT * FROM scores")
def j9(spark, d):
    return join_scores(model_scores(spark, d), "c_custkey", table(spark, d, "customer").select("c_custkey"))


# --- set operations -------------------------------------------------------------------


@query(
    "u1_union_rows",
    """SELECT c_custkey AS id, c_acctbal AS balance, 'train' AS "set", 1 AS y FROM customer
    UNION ALL SELECT s_suppkey, s_acctbal, 'test', NULL FROM supplier""",
)
def u1(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit(1).alias("y"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return stack_splits(a, b, "y")


def _top_parts(spark, d):
    parts = table(spark, d, "part")
    return [top_k(parts, by, 40, ["p_partkey"]).select("p_partkey") for by in ("p_retailprice", "p_size", "p_name")]


_TOP = [f"(SELECT p_partkey FROM part ORDER BY {c} DESC, p_partkey LIMIT 40)" for c in ("p_retailprice", "p_size", "p_name")]


@query("u2_union_of_top_k", " UNION ".join(_TOP))
def u2(spark, d):
    a, b, c = _top_parts(spark, d)
    return a.union(b).union(c).distinct()


@query("u3_difference", f"({_TOP[0]} UNION {_TOP[1]}) EXCEPT {_TOP[2]}")
def u3(spark, d):
    a, b, c = _top_parts(spark, d)
    return a.union(b).distinct().join(c, "p_partkey", "left_anti")


@query(
    "u4_common_column_names",
    f"WITH {credit_sql('bureau')} SELECT \"SK_ID_CURR\", \"AMT_ANNUITY\" FROM bureau",
)
def u4(spark, d):
    left, right = credit(spark, d, "bureau"), credit(spark, d, "previous")
    common = common_names(left.columns, right.columns)
    return left.select(*common)


@query("u4_common_keys", "SELECT o_custkey AS id FROM orders INTERSECT SELECT user_id FROM events")
def u4b(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id")).intersect(
        table(spark, d, "events").select(F.col("user_id").alias("id"))
    )


@query(
    "g3_child_features_attached",
    """WITH o AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS "ORD_o_totalprice_MAX" FROM orders GROUP BY o_custkey)
    SELECT c_custkey, c_mktsegment, "ORD_o_totalprice_MAX" FROM customer LEFT JOIN o USING (c_custkey)""",
)
def g3b(spark, d):
    parent = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return roll_up(table(spark, d, "orders"), parent, "c_custkey", [Slice({"o_totalprice": ["max"]}, "ORD_")], "o_custkey")
