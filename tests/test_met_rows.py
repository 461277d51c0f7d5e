"""Rows of a key brought together once: the same results as by shuffled states, and no other shuffle."""

import math
import random

import pytest
from pyspark.sql import functions as F

from featherfold.operators.aggregate import WIDE, Slice
from featherfold.operators.partial import aggregate_by_part, merge_parts, part_states
from featherfold.operators.profile import Profiled
from featherfold.plans.credit import card_features, cash_features, instalment_features, latest_of_part
from featherfold.plans.starmap import SHARE_COLUMNS, credit_tables


@pytest.fixture(scope="module")
def star(spark):
    n = 400
    orders = spark.range(n).select(
        F.col("id").alias("o_orderkey"), F.when(F.col("id") % 40 != 7, F.col("id") % 30).alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
        (F.col("id") * 1.5).alias("o_totalprice"), F.lit("1995-01-02").cast("date").alias("o_orderdate"), F.lit("2-HIGH").alias("o_orderpriority"),
    )
    lines = spark.range(4 * n).select(
        (F.col("id") % n).alias("l_orderkey"), (F.col("id") * 7 % 101).alias("l_partkey"), (F.col("id") * 3 % 62).alias("l_suppkey"),
        (F.col("id") % 5).cast("int").alias("l_linenumber"), (F.col("id") % 50).cast("double").alias("l_quantity"), (F.col("id") * 10.0).alias("l_extendedprice"),
        F.lit(0.05).alias("l_discount"), F.when(F.col("id") % 3 == 0, "R").otherwise("N").alias("l_returnflag"), F.lit("1996-03-04").cast("date").alias("l_shipdate"),
    )
    events = spark.range(n).select(
        F.col("id").alias("event_id"), (F.col("id") % 20).alias("user_id"), F.element_at(F.lit(["click", "error", "view"]), (F.col("id") % 3 + 1).cast("int")).alias("event_type"),
        (F.col("id") % 17 * 1.25).alias("value"),
    )
    customer = spark.range(1).select(F.col("id").alias("c_custkey"), F.lit(1.0).alias("c_acctbal"), F.lit(1).alias("c_nationkey"), F.lit("M").alias("c_mktsegment"))
    return credit_tables(spark, {"orders": orders, "lineitem": lines, "events": events, "customer": customer})


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("build", [
    lambda t: cash_features(t["cash"], SHARE_COLUMNS["cash"]),
    lambda t: instalment_features(t["installments"], SHARE_COLUMNS["installments"]),
    lambda t: card_features(t["credit"], SHARE_COLUMNS["credit"], ties=["ROW_ID"]),
])
def test_child_features_shuffle_their_rows_once_by_customer(star, build):
    plan = final_plan(build(star))
    by_customer = [line for line in plan.splitlines() if "Exchange hashpartitioning(SK_ID_CURR" in line]
    assert len(by_customer) == 1 and "SK_ID_PREV" not in by_customer[0].split("hashpartitioning")[1].split(")")[0]
    assert "ReusedExchange" not in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_rows_together_give_what_shuffled_states_give(spark):
    rng = random.Random(3)
    rows = [
        (rng.choice([None, 0, 0, 0, *range(1, 30)]), rng.choice([None, 1, 2, 3]), rng.randrange(-900, 0), rng.choice([None, 1e6 + rng.gauss(0, 1)]),
         rng.choice([None, 0, 1, 2]), rng.random() < 0.5)
        for _ in range(3000)
    ] + [(99, None, None, None, None, None), (98, 1, -5, None, None, True)]
    df = spark.createDataFrame(rows, "c long, loan long, d int, x double, k long, f boolean").repartition(5)
    spec = {"x": ["min", "max", "mean", "sum", "var", "std"], "k": ["sum", "mean", "max", "min"], "f": ["mean", "sum"], "loan": ["size", "nunique"]}
    slices = [Slice({**spec, "k": [*spec["k"], "nunique"]}, doubles=True), *[Slice(spec, f"L{m}_", f"seen >= {-m}") for m in (5, 200, 700)]]
    assert sum(len(s.outputs()) for s in slices) >= WIDE
    extra = {"seen": latest_of_part("loan", "d")}
    made = aggregate_by_part(df, "c", "loan", slices, extra)
    want = merge_parts(part_states(df, "c", "loan", slices, extra), "c", "loan", slices, list(extra))
    assert made.dtypes == want.dtypes
    got, wanted = ({r["c"]: r.asDict() for r in x.collect()} for x in (made, want))
    assert set(got) == set(wanted) and {98, 99} <= set(got)
    for c, row in wanted.items():
        for name, value in row.items():
            mine = got[c][name]
            assert mine == value or math.isclose(mine, value, rel_tol=1e-9, abs_tol=1e-9), (c, name, mine, value)


def test_stored_profiles_write_wide_frames_by_generated_code(spark, monkeypatch):
    name, seen = "spark.sql.codegen.maxFields", []
    before = spark.conf.get(name)
    wide = spark.range(10).select("id", *[F.lit(i).alias(f"x{i}") for i in range(150)])
    writer = type(wide.write)
    inner = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, *a, **b: seen.append(int(spark.conf.get(name))) or inner(self, *a, **b))
    assert Profiled(wide, "profile-test", skip=("id",)).rows == 10
    assert seen[0] > 150 and spark.conf.get(name) == before
