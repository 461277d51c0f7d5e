"""Partial states, hit ranges and exact sums: against the plain forms, far from zero, with ties and gaps."""

import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from featherfold.functions.exact import float_sum_text, sum_text, sum_type
from featherfold.operators import selection
from featherfold.operators.aggregate import Slice, aggregate, keep_loans_seen_since
from featherfold.operators.ordered import exact_quantiles, quantiles_per_group
from featherfold.operators.partial import aggregate_by_part
from featherfold.operators.profile import Profiled, describe, useless_columns
from featherfold.operators.selection import Bracket, select_quantiles
from featherfold.plans.credit import latest_of_part


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def loans(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        customer = 0 if i % 3 == 0 else rng.randrange(1, 40)
        loan = customer * 10 + rng.randrange(4)  # a loan belongs to one customer
        x = None if rng.random() < 0.1 else 1e6 + rng.gauss(0, 1)
        rows.append((customer if rng.random() < 0.97 else None, loan if rng.random() < 0.95 else None, rng.randrange(-900, 0), x, rng.randrange(4), rng.random() < 0.5))
    rows += [(99, 990, -5, None, None, None), (98, 980, None, 1.0, 1, True)]
    return spark.createDataFrame(rows, "c long, loan long, d int, x double, k long, f boolean").repartition(5)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def test_states_give_what_a_join_of_the_latest_row_gives(loans):
    spec = {"x": ["min", "max", "mean", "sum", "var", "std"], "k": ["sum", "mean", "nunique", "max"], "f": ["mean", "sum"], "loan": ["size", "nunique"]}
    slices = lambda: [Slice(spec), *[Slice(spec, f"L{m}_", f"seen >= {-m}") for m in (5, 200, 700)]]
    got = {r["c"]: r.asDict() for r in aggregate_by_part(loans, "c", "loan", slices(), {"seen": latest_of_part("loan", "d")}).collect()}
    seen = keep_loans_seen_since(loans, "loan", "d", "seen")
    # a loan with rows under a missing customer: its latest row is that of its customer
    own = loans.where("c IS NOT NULL AND loan IS NOT NULL").groupBy("c", "loan").agg(F.max("d").alias("seen"))
    seen = loans.join(own, ["c", "loan"], "left")
    want = {r["c"]: r.asDict() for r in aggregate(seen, "c", slices()).collect()}
    assert set(got) == set(want)
    for c in want:
        for name, value in want[c].items():
            assert close(got[c][name], value), (c, name, got[c][name], value)
    assert got[99]["x_SUM"] == 0.0 and got[99]["k_SUM"] == Decimal(0) and got[98]["L5_x_SUM"] is None


def test_states_scan_the_rows_once(spark, loans, tmp_path):
    loans.write.parquet(str(tmp_path / "loans"))
    df = spark.read.parquet(str(tmp_path / "loans"))
    out = aggregate_by_part(df, "c", "loan", [Slice({"x": ["mean", "var"], "k": ["nunique"]})])
    out.collect()
    text = plan_of(out)
    assert "ReusedExchange" in text
    scans = text.split("== Initial Plan ==")[0].count("FileScan parquet")
    assert scans == 1


def quantile(values, p):
    values = sorted(values)
    r = (len(values) - 1) * p
    lo, hi = values[math.floor(r)], values[math.ceil(r)]
    return lo + (hi - lo) * (r - math.floor(r))


PROBS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}


@pytest.mark.parametrize("small", [1 << 16, 60, 1])
def test_hit_ranges_are_exact(spark, monkeypatch, small):
    rng = np.random.default_rng(2)
    n = 4000
    columns = {
        "even": rng.uniform(size=n), "heavy": np.exp(rng.standard_normal(n) * 20), "ties": rng.integers(0, 3, n).astype(float),
        "same": np.full(n, 7.0), "far": 1e15 + np.arange(n), "mostly": np.where(np.arange(n) % 10 == 0, rng.standard_normal(n), 0.0),
    }
    rows = [tuple(None if (i + j) % 17 == 0 else float(v[i]) for j, v in enumerate(columns.values())) + (None, None if i % 50 == 0 else ["hot", "hot", "cold"][i % 3], i % 2) for i in range(n)]
    names = [*columns, "none"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", g string, h int").repartition(4)
    monkeypatch.setattr(selection, "ACCURACY", 100 if small < 100 else 10_000)
    got = {r["column"]: r for r in select_quantiles(df, [], names, PROBS, small).collect()}
    for j, c in enumerate(columns):
        values = [r[j] for r in rows if r[j] is not None]
        for name, p in PROBS.items():
            assert close(got[c][name], quantile(values, p)), (c, name)
    assert "none" not in got or all(got["none"][p] is None for p in PROBS)
    keyed = {(r["g"], r["h"], r["column"]): r for r in select_quantiles(df, ["g", "h"], ["heavy", "ties", "none"], PROBS, small).collect()}
    for g, h in {(r[-2], r[-1]) for r in rows if r[-2] is not None}:
        for c in ("heavy", "ties"):
            values = [r[names.index(c)] for r in rows if r[-2:] == (g, h) and r[names.index(c)] is not None]
            assert all(close(keyed[g, h, c][name], quantile(values, p)) for name, p in PROBS.items())
    assert {k[0] for k in keyed} == {"hot", "cold"}


def test_rows_are_filtered_before_they_are_shuffled(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("x"))
    out = select_quantiles(df, [], ["x"], {"m": 0.5}, small=1000)
    lines = plan_of(out).splitlines()
    at = [next(i for i, line in enumerate(lines) if mark in line) for mark in ("Exchange hashpartitioning", "Filter")]
    assert at[0] < at[1]  # plans are printed from the result down
    sent = out._jdf.queryExecution()
    assert out.first()["m"] == quantile([i * 7919 % 200_003 for i in range(200_000)], 0.5) and sent is not None


def test_quantiles_of_many_groups_go_by_ranges(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") % 60).alias("g"), (F.col("id") * 31 % 997).cast("double").alias("x"))
    want = {tuple(r) for r in quantiles_per_group(df, ["g"], "x", {"m": 0.5}).collect()}
    monkeypatch.setattr(selection, "FEW_GROUPS", 10)
    assert {tuple(r) for r in quantiles_per_group(df, ["g"], "x", {"m": 0.5}).collect()} == want
    assert {tuple(r) for r in exact_quantiles(df, ["g"], "x", {"m": 0.5}).collect()} == want


def test_a_bracket_that_missed_is_widened():
    b = Bracket(rank=10.0, low=5.0, high=6.0, inside=100)
    b.counted(11, 50, None, 1000)
    assert b.low == -math.inf and b.high == 6.0 and not b.ready
    b.counted(0, 9, None, 1000)
    assert b.high == math.inf and not b.ready
    b.counted(0, 100, None, 1000)
    assert b.ready


def test_describe_of_edges(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "x double, y int")
    rows = {r["column"]: r for r in describe(df, ["x", "y"]).collect()}
    assert (rows["x"]["q25"], rows["x"]["q50"], rows["y"]["q50"], rows["y"]["count"]) == (1.5, 2.0, None, 0)
    assert describe(df.limit(0), ["x"]).first()["q50"] is None


# --- sums ----------------------------------------------------------------------------------------------


def total(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}").repartition(3)
    return df.agg(F.expr(f"{sum_text('x', kind)} AS s")).first()["s"]


def test_whole_sums_are_exact(spark):
    assert total(spark, [9007199254740993, 2], "bigint") == 9007199254740995
    big = [2**63 - 1, 2**63 - 1, -(2**63), 5, None, -3, 2**62 + 1]
    assert total(spark, big, "bigint") == sum(v for v in big if v is not None)
    assert total(spark, [2**31 - 1] * 5, "int") == 5 * (2**31 - 1)
    assert total(spark, [None], "bigint") is None
    assert total(spark, [Decimal("0.10"), Decimal("0.20")], "decimal(10,2)") == Decimal("0.30")
    assert sum_type("decimal(10,2)") == "decimal(38,2)" and sum_type("float") == "double"


def test_spec_sums_are_exact(spark):
    df = spark.createDataFrame([(1, 9007199254740993, 1, True), (1, 2, 2, True), (2, None, None, None)], "k int, x long, y int, f boolean")
    out = {r["k"]: r for r in aggregate(df, "k", [Slice({"x": ["sum"], "y": ["sum"], "f": ["sum"]}), Slice({"x": ["sum"]}, "P_", "y = 2")]).collect()}
    assert (out[1]["x_SUM"], out[1]["y_SUM"], out[1]["f_SUM"], out[1]["P_x_SUM"]) == (9007199254740995, 3, 2, 2)
    assert (out[2]["x_SUM"], out[2]["y_SUM"], out[2]["P_x_SUM"]) == (0, 0, None)


def test_floating_sums_do_not_know_the_order(spark):
    rng = random.Random(3)
    values = [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-12, 14) for _ in range(3000)] + [1e16, 1.0, -1e16, 2.0**-60, 0.1, -0.1, None]
    seen = set()
    for parts in (1, 2, 5, 7):
        rng.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
        seen.add(df.agg(F.expr(float_sum_text("x"))).first()[0])
    want = math.fsum(v for v in values if v is not None)
    assert len(seen) == 1 and math.isclose(seen.pop(), want, rel_tol=1e-15)
    one = lambda vs: spark.createDataFrame([(v,) for v in vs], "x double").agg(F.expr(float_sum_text("x"))).first()[0]
    assert one([1e300, 1.0]) == 1e300 and math.isnan(one([float("nan"), 1.0])) and one([float("inf"), 1.0]) == math.inf and one([None]) is None
    assert one([2.0**53, 1.0, 1.0]) == 2.0**53 + 2
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", -0.3)], "k string, x double")
    assert aggregate(df, "k", [Slice({"x": ["fsum"]})]).first()["x_FSUM"] == math.fsum([0.1, 0.2, -0.3])


# --- profiles of frames that are joined later ---------------------------------------------------------------


def test_profile_of_an_unjoined_frame_equals_that_of_the_joined_one(spark):
    parent = spark.createDataFrame([(i,) for i in range(100)], "id int")
    child = spark.createDataFrame(
        [(i, 1.0, None, float(i), "a", 5 if i < 2 else None, i % 2 == 0) for i in range(120)],
        "id int, one double, none double, many double, text string, rare int, flag boolean",
    )
    for some in (child, child.where("id < 50"), child.where("id < 2"), child.where("id > 200")):
        held = Profiled(some.join(parent, "id"), "profile-test", skip=("id",))
        want = useless_columns(parent.join(some, "id", "left"), keep=("id",))
        assert held.useless(100) == want
        assert held.frame.count() == some.join(parent, "id").count()
    own = Profiled(parent.withColumn("t", F.col("id") < 10), "profile-test", F.col("t"), skip=("id",))
    assert own.rows == 10 and own.useless(own.rows) == ["t"]
