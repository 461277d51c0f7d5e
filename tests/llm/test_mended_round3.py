"""Mixing of rows without ids, secrets of very long texts, and what they cost."""

import collections
import time

import pytest
from pyspark.sql import functions as F

from featherfold.llm.op2_secrets import CLASSES, find_secrets, running, suspect_windows
from featherfold.llm.op10_mixing import mix, mixed

DOCS = "doc_id long, text string, source string, lang string"


def near(taken, target, longest):
    return abs(taken - target) <= 2 * longest


def test_mixing_without_ids_and_with_one_id(spark):
    """Rows without an id, rows of one id, and equal rows of one source are mixed near their targets."""
    rows = [(None, " ".join(f"a{i}w{k}" for k in range(10)), "a", "x") for i in range(1000)]
    rows += [(7, " ".join(f"b{i}w{k}" for k in range(10)), "b", "x") for i in range(1000)]
    rows += [(None, "the very same ten words in each row of c", "c", "x")] * 1000
    rows += [(i, " ".join(f"d{i}w{k}" for k in range(10)), None, "x") for i in range(1000)]
    table = spark.createDataFrame(rows, DOCS).repartition(4)
    got = mix(table).collect()
    assert len(got) == 4000
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(near(taken[s], target[s], 10) for s in target), (taken, target)
    key = lambda rows: sorted(map(str, rows))
    assert key(got) == key(mix(table.repartition(3)).collect())
    out = mixed(table)
    assert out.columns == table.columns
    words = {r["source"]: r["n"] * 10 for r in out.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert words == {s: n for s, n in taken.items()}


def test_copies_of_equal_rows_have_the_columns_of_the_least(spark):
    rows = [(1, "one two three", "a", "y"), (1, "one two three", "a", "x"), (2, "", "a", "z"), (3, None, "b", "z")]
    out = mixed(spark.createDataFrame(rows, DOCS))
    assert {r["lang"] for r in out.collect()} == {"x"} and out.count() == 2


def test_running_sums(spark):
    for n in (0, 1, 2, 3, 10, 1000):
        values = [(i * 7) % 11 for i in range(n)]
        got = spark.range(1).select(running(F.expr("CAST(array() AS array<int>)") if not n else F.lit(values)).alias("r")).first()["r"]
        assert got == [sum(values[:i]) for i in range(n)]


@pytest.mark.parametrize("cls", CLASSES)
def test_windows_of_long_runs_do_not_depend_on_parts(spark, cls, monkeypatch):
    from featherfold.llm import op2_secrets as op2

    import random

    rng = random.Random(9)
    run = "".join(rng.choice(cls.chars) if (i // 40) % 3 else cls.chars[i % 3] for i in range(3000))
    df = spark.createDataFrame([(run,), (run[:100],), (run[: cls.window],)], "run string")
    whole = df.select(suspect_windows(F.col("run"), cls).alias("w")).collect()
    monkeypatch.setattr(op2, "PART", 37)
    assert df.select(suspect_windows(F.col("run"), cls).alias("w")).collect() == whole and len(whole[0]["w"]) > 5


def test_secrets_of_a_text_with_many_matches(spark):
    """Forty thousand matches take seconds, and twice as many not four times as long."""
    def text(n):
        return " ".join(f"token={i:012d}abcdef" for i in range(n))

    def seconds(n):
        df = spark.createDataFrame([(1, text(n), "a", "x")], DOCS)
        start = time.perf_counter()
        r = find_secrets(df).first()
        assert r["n_assign"] == n and r["n_hex"] == n
        first = [s for s in r["base_spans"].split(",")[-2:]]
        assert first == [f"assign:{25 * (n - 1)}:{25 * n - 1}", f"hex:{25 * (n - 1) + 6}:{25 * n - 1}"]
        return time.perf_counter() - start

    seconds(1000)
    half, full = seconds(20_000), seconds(40_000)
    assert full < 30 and full < 3.5 * half + 2
