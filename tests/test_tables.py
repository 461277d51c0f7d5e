"""Sources, profiles, cleaning, outliers, entities and the feature build on small frames."""

import pytest
from pyspark.sql import functions as F

from featherfold.operators.clean import (
    LabelEncoder, OneHotEncoder, Standardizer, align_columns, columns_like, distinct_texts, normalise_types,
    recode_flags,
)
from featherfold.operators.combine import (
    common_names, join_scores, left_join_suffixed, minus_names, stack_splits, union_names, with_borrowed_columns,
)
from featherfold.operators.density import class_density, class_medians
from featherfold.operators.graph import Entity, EntitySet, Relationship
from featherfold.operators.outliers import extreme_values, negative_flag_rate, outlier_report, screened_columns
from featherfold.operators.profile import (
    describe, histogram, mostly_null_columns, null_ratios, single_value_columns, two_value_columns, useless_columns,
)
from featherfold.sources.files import gather_csv_scores, load_names, read_csv, save_names, write_csv

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, None if i % 2 else 1.0, 5, None, "a" if i % 2 else "b", float(i), 1 if i < 3 else 0) for i in range(20)]
    return spark.createDataFrame(rows, "id int, half double, same int, none double, two string, many double, flag int")


def test_profiles(mixed):
    ratios = {r["column"]: r["null_ratio"] for r in null_ratios(mixed).collect()}
    assert ratios["half"] == 0.5 and ratios["none"] == 1.0 and ratios["id"] == 0.0
    assert mostly_null_columns(mixed, 0.9) == ["none"]
    assert two_value_columns(mixed) == ["half", "two", "flag"]
    assert single_value_columns(mixed) == ["same", "none"]
    assert useless_columns(mixed, keep=("same",)) == ["none"]
    d = {r["column"]: r for r in describe(mixed, ["many", "half"]).collect()}
    assert (d["many"]["q25"], d["many"]["q50"], d["many"]["max"], d["half"]["count"]) == (4.75, 9.5, 19.0, 10)
    h = histogram(mixed, "many", 4).collect()
    assert [r["count"] for r in h] == [5, 5, 5, 5] and h[0]["low"] == 0.0 and h[-1]["high"] == 19.0


def test_encoders(spark, mixed):
    enc = LabelEncoder.fit(mixed)
    assert enc.classes == {"two": ["a", "b"]}
    assert {r["two"] for r in enc.transform(mixed).select("two").collect()} == {0, 1}
    hot = OneHotEncoder.fit(mixed).transform(spark.createDataFrame([("a",), (None,), ("new",)], "two string"))
    assert [tuple(r) for r in hot.collect()] == [(1, 0), (0, 0), (0, 0)]
    with pytest.raises(ValueError):
        OneHotEncoder.fit(mixed, max_values=1)


def test_types_alignment_and_names(mixed):
    t = dict(normalise_types(mixed, ["id"]).dtypes)
    assert t["id"] == "bigint" and t["flag"] == "boolean" and t["many"] == "float" and t["same"] == "int"
    a, b = align_columns(mixed, mixed.drop("flag", "many"), "flag")
    assert a.columns == ["id", "half", "same", "none", "two", "flag"] and b.columns == a.columns[:-1]
    assert columns_like(mixed, contains="a", without=("flag",)) == ["half", "same", "many"]
    assert union_names(["a", "b"], ["b", "c"]) == ["a", "b", "c"] and minus_names(["a", "b"], ["a"]) == ["b"]
    assert common_names(["a", "b"], ["b"]) == ["b"]


def test_standardizer_and_recode(spark, mixed):
    z = Standardizer.fit(mixed, ["many", "half"]).transform(mixed)
    s = z.agg(F.avg("many"), F.stddev("many"), F.max("half")).first()
    assert s[0] == pytest.approx(0, abs=1e-12) and s[1] == pytest.approx(1) and s[2] == 0.0
    r = recode_flags(spark.createDataFrame([(True,), (False,), (None,)], "f boolean"), ["f"], 1, -1)
    assert [x["f"] for x in r.collect()] == [1, -1, None]


def test_outliers(spark):
    df = spark.createDataFrame([(i, float(i % 10), i % 2) for i in range(100)] + [(100, 500.0, 1), (101, None, 0)], "id int, x double, b int")
    assert screened_columns(df) == ["id", "x"]
    out = {r["column"]: r["outliers"] for r in outlier_report(df).collect()}
    assert out == {"x": 1}
    assert {r["column"]: r["outliers"] for r in outlier_report(df, ["x"], null_is_outlier=True).collect()} == {"x": 2}
    assert [(r["side"], r["value"]) for r in extreme_values(df, ["x"]).collect()] == [("max", 500.0)]
    days = df.select((F.col("x") * 1).alias("DAYS_X"))
    assert extreme_values(days, ["DAYS_X"]).count() == 0


def test_negative_flag_rate_counts_distinct_rows(spark):
    child = spark.createDataFrame([(1, -1.0), (1, -1.0), (2, -3.0), (3, 5.0)], "k int, v double")
    parent = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "k int, y int")
    assert negative_flag_rate(child, "v", parent, "k", "y").first()["ratio"] == 1.0


def test_csv_round_trip_and_names(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.123456789)], "id int, x double").withColumn("Unnamed: 0", F.lit(7))
    write_csv(df, str(tmp_path / "a"), "%.8f")
    back = read_csv(spark, str(tmp_path / "a"), "id int, x double, `Unnamed: 0` int").orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, None), (2, 0.12345679)]
    save_names(spark, ["z", "a", "m"], str(tmp_path / "n"))
    assert load_names(spark, str(tmp_path / "n")) == ["z", "a", "m"]


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z")], "k int, v string")
    assert left_join_suffixed(a, b, "k").columns == ["k", "v_l", "v_r"]
    assert with_borrowed_columns(a.select("k"), a, "k", ["v"]).columns == ["k", "v"]
    assert join_scores({"v": b}, "k", a.select("k")).count() == 2
    both = stack_splits(a.withColumn("y", F.lit(1)), b, "y").collect()
    assert [(r["set"], r["y"]) for r in both] == [("train", 1), ("train", 1), ("test", None)]


def test_density_integrates_to_one(spark):
    df = spark.range(2000).select((F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    rows = class_density(df, "x", "y", points=200).collect()
    for y in (0, 1):
        part = sorted((r["x"], r["density"]) for r in rows if r["y"] == y)
        step = part[1][0] - part[0][0]
        assert sum(d for _, d in part) * step == pytest.approx(1, abs=0.01)
    m = class_medians(df, "x", "y").first()
    assert m["median_0"] == pytest.approx(48, abs=1.5)


def test_entities(spark):
    p = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    c = spark.createDataFrame([(1, 2.0), (1, 4.0), (9, 1.0)], "fk int, v double")
    es = EntitySet("t").add(Entity("p", p, "k")).add(Entity("c", c, "i", made_index=True)).relate(Relationship("p", "k", "c", "fk"))
    assert es.duplicate_keys("p").count() == 0 and es.orphans(es.relationships[0]).count() == 1
    assert es.report().first()["orphans"] == 1
    out = {r["k"]: r["C_v_SUM"] for r in es.roll_up("p", {"c": {"v": ["sum"]}}).collect()}
    assert out == {1: 6.0, 2: None, 3: None}
    with pytest.raises(ValueError):
        es.add(Entity("q", p, "nope"))


def test_feature_build_keeps_parents_and_drops_useless(spark):
    from featherfold.catalog.base import base
    from featherfold.models.training import hold_out
    from featherfold.plans.credit import build_features
    from featherfold.plans.starmap import CARD_TIES, SHARE_COLUMNS, credit_tables

    tables = credit_tables(spark, base(spark, SF))
    app = tables["application"].withColumn("CONST", F.lit(1))
    train, test = hold_out(app, "SK_ID_CURR", 0.75)
    a, b = build_features(train, test, tables, shares_of=SHARE_COLUMNS, card_ties=CARD_TIES)
    assert a.columns == b.columns and "CONST" not in a.columns and {"SK_ID_CURR", "TARGET"} <= set(a.columns)
    assert a.count() == train.count() and b.count() == test.count()
    assert a.select("SK_ID_CURR").distinct().count() == train.count() and len(a.columns) > 500


def test_csv_scores_are_found_and_doubles_refused(spark, tmp_path):
    scores = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id bigint, score double")
    for m in ("A", "B", "OLD"):
        write_csv(scores, f"{tmp_path}/{m}_oof.csv")
    found = gather_csv_scores(spark, str(tmp_path), "id", ending="oof.csv", without=["OLD"])
    assert found.columns == ["id", "A", "B"] and sorted(map(tuple, found.collect())) == [(1, 0.1, 0.1), (2, 0.2, 0.2)]
    write_csv(scores.union(scores.limit(1)), f"{tmp_path}/B_oof.csv")
    with pytest.raises(Exception, match="more than one score"):
        gather_csv_scores(spark, str(tmp_path), "id", ["B"]).collect()


def test_values_of_wide_columns_are_not_gathered(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("wide"), F.when(F.col("id") % 2 == 0, "a").alias("two"))
    assert distinct_texts(df, ["wide", "two"], 3) == {"wide": [None] * 4, "two": ["a", None]}
    assert len(distinct_texts(df, ["wide"], None)["wide"]) == 500
