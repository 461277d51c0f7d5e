"""Dictionary-encoded categories: many values, missing and unseen ones, sparse vectors."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from featherfold.operators.dictionary import DictionaryEncoder, numbered


def test_numbers_are_gapless_and_in_order(spark):
    df = spark.range(10_000).select(F.md5(F.col("id").cast("string")).alias("v"))
    rows = numbered(df, "v").collect()
    assert [r["index"] for r in sorted(rows)] == list(range(10_000))
    assert numbered(df.limit(0), "v").count() == 0


def test_a_column_of_a_hundred_thousand_values(spark):
    df = spark.range(100_000).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("name"), F.lit("x").alias("one"), F.col("id").cast("double").alias("n"))
    encoder = DictionaryEncoder.fit(df, ["name", "one"])
    assert encoder.sizes == {"name": 100_000, "one": 1}
    row = encoder.vectors(df, ["n"]).where("id = 7").first()
    vector = row["features"]
    assert vector.size == 1 + 100_001 + 2 and sorted(vector.indices.tolist()) == [0, 1 + row["name_index"], 100_002]
    assert encoder.index(df).select("name_index").distinct().count() == 100_000


def test_missing_and_unseen_values(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", 2.0), (None, None)], "k string, n double")
    encoder = DictionaryEncoder.fit(train, ["k"])
    other = spark.createDataFrame([("a", 1.0), ("zz", 5.0), (None, None)], "k string, n double")
    got = {r["k"]: (r["k_index"], r["v"]) for r in encoder.vectors(other, ["n"]).select("k", "k_index", vector_to_array("features").alias("v")).collect()}
    assert got == {"a": (0, [1.0, 1.0, 0.0, 0.0]), "zz": (2, [5.0, 0.0, 0.0, 1.0]), None: (2, [0.0, 0.0, 0.0, 1.0])}
