"""What the second advice found in the tabular operators."""

import pytest
from pyspark.sql import functions as F

from featherfold.operators.clean import MOST_VALUES, OneHotEncoder


def test_one_hot_refuses_columns_like_ids(spark):
    n = 3 * MOST_VALUES
    df = spark.range(n).select(F.col("id").cast("string").alias("name"), (F.col("id") % 3).cast("string").alias("kind"))
    with pytest.raises(ValueError, match=r"\['name'\]"):
        OneHotEncoder.fit(df)
    assert OneHotEncoder.fit(df, ["kind"]).values == {"kind": ["0", "1", "2"]}
    assert len(OneHotEncoder.fit(df, ["name"], max_values=None).values["name"]) == n
