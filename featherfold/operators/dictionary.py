"""Dictionary-encoded categories: a table of values and numbers per column, and sparse vectors of them.

A column per value ends at some thousands of values.  Here each column has a table (value, index), made and
numbered by Spark and stored once; rows get their index by a join on the value and one sparse vector
holds all columns, however many values they have.  No value passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import as_col
from ..session import shared_dir

PART_BITS = 33  # of the numbers that Spark gives rows: place within a part below, part above


def numbered(values: DataFrame, column: str, name: str = "index") -> DataFrame:
    """(column, name): gapless numbers from 0 in the order of ``column``, which must not repeat.

    Ranges of the values are sorted each on its own; the counts of the ranges, as many as a shuffle has
    parts, give each its first number.
    """
    ordered = values.select(column).repartitionByRange(column).sortWithinPartitions(column)
    path = shared_dir(values.sparkSession, "dictionary")
    ordered.withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    stored = values.sparkSession.read.parquet(path)
    stored = stored.withColumn("__part", F.shiftright("__id", PART_BITS))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__id").bitwiseAND(F.lit((1 << PART_BITS) - 1))
    return stored.join(F.broadcast(starts), "__part").select(column, (F.col("__start") + place).alias(name))


@dataclass
class DictionaryEncoder:
    """Tables of values and numbers by column; a missing or unseen value has the number after the last."""

    tables: dict[str, DataFrame]
    sizes: dict[str, int]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "DictionaryEncoder":
        tables, sizes = {}, {}
        for c in columns:
            values = df.where(as_col(c).isNotNull()).groupBy(as_col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
            tables[c] = numbered(values, "value")
            sizes[c] = tables[c].count()
        return cls(tables, sizes)

    def index(self, df: DataFrame) -> DataFrame:
        """``df`` with ``<column>_index``; each column costs one join, broadcast or skew-split as its table turns out."""
        for c, table in self.tables.items():
            own = table.select(F.col("value").alias("__value"), F.col("index").alias(f"{c}_index"))
            df = df.join(own, as_col(c) == F.col("__value"), "left").drop("__value")
            df = df.withColumn(f"{c}_index", F.coalesce(F.col(f"`{c}_index`"), F.lit(self.sizes[c]).cast("long")))
        return df

    def vectors(self, df: DataFrame, numeric: Sequence[str] = (), name: str = "features") -> DataFrame:
        """``df`` with a sparse vector: ``numeric`` columns, missing ones as 0, then a place for each value of each column."""
        indexed = self.index(df)
        columns = list(self.tables)
        filled = indexed.withColumns({f: F.coalesce(as_col(f).cast("double"), F.lit(0.0)) for f in numeric})
        # the sizes come from a frame of one row, so that the rows are not read for them
        sizes = df.sparkSession.range(1).select(*[F.lit(float(self.sizes[c])).alias(f"{c}_index") for c in columns])
        encoder = OneHotEncoder(
            inputCols=[f"{c}_index" for c in columns], outputCols=[f"__{c}_hot" for c in columns], dropLast=False, handleInvalid="error"
        ).fit(sizes)
        filled = filled.withColumns({f"{c}_index": F.col(f"`{c}_index`").cast("double") for c in columns})
        made = VectorAssembler(inputCols=[*numeric, *[f"__{c}_hot" for c in columns]], outputCol=name).transform(encoder.transform(filled))
        return made.drop(*[f"__{c}_hot" for c in columns])
