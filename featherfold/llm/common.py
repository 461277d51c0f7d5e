"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared working folder and read it back.

    Cuts the lineage with a table that every executor can reach, so a lost
    executor costs a re-read and never a re-run of what came before.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Working tables of one job in the shared folder, which :meth:`clear` empties once nothing reads them.

    An empty table is written over each, as Spark's writer reaches any storage that its readers reach.
    """

    def __init__(self) -> None:
        self.paths: list[str] = []

    def folder(self, spark: SparkSession, name: str) -> str:
        self.paths.append(shared_dir(spark, name))
        return self.paths[-1]

    def write(self, df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
        """As :func:`materialize`; a ``folder`` of this job, whose rows ``df`` must not read, is written over."""
        path = folder or self.folder(df.sparkSession, name)
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def clear(self, spark: SparkSession) -> None:
        for path in self.paths:
            spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)
        self.paths = []


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_of(name: str = "text") -> Column:
    """The text, a missing one as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def rows_of(batches: Iterable[pa.RecordBatch], at_most: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``at_most`` rows, which bounds a task's memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, at_most):
            yield batch.slice(start, at_most)


def strings(column: pa.Array) -> list[str]:
    """Values of a string column, missing ones as empty."""
    return [v or "" for v in column.to_pylist()]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="featherfold-")) / "featherfold_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
