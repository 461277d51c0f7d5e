"""Reading and writing tables, score files and name lists."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from ..functions.scalar import nan_to_null

SAVED_INDEX = ("_c0", "Unnamed: 0")  # names a saved row index shows up under


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN to NULL in float columns; other columns stay bare, so their filters reach the scan."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*[nan_to_null(c).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header; give a schema at scale, as inference reads the data once more."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = normalise_missing(reader.csv(path))
    return df.drop(*[c for c in SAVED_INDEX if c in df.columns])


def read_parquet(spark: SparkSession, path: str, nan_to_missing: bool = False) -> DataFrame:
    """Parquet written by :func:`write_parquet` holds no NaN; ask for the clean-up elsewhere."""
    df = spark.read.parquet(path)
    df = normalise_missing(df) if nan_to_missing else df
    return df.drop(*[c for c in SAVED_INDEX if c in df.columns])


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    normalise_missing(df).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, float_format: str | None = None) -> None:
    """CSV with a header and no index; ``float_format`` such as ``%.8f`` fixes float digits."""
    if float_format:
        floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
        df = df.withColumns({c: F.format_string(float_format, F.col(f"`{c}`")) for c in floats})
    df.write.mode("overwrite").option("header", True).csv(path)


def write_scores(df: DataFrame, folder: str, model: str, kind: str) -> None:
    """Score table (id, score) as ``<folder>/model=<model>/kind=<oof|test>``."""
    df.write.mode("overwrite").parquet(f"{folder}/model={model}/kind={kind}")


def gather_scores(spark: SparkSession, folder: str, key: str, models: Sequence[str], kind: str) -> DataFrame:
    """All models' score files of one kind as one row per id: one scan, one group-by."""
    rows = spark.read.option("basePath", folder).parquet(folder)
    rows = rows.where((F.col("kind") == kind) & F.col("model").isin(list(models)))
    wide = [F.max(F.when(F.col("model") == m, F.col("score"))).alias(m) for m in models]
    return rows.groupBy(key).agg(*wide)


def score_models(spark: SparkSession, folder: str, ending: str, without: Sequence[str] = ()) -> list[str]:
    """Sorted names of all models with a score file or folder ``<model>_<ending>`` in a folder, but those named."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/*_{ending}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    # the path alone is read; a score file is the name itself or lies in a folder of that name
    name = F.regexp_extract("path", rf"/([^/]*)_{re.escape(ending)}(?:/[^/]*)?$", 1)
    found = {r["model"] for r in files.select(name.alias("model")).distinct().collect()}  # a name per model
    return sorted(m for m in found if m and m not in set(without))


def gather_csv_scores(
    spark: SparkSession, folder: str, key: str, models: Sequence[str] | None = None, ending: str = "oof.csv", without: Sequence[str] = ()
) -> DataFrame:
    """All models' CSV score folders ``<model>_<ending>`` of columns (key, score) as one row per id.

    Without ``models`` every such folder is taken but those of ``without``.  An id with two scores
    of one model raises an error when the result is read.
    """
    models = list(models) if models is not None else score_models(spark, folder, ending, without)
    paths = [f"{folder}/{m}_{ending}" for m in models]
    rows = spark.read.option("header", True).schema(f"{key} bigint, score double").csv(paths)
    # the name of the file's folder, or of the file where the scores are one plain file
    parts = F.split(F.col("_metadata.file_path"), "/")
    names = F.array(F.element_at(parts, -2), F.element_at(parts, -1))
    rows = rows.withColumn("__model", F.element_at(F.filter(names, lambda n: n.endswith(f"_{ending}")), 1))
    wide = []
    for m in models:
        own = F.col("__model") == f"{m}_{ending}"
        twice = F.raise_error(F.lit(f"an id has more than one score of {m}"))
        wide.append(F.when(F.count_if(own) > 1, twice).otherwise(F.max(F.when(own, F.col("score")))).alias(m))
    return rows.groupBy(key).agg(*wide)


def save_names(spark: SparkSession, names: Sequence[str], path: str) -> None:
    """A list of column names as a two-column table that keeps the order."""
    spark.createDataFrame(list(enumerate(names)), "position int, name string").coalesce(1).write.mode(
        "overwrite"
    ).parquet(path)


def load_names(spark: SparkSession, path: str) -> list[str]:
    return [r["name"] for r in spark.read.parquet(path).orderBy("position").collect()]


def select_names(df: DataFrame, names: Sequence[str], extra: Mapping[str, str] | Sequence[str] = ()) -> DataFrame:
    """Project to saved names plus extras that exist in the frame."""
    held = set(df.columns)
    wanted = [n for n in [*extra, *names] if n in held]
    return df.select(*[F.col(f"`{n}`") for n in dict.fromkeys(wanted)])
