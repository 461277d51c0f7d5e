"""Session helpers: defaults for a fresh session and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def build_session(app: str = "featherfold", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or fetch) a session with the library's defaults; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path that every executor can reach.

    It lies under ``spark.checkpoint.dir``, which a cluster sets to shared storage.
    Only where that is unset (tests, one machine) a local scratch folder stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="featherfold-")
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


@contextmanager
def wide_code(spark: SparkSession, fields: int = 4000) -> Iterator[None]:
    """Generated code for jobs over frames of up to ``fields`` columns; beyond 100 Spark interprets their aggregates otherwise."""
    name = "spark.sql.codegen.maxFields"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(fields, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bin_count(spark: SparkSession) -> int:
    """How many ranges to cut an ordered column into: a power of two near the shuffle width."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    bins = 16
    while bins < width and bins < 8192:
        bins *= 2
    return bins
