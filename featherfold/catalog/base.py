"""Registry and shared helpers of the query catalogue."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..plans.starmap import base_tables_of, credit_table, select_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
BASE_TABLES = ("customer", "orders", "lineitem", "events")


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its ANSI SQL twin."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str, names: Sequence[str] = BASE_TABLES) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def credit(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One credit table over the star schema."""
    return credit_table(spark, name, base(spark, sf_dir, base_tables_of(name)))


def credit_sql(*names: str) -> str:
    """CTE list of credit tables for the SQL twin (without the WITH keyword)."""
    out = []
    for n in names:
        text = select_text(n, "duckdb")
        for b in BASE_TABLES:
            text = text.replace("{" + b + "}", b)
        out.append(f"{n} AS ({text})")
    return ", ".join(out)


def bucket_sql(column: str, buckets: int, seed: int) -> str:
    """SQL twin of the seeded hash bucket."""
    digest = f"md5(concat_ws('-', CAST({column} AS VARCHAR), '{seed}'))"
    return f"CAST(CAST('0x' || substr({digest}, 1, 8) AS BIGINT) % {buckets} AS INTEGER)"


def q(name: str) -> str:
    return f'"{name}"'


def names_sql(columns: Sequence[str]) -> str:
    return ", ".join(q(c) for c in columns)


def ratio_sql(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0)"


def agg_sql(func: str, x: str, order: Sequence[str] = ()) -> str:
    """SQL twin of one aggregate function over expression ``x``."""
    by = ", ".join([*[q(o) for o in order], x])
    return {
        "min": f"min({x})",
        "max": f"max({x})",
        "mean": f"avg(CAST({x} AS DOUBLE))",
        "sum": f"coalesce(sum(CAST({x} AS DOUBLE)), 0)",
        "var": f"var_samp(CAST({x} AS DOUBLE))",
        "std": f"stddev_samp(CAST({x} AS DOUBLE))",
        "size": "count(*)",
        "nunique": f"count(DISTINCT {x})",
        "first": f"first({x} ORDER BY {by}) FILTER (WHERE {x} IS NOT NULL)",
        "last": f"last({x} ORDER BY {by}) FILTER (WHERE {x} IS NOT NULL)",
    }[func]


def slices_sql(
    source: str, key: str, slices: Sequence[tuple], order: Sequence[str] = (), name: str = "features"
) -> str:
    """CTEs of one filter, group-by and left join per slice, ending in ``name``.

    A slice is (prefix, spec, condition or None[, names]).
    """
    ctes, joins, columns = [], [], []
    for i, (prefix, spec, cond, *rest) in enumerate(slices):
        names = rest[0] if rest else {}
        items = []
        for c, funcs in spec.items():
            for f in funcs:
                out = names.get((c, f), f"{prefix}{c}_{f.upper()}")
                items.append(f"{agg_sql(f, q(c), order)} AS {q(out)}")
                columns.append(f"{name}_{i}.{q(out)}")
        where = f"{q(key)} IS NOT NULL" + (f" AND ({cond})" if cond else "")
        ctes.append(
            f"{name}_{i} AS (SELECT {q(key)}, {', '.join(items)} FROM {source} WHERE {where} GROUP BY {q(key)})"
        )
        if i:
            joins.append(f"LEFT JOIN {name}_{i} ON {name}_0.{q(key)} = {name}_{i}.{q(key)}")
    ctes.append(f"{name} AS (SELECT {name}_0.{q(key)}, {', '.join(columns)} FROM {name}_0 {' '.join(joins)})")
    return ", ".join(ctes)
