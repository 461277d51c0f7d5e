"""Joins and set operations on frames and on lists of names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(parent: DataFrame, features: Sequence[DataFrame], key: str) -> DataFrame:
    """Left-join feature frames (one row per key each) to the parent.

    Frames that come out of a group-by on the key are already partitioned by it,
    so only the parent moves, once.
    """
    for f in features:
        parent = parent.join(f, key, "left")
    return parent


def keep_members(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``members``."""
    return df.join(members.select(key), key, "left_semi")


def left_join_suffixed(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str] = ("_l", "_r")) -> DataFrame:
    """Left join where columns both sides have get a suffix; the key is kept once."""
    clash = (set(left.columns) & set(right.columns)) - {key}
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return a.join(b, key, "left")


def with_borrowed_columns(df: DataFrame, raw: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Fetch columns from a raw table by key when the frame lacks one of them."""
    if set(columns) <= set(df.columns):
        return df
    missing = [c for c in columns if c not in df.columns]
    return df.join(raw.select(key, *missing), key, "left")


def join_scores(scores: Mapping[str, DataFrame], key: str, base: DataFrame | None = None) -> DataFrame:
    """One row per key with a column per model; frames are (key, <model>)."""
    frames = list(scores.values())
    out = frames[0] if base is None else base
    for f in frames[1:] if base is None else frames:
        out = out.join(f, key, "left")
    return out


def stack_splits(train: DataFrame, test: DataFrame, label: str, tag: str = "set") -> DataFrame:
    """Train rows and test rows under each other, tagged; the label is NULL for test rows."""
    a = train.withColumn(tag, F.lit("train"))
    b = test.drop(label).withColumn(tag, F.lit("test"))
    return a.unionByName(b, allowMissingColumns=True)


def union_names(*lists: Sequence[str]) -> list[str]:
    """Union of name lists in order of first appearance."""
    return list(dict.fromkeys(n for names in lists for n in names))


def minus_names(names: Sequence[str], remove: Sequence[str]) -> list[str]:
    gone = set(remove)
    return [n for n in names if n not in gone]


def common_names(a: Sequence[str], b: Sequence[str]) -> list[str]:
    held = set(b)
    return [n for n in a if n in held]


def map_tables(tables: Mapping[str, DataFrame], step) -> dict[str, DataFrame]:
    """Apply one step to every table of a named batch; plans stay lazy."""
    return {name: step(df) for name, df in tables.items()}
