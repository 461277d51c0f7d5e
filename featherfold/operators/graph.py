"""Entities, relationships and the bottom-up roll-up along them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregate import Slice, Spec, aggregate


@dataclass(frozen=True)
class Entity:
    """A table with its key; ``made_index`` adds a unique (not gapless) key column."""

    name: str
    df: DataFrame
    key: str
    time_index: str | None = None
    made_index: bool = False

    def frame(self) -> DataFrame:
        return self.df.withColumn(self.key, F.monotonically_increasing_id()) if self.made_index else self.df


@dataclass(frozen=True)
class Relationship:
    parent: str
    parent_key: str
    child: str
    child_key: str


@dataclass
class EntitySet:
    name: str
    entities: dict[str, Entity] = field(default_factory=dict)
    relationships: list[Relationship] = field(default_factory=list)

    def add(self, entity: Entity) -> "EntitySet":
        for column in (entity.key, entity.time_index):
            if column and column not in entity.df.columns and not (entity.made_index and column == entity.key):
                raise ValueError(f"{entity.name} has no column {column}")
        self.entities[entity.name] = entity
        return self

    def relate(self, *relationships: Relationship) -> "EntitySet":
        for r in relationships:
            if r.parent not in self.entities or r.child not in self.entities:
                raise ValueError(f"unknown entity in {r}")
            self.relationships.append(r)
        return self

    def duplicate_keys(self, entity: str) -> DataFrame:
        """(key, count) of keys that occur more than once: empty for a sound index."""
        e = self.entities[entity]
        return e.frame().groupBy(e.key).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)

    def orphans(self, r: Relationship) -> DataFrame:
        """Child rows whose foreign key has no parent."""
        parent = self.entities[r.parent].frame().select(F.col(r.parent_key).alias(r.child_key))
        return self.entities[r.child].frame().join(parent, r.child_key, "left_anti")

    def report(self) -> DataFrame:
        """(relationship, child_rows, orphans) for every registered relationship."""
        out = None
        for r in self.relationships:
            parent = self.entities[r.parent].frame().select(F.col(r.parent_key).alias("__k")).distinct()
            parent = parent.withColumn("__hit", F.lit(1))
            # count per foreign key first: a hot key then joins as one row
            child = self.entities[r.child].frame().groupBy(F.col(r.child_key).alias("__k"))
            row = (
                child.agg(F.count(F.lit(1)).alias("__n"))
                .join(parent, "__k", "left")
                .agg(
                    F.sum("__n").alias("child_rows"),
                    F.coalesce(F.sum(F.when(F.col("__hit").isNull(), F.col("__n"))), F.lit(0)).alias("orphans"),
                )
                .select(F.lit(f"{r.parent}-{r.child}").alias("relationship"), "child_rows", "orphans")
            )
            out = row if out is None else out.unionByName(row)
        return out

    def roll_up(self, target: str, specs: Mapping[str, Spec], prefixes: Mapping[str, str] | None = None) -> DataFrame:
        """Aggregate children into parents from the leaves up to ``target``.

        ``specs[child]`` may name columns made by deeper levels.  Each edge costs one
        group-by on the foreign key and one left join.
        """
        prefixes = prefixes or {}
        df = self.entities[target].frame()
        for r in self.relationships:
            if r.parent != target or r.child not in specs:
                continue
            child = self.roll_up(r.child, specs, prefixes)
            prefix = prefixes.get(r.child, f"{r.child.upper()}_")
            features = aggregate(child, r.child_key, [Slice(specs[r.child], prefix)])
            if r.child_key != r.parent_key:
                features = features.withColumnRenamed(r.child_key, r.parent_key)
            df = df.join(features, r.parent_key, "left")
        return df


def chain(names: Sequence[str], keys: Sequence[tuple[str, str]]) -> list[Relationship]:
    """Relationships of a parent-to-child chain; ``keys`` are (parent key, child key) per edge."""
    return [Relationship(p, pk, c, ck) for (p, c), (pk, ck) in zip(zip(names, names[1:]), keys)]
