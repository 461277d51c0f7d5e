"""Shard placement by a permutation-filled lookup table, in Spark functions only.

Every shard has its own order of preference over the slots of a prime-sized table: offset + k * step
modulo the size, both from digests of the shard's name.  Shards take turns; at its turn a shard
claims the first slot of its order that is free.  The filled table has a fixed number of rows, so it
is broadcast, and placing a row is one digest and one lookup.  Adding or removing a shard moves few
rows, and the shares of any two shards differ by at most one slot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
SLOTS = 65537  # a prime: every step visits every slot; over 1000 slots for each of 64 shards
DIGITS = 15  # leading hex digits of a digest: 60 bits


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """For each slot the number of the shard that claimed it."""
    if not shards:
        raise ValueError("at least one shard is needed")
    if len(set(shards)) < len(shards):
        raise ValueError("shard names must differ")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")
    place = [_number(f"offset/{s}") % slots for s in shards]
    step = [_number(f"step/{s}") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % slots
            table[place[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key; a missing key counts as an empty one."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(
    docs: DataFrame, key_col: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS, into: str = "shard"
) -> DataFrame:
    """``docs`` with a column ``into``, the number of the row's shard.

    The key alone decides, so repeated rows share a shard and reruns agree.  A missing key goes
    where an empty one goes.  A column of ``docs`` that is called ``into`` is replaced.
    """
    spark = docs.sparkSession
    text = ",".join(map(str, lookup_table(shards, slots)))
    table = spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("__ff_slot", "__ff_shard"))
    table = table.select("__ff_slot", F.col("__ff_shard").cast("int").alias("__ff_shard"))
    placed = docs.withColumn("__ff_slot", slot_of(F.col(key_col), slots)).join(F.broadcast(table), "__ff_slot")
    return placed.withColumn(into, F.col("__ff_shard")).drop("__ff_slot", "__ff_shard")


def shards_of(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, slot, shard) per row of ``docs``; other columns are ignored."""
    ids = docs.select(F.col(id_col))
    return place(ids, id_col).select(id_col, slot_of(F.col(id_col)).alias("slot"), "shard")
