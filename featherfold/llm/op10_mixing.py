"""Mixing sources to target weights by weighted fair queueing, in Spark functions.

Each source's documents are shuffled by a digest of their id, text and, if these repeat, number.  A document's virtual finish time is
the words of its source up to and including it, divided by the source's target; a second and third
pass over a source follow its first.  Ordered by finish time, all sources reach their targets
together, so the mix is the longest head of that order within the total budget.

The running sums need no whole source in one task: the shuffle order is cut into ranges of the
digest, range totals give each range its start, and only one range is ever sorted at once.  The cut
at the budget is found by totals over bins of the finish time, finer and finer within the bin that
the budget falls into, until that bin holds few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, text_of

WEIGHTS = (5, 2, 1)
REPEATS = 3
RANGES = 3  # hex digits of the digest that name a range: 4096 ranges
BINS = 4096
FEW = 10_000


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, repeats: int = REPEATS) -> DataFrame:
    """(source, rank, source_size, target) from one row (source, source_size) per source.

    Sources in code point order, a missing one last, get the weights in turn.  A target is at most
    ``repeats`` times its source's size; what is over goes to the others by weight, until none is above.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one short row per source
    w = F.lit([float(x) for x in weights])
    rows = sizes.withColumn("rank", F.row_number().over(order) - 1)
    rows = rows.withColumn("weight", F.element_at(w, (F.col("rank") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", repeats * F.col("source_size"))
    # sources fill up in order of cap / weight: a source is at its cap if the level that it and
    # all after it would reach, once those before it are full, is not below its own ratio
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left = total * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rows = rows.withColumn("level", left / F.sum("weight").over(onward))
    rows = rows.withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(
        fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )["level"]
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return rows.select("source", "rank", "source_size", target.alias("target"))


def _queue(docs: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """(id, source, size, key, digest) with rank, source_size, target and ``upto``, the source's words up to the row."""
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(sizes, weights, share, repeats).withColumnRenamed("source", "s")
    ranged = docs.withColumn("range", F.substring("digest", 1, RANGES))
    totals = ranged.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    by = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "range", F.coalesce(F.sum("sum").over(by), F.lit(0)).alias("start"))
    starts = starts.join(aims, starts["source"].eqNullSafe(aims["s"]))
    starts = starts.select("s", F.col("range").alias("r"), "start", "rank", "source_size", "target")
    # rows that agree in all of the order count as one step, so that reruns agree
    own = Window.partitionBy("source", "range").orderBy("digest", "id", "size")
    ranged = ranged.withColumn("inside", F.sum("size").over(own))
    joined = ranged.join(starts, ranged["source"].eqNullSafe(starts["s"]) & (ranged["range"] == starts["r"]))
    return joined.withColumn("upto", F.col("start") + F.col("inside")).drop("s", "r", "start", "inside", "range")


KEY = ("finish", "rank", "turn", "digest", "id", "size")


def _last(queue: DataFrame, budget: float) -> Row | None:
    """The last key of the longest head of the queue that stays within the budget."""
    open_, before, levels = queue, 0, []
    top = queue.agg(F.max("finish")).first()[0]
    if top is None:
        return None
    low, high = 0.0, top
    for _ in range(8):
        width = max((high - low) / BINS, 1e-300)
        binned = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("finish") - low) / width))).cast("int")
        sums = open_.groupBy(binned.alias("bin")).agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("n"))
        hit, rows = BINS, 0
        for b, total, n in sorted(tuple(r) for r in sums.collect()):  # at most BINS rows
            if before + total > budget:
                hit, rows = b, n
                break
            before += total
        levels.append(open_.where(binned < hit))
        open_ = open_.where(binned == hit)
        low, high = low + hit * width, low + (hit + 1) * width
        if rows <= FEW:
            break
    key = F.struct(*KEY)
    run = F.sum("size").over(Window.orderBy(*KEY))  # few rows: those of one bin, with ties as one step
    found = open_.withColumn("run", run).where(F.col("run") <= budget - before).agg(F.max(key)).first()[0]
    for level in reversed(levels):
        found = level.agg(F.max(key)).first()[0] if found is None else found
    return found


def _steps(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, size, key, digest) per row: its place in the shuffle of its source.

    ``key`` is a digest of the text.  Rows that agree in id, source and text are counted first and then numbered, so
    that each has a digest of its own: a hot id, or all rows without one, spread over all ranges.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text).alias("size"), F.md5(text).alias("key"))
    rows = rows.groupBy("id", "source", "size", "key").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    name = F.concat_ws("/", F.lit("mix"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("key"), F.col("j").cast("string"))
    return materialize(rows.select("id", "source", "size", "key", F.md5(name).alias("digest")), "mix-sizes")


def _plan(steps: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """The rows of :func:`_steps` with source_size, target and copies."""
    lined = materialize(_queue(steps, weights, share, repeats), "mix-queue")
    budget = lined.groupBy("rank").agg(F.first("target").alias("t")).agg(F.sum("t")).first()[0] or 0.0

    finish = lambda turn: (turn * F.col("source_size") + F.col("upto")) / F.col("target")
    queue = lined.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    last = _last(queue.select(finish(F.col("turn")).alias("finish"), "rank", "turn", "digest", "id", "size"), budget)
    copies = F.lit(0)
    if last is not None:
        # turns follow each other, so the copies are the turns whose key is not after the last one
        cut = F.struct(
            F.lit(last["finish"]), F.lit(last["rank"]), F.lit(last["turn"]), F.lit(last["digest"]),
            F.lit(last["id"]).cast(lined.schema["id"].dataType), F.lit(last["size"]).cast("long"),
        )
        for turn in range(repeats):
            key = F.struct(finish(F.lit(turn)), F.col("rank"), F.lit(turn), F.col("digest"), F.col("id"), F.col("size"))
            copies = copies + F.when((F.col("size") > 0) & (key <= cut), 1).otherwise(0)
    return lined.select("id", "source", "size", "key", "source_size", "target", copies.alias("copies"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.0,
    repeats: int = REPEATS,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies, taken.

    ``size`` counts words; a missing text has none.  ``copies`` is how often the mix holds the
    document, from 0 to ``repeats``, and ``taken`` its words, ``size * copies``.  A missing source
    is a source of its own and comes last.  Documents without words are not taken (0 copies).
    Repeated rows, rows of one id and rows without an id are documents of their own, each with a place of its
    own in the shuffle; of equal rows it is only told how many have how many copies.  Other columns are ignored; an
    empty table gives no rows.  Runs small jobs to find the cut.
    """
    plan = _plan(_steps(docs, id_col, source_col, text_col), weights, share, repeats)
    out = plan.select("id", "source", "size", "source_size", "target", "copies")
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, repeats: int = REPEATS) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text and others), each as often as the mix holds it.

    Rows that agree in id, source and text count as one document that is there several times: all its copies
    have the other columns of the least such row.
    """
    plan = _plan(_steps(docs, "doc_id", "source", "text"), weights, share, repeats)
    plan = plan.groupBy(F.col("id").alias("__ff_id"), F.col("source").alias("__ff_source"), F.col("key").alias("__ff_key"))
    plan = plan.agg(F.count(F.lit(1)).alias("__ff_n"), F.sum("copies").alias("__ff_copies")).where("__ff_copies > 0")
    plan = materialize(plan, "mix-plan")
    names = docs.columns

    def of(groups: DataFrame) -> DataFrame:
        same = F.col("doc_id").eqNullSafe(F.col("__ff_id")) & F.col("source").eqNullSafe(F.col("__ff_source"))
        return docs.join(groups, same & (F.md5(text_of("text")) == F.col("__ff_key")))

    out, several = of(plan.where("__ff_n = 1")), plan.where("__ff_n > 1")
    if not several.isEmpty():
        keys = ["__ff_id", "__ff_source", "__ff_key", "__ff_n", "__ff_copies"]
        least = of(several).groupBy(*keys).agg(F.min(F.struct(*[F.col(f"`{n}`") for n in names])).alias("row"))
        out = out.unionByName(least.select("row.*", *keys), allowMissingColumns=False)
    return out.withColumn("__ff_copy", F.explode(F.sequence(F.lit(1).cast("long"), "__ff_copies"))).select(*names)
