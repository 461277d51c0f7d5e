"""Exact k-nearest-neighbour class shares.

Vectors are put into cells around pivots, whose number grows with the root of the rows.  Each query
first meets a block of its own cell, which bounds the distance of its k-th neighbour.  Two lower bounds tell which
cells reach into that distance: the cell's radius, and the plane halfway between the cell's pivot
and the query's own.  A query keeps them as one bit a cell and stays where it is.  The rows come to all queries, cell by
cell, in broadcast rounds of bounded size; a round measures what can be among the k nearest exactly, and stores no more
than k neighbours per query.  No vector is copied per cell that it is compared with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.scalar import stable_hash
from ..operators.ordered import first_rows
from ..session import shared_dir

BLOCK_ROWS = 20_000
MOST_PIVOTS = 2048  # rows that every task holds
SLACK = 1e-9
MOST_ENTRIES = 1 << 20  # of a matrix of distances that a task holds
MOST_BATCH = 1 << 12  # queries that a task compares at a time
ROUND_BYTES = 32 << 20  # of the rows of a round
PAIR = "query long, neighbour long, distance double"
NO_ID = np.iinfo(np.int64).max  # stands for a missing id, which sorts last


def pivot_count(rows: int) -> int:
    return max(1, min(MOST_PIVOTS, math.isqrt(rows)))


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``y`` by one product; exact but for rounding."""
    d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ y.T) + (y * y).sum(axis=1)
    return np.maximum(d, 0.0)


def _pieces(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Batches cut so that a matrix of their rows and ``width`` columns stays bounded."""
    step = max(1, MOST_ENTRIES // width)
    for b in batches:
        for start in range(0, len(b), step):
            yield b.iloc[start:start + step].copy()


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(float)


def _compare(left: DataFrame, right: DataFrame, k: int, block_rows: int) -> DataFrame:
    """``right``, the queries with their cells, with a bound: no less than the distance of the k-th row of a block of the cell in ``left``.

    A cell of many rows has several blocks, of which a query meets one, so that neither rows nor queries are copied.
    It is NULL where a block has fewer than ``k`` rows of other groups.
    """
    counted = left.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # a number per cell
    blocks = {int(r["cell"]): max(1, -(-int(r["n"]) // block_rows)) for r in counted}
    per_cell = F.lit([blocks.get(c, 1) for c in range(max(blocks, default=0) + 1)])

    def dealt(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("block", F.pmod(F.xxhash64(name), F.element_at(per_cell, F.col("cell") + 1)).cast("int"))

    def compare(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        bound = np.full(len(q), np.nan)
        if len(x) >= k and len(q):
            data, group = _matrix(x["vec"]), x["grp"].to_numpy()
            asked, own = _matrix(q["vec"]), q["grp"].to_numpy()
            step = max(1, MOST_ENTRIES // len(data))
            for start in range(0, len(asked), step):
                some = slice(start, start + step)
                d = squared_distances(asked[some], data)
                off = SLACK * (1.0 + (asked[some] ** 2).sum(axis=1) + d.max(axis=1))
                d[own[some][:, None] == group] = np.inf
                far = np.partition(d, k - 1, axis=1)[:, k - 1]
                bound[some] = np.where(np.isfinite(far), np.sqrt(far + off), np.nan)
        q = q[["qid", "vec", "grp", "cell"]].copy()
        q["bound"] = pd.Series(bound, index=q.index).astype("Float64").where(~np.isnan(bound), pd.NA)
        return q

    on = ["cell", "block"]
    schema = f"qid long, vec {right.schema['vec'].dataType.simpleString()}, grp int, cell int, bound double"
    return dealt(left, "nid").groupBy(*on).cogroup(dealt(right, "qid").groupBy(*on)).applyInPandas(compare, schema)


def _rounds(sizes: np.ndarray, most: int) -> list[tuple[int, int, int, int]]:
    """(first cell, last cell, slice, slices): cells in order, by ``most`` rows; a cell of more rows is cut into slices by id."""
    out, first, held = [], 0, 0
    for c, n in enumerate(int(n) for n in sizes):
        if held and held + n > most:
            out.append((first, c - 1, 0, 1))
            first, held = c, 0
        if n > most:
            slices = -(-n // most)
            out += [(c, c, i, slices) for i in range(slices)]
            first, held = c + 1, 0
        else:
            held += n
    return [*out, (first, len(sizes) - 1, 0, 1)] if held else out


class _Nearest:
    """The k nearest rows met so far of a batch of queries, by exact distance; ties by id."""

    def __init__(self, x: np.ndarray, group: np.ndarray, bound: np.ndarray, k: int):
        self.x, self.group, self.k, self.bound = x, group, k, bound
        self.norm = (x * x).sum(axis=1)
        self.turned = np.column_stack([-2.0 * x, self.norm, np.ones(len(x))])  # its product with (y, 1, y * y) is the squared distance
        self.d = np.full((len(x), k), np.inf)
        self.id = np.full((len(x), k), NO_ID)

    def meet(self, rows: np.ndarray, turned: np.ndarray, ids: np.ndarray, group: np.ndarray, some: np.ndarray) -> None:
        """Compare the queries ``some`` with ``rows``; what the product leaves open is measured."""
        rough = self.turned[some] @ turned.T
        off = SLACK * (1.0 + self.norm[some] + turned[:, -1].max())
        limit = np.minimum(self.bound[some], self.d[some, -1]) ** 2 + off
        at, row = np.nonzero(rough <= limit[:, None])
        query = some[at]
        other = self.group[query] != group[row]
        query, row = query[other], row[other]
        if not len(query):
            return
        d = np.empty(len(query))
        step = max(1, MOST_ENTRIES // rows.shape[1])
        for s in range(0, len(query), step):
            d[s:s + step] = np.sqrt(((rows[row[s:s + step]] - self.x[query[s:s + step]]) ** 2).sum(axis=1))
        met = np.unique(query)
        q = np.concatenate([query, np.repeat(met, self.k)])
        d, i = np.concatenate([d, self.d[met].ravel()]), np.concatenate([ids[row], self.id[met].ravel()])
        order = np.lexsort((i, d, q))
        q, d, i = q[order], d[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        best = rank < self.k
        self.d[q[best], rank[best]], self.id[q[best], rank[best]] = d[best], i[best]


def _round(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query, neighbour, distance): the k nearest of ``rows``, which are few enough for all tasks to hold, of each query that reaches their cells."""
    spark = rows.sparkSession
    table = rows.select("nid", "grp", "cell", "vec").orderBy("cell").toArrow().combine_chunks()
    if not table.num_rows:
        return spark.createDataFrame([], PAIR)
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    ids = table.column("nid").fill_null(int(NO_ID)).to_numpy()
    held = spark.sparkContext.broadcast((ids, table.column("grp").to_numpy(), table.column("cell").to_numpy(), flat.reshape(table.num_rows, -1)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups, cells, vectors = held.value
        vectors = vectors.astype(float)
        turned = np.column_stack([vectors, np.ones(len(vectors)), (vectors * vectors).sum(axis=1)])
        starts = np.concatenate([[0], np.nonzero(np.diff(cells))[0] + 1, [len(cells)]])
        for batch in batches:
            for start in range(0, batch.num_rows, MOST_BATCH):
                b = batch.slice(start, MOST_BATCH)
                x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
                bits = np.frombuffer(b"".join(b.column("cells").to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
                near = _Nearest(x, b.column("grp").to_numpy(zero_copy_only=False), b.column("bound").to_numpy(), k)
                for low, high in zip(starts[:-1], starts[1:]):
                    c = int(cells[low])
                    some = np.nonzero(bits[:, c >> 3] & (128 >> (c & 7)))[0]
                    step = max(1, MOST_ENTRIES // max(1, len(some)))
                    for at in range(low, high if len(some) else low, step):
                        part = slice(at, min(at + step, high))
                        near.meet(vectors[part], turned[part], ids[part], groups[part], some)
                who, rank = np.nonzero(np.isfinite(near.d))
                found = near.id[who, rank]
                columns = [b.column("qid").take(pa.array(who)), pa.array(found, mask=found == NO_ID), pa.array(near.d[who, rank])]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "neighbour", "distance"])

    found = _stored(asked.mapInArrow(compare, PAIR), "neighbours-round")
    held.destroy()
    return found


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nearest(
    train: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, pivots: int | None = None,
    block_rows: int = BLOCK_ROWS, not_same: str | None = None,
) -> DataFrame:
    """(query, neighbour, distance): the k nearest train rows of each query by Euclid; ties by id.

    ``not_same`` names a small-integer column such as a fold: rows that agree on it
    are no neighbours, so one run scores every row from the other folds.
    """
    kind = "array<float>" if train.schema[vector].dataType == queries.schema[vector].dataType == ArrayType(FloatType()) else "array<double>"
    vec = F.col(vector).cast(kind).alias("vec")
    own = F.col(not_same).cast("int") if not_same else None
    base = train.select(F.col(key).cast("long").alias("nid"), vec, (F.lit(0) if own is None else own).alias("grp"))
    asked = queries.select(F.col(key).cast("long").alias("qid"), vec, (F.lit(-1) if own is None else own).alias("grp"))
    wanted = pivots or pivot_count(base.count())
    picked = base.orderBy(stable_hash(["nid"], "pivot"), "nid").limit(wanted).collect()  # MOST_PIVOTS rows at most
    if not picked:
        return train.sparkSession.range(0).selectExpr("id AS query", "id AS neighbour", "CAST(id AS double) AS distance")
    centres = np.unique(np.array([r["vec"] for r in picked], dtype=float), axis=0)

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _pieces(batches, len(centres)):
            x = _matrix(b["vec"])
            cell = squared_distances(x, centres).argmin(axis=1)
            b["cell"] = cell.astype("int32")
            b["reach"] = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
            yield b

    cells = _stored(base.mapInPandas(to_cells, f"nid long, vec {kind}, grp int, cell int, reach double"), "neighbours-rows")
    # pivots x groups rows at most
    stats = cells.groupBy("cell", "grp").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("r")).collect()
    sizes, radii = np.zeros(len(centres), dtype=np.int64), np.full(len(centres), -1.0)
    of_group: dict[int, np.ndarray] = {}
    for s in stats:
        c = s["cell"]
        sizes[c] += s["n"]
        radii[c] = max(radii[c], s["r"])
        of_group.setdefault(s["grp"], np.zeros(len(centres), dtype=np.int64))[c] += s["n"]
    filled = np.nonzero(sizes)[0]
    none = np.zeros(len(centres), dtype=np.int64)

    def own_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _pieces(batches, len(centres)):
            d = squared_distances(_matrix(b["vec"]), centres[filled])
            b["cell"] = filled[d.argmin(axis=1)].astype("int32")
            yield b

    placed = asked.mapInPandas(own_cell, f"qid long, vec {kind}, grp int, cell int")
    between = np.sqrt(squared_distances(centres, centres))

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _pieces(batches, len(centres)):
            x, mine = _matrix(b["vec"]), b["cell"].to_numpy()
            d = np.sqrt(squared_distances(x, centres))
            bound = b["bound"].to_numpy(dtype=float, na_value=np.inf)
            open_ = np.isinf(bound)
            if open_.any():  # too few in the own cell: the cells that surely hold k rows
                far = np.where(sizes > 0, d[open_] + radii, np.inf)
                order = np.argsort(far, axis=1)
                usable = sizes - np.stack([of_group.get(int(g), none) for g in b["grp"].to_numpy()[open_]])
                total = np.cumsum(np.take_along_axis(usable, order, axis=1), axis=1)
                enough = (total < k).sum(axis=1).clip(max=len(filled) - 1)
                bound[open_] = np.take_along_axis(far, order, axis=1)[np.arange(len(order)), enough]
            nearest_cell = d[np.arange(len(x)), mine][:, None]
            gap = between[mine]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(gap > 0, (d * d - nearest_cell**2) / (2 * gap), 0.0)
            least = np.maximum(d - radii, plane)
            keep = (sizes > 0) & (least <= bound[:, None] * (1 + SLACK) + 1e-7 * (1 + nearest_cell))
            keep[np.arange(len(x)), mine] = True  # of its own cell it met one block
            b["bound"], b["cells"] = bound, [bits.tobytes() for bits in np.packbits(keep, axis=1)]
            yield b[["qid", "vec", "grp", "bound", "cells"]]

    bounded = _compare(cells, placed, k, block_rows)
    told = bounded.mapInPandas(reached, f"qid long, vec {kind}, grp int, bound double, cells binary")
    # dealt out evenly, whatever the sizes of the cells: each round is work for all cores
    context = train.sparkSession.sparkContext
    width = max(2 * context.defaultParallelism, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    asked = _stored(told.repartition(width), "neighbours-asked")
    found = None
    for first, last, part, parts in _rounds(sizes, max(1, ROUND_BYTES // (8 * centres.shape[1] + 24))):
        rows = cells.where(F.col("cell").between(first, last) & (F.pmod(F.xxhash64("nid"), F.lit(parts)) == part))
        met = _round(asked, rows, k)
        found = met if found is None else found.unionByName(met)
    return first_rows(found, ["query"], [F.col("distance").asc(), F.col("neighbour").asc()], k)


def neighbour_share(
    train: DataFrame, queries: DataFrame, key: str, vector: str, label: str, k: int = 10, name: str = "score",
    not_same: str | None = None,
) -> DataFrame:
    """(key, score): share of positive labels among the k nearest train rows."""
    found = nearest(train, queries, key, vector, k, not_same=not_same)
    labels = train.select(F.col(key).cast("long").alias("neighbour"), F.col(label).cast("double").alias("__y"))
    joined = found.join(labels, "neighbour", "inner")
    return joined.groupBy(F.col("query").alias(key)).agg(F.avg("__y").alias(name))
