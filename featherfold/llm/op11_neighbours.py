"""Nearest neighbours by collision counting over sorted single projections.

Index: rows stay where they are.  Each task cuts its rows into blocks; a block keeps its vectors
and, for each of some random projections, their values in order with the places they came from.
Search: queries meet all blocks, in rounds of bounded size.  Around a query's own projections a
window opens in each sorted array, of a width in proportion to the search radius; with the
radius the windows grow (virtual rehashing: the arrays stay), and only what is new in them is counted.
A vector that lies in ``threshold`` windows is verified by its true distance.  A query leaves a block
when the distance of its k-th best is within the radius.

The first bound of a query's radius is its k-th distance within a bounded sample; a task carries what
it found from block to block, so later blocks start with a smaller one.  The threshold follows from
``miss``, the chance that a vector within the radius is not verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, rows_of
from .vectors import main_dimension, matrix, usable

ROUND_BYTES = 32 << 20  # queries of one round, which are broadcast


@dataclass(frozen=True)
class Hashing:
    """Parameters of the index and of the search.

    ``reach``: half a window in units of the radius; ``miss``: chance that a vector within the radius stays
    below the threshold; ``growth`` and ``levels``: steps of the radius; ``block``: rows of a block;
    ``sample``: rows that give the first radius; ``chunk``: queries that a block takes at once.
    """

    projections: int = 64
    reach: float = 1.0
    miss: float = 1e-5
    growth: float = 1.25
    levels: int = 5
    block: int = 2048
    sample: int = 4096
    chunk: int = 256
    seed: int = 11

    def threshold(self) -> int:
        """The most collisions that a vector at the radius reaches but for a chance of ``miss``."""
        p, m = math.erf(self.reach / math.sqrt(2)), self.projections
        below = 0.0
        for hits in range(m):
            below += math.comb(m, hits) * p**hits * (1 - p) ** (m - hits)
            if below > self.miss:
                return max(hits, 1)
        return m

    def directions(self, d: int) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((d, self.projections))


def build_index(vectors: DataFrame, d: int, how: Hashing = Hashing()) -> DataFrame:
    """One row per block: ids, vectors, sorted projections and the places they came from, as bytes."""

    def block(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        keys = (x @ how.directions(d)).T.astype("<f4")
        order = np.argsort(keys, axis=1, kind="stable")
        held = x.astype("<f4") if (x == x.astype("<f4")).all() else x
        parts = [ids.astype("<i8"), held, np.take_along_axis(keys, order, axis=1), order.astype("<u2")]
        return pa.RecordBatch.from_arrays(
            [pa.array([len(ids)], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
            names=["rows", "ids", "vectors", "keys", "places"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in rows_of(batches, how.block):
            for start, stop in ((0, min(how.block - held, batch.num_rows)), (how.block - held, batch.num_rows)):
                if stop <= start:
                    continue
                part = batch.slice(start, stop - start)
                ids.append(part.column(0).to_numpy())
                parts.append(matrix(part.column(1), d))
                held += len(parts[-1])
                if held == how.block:
                    yield block(np.concatenate(ids), np.concatenate(parts))
                    ids, parts, held = [], [], 0
        if held:
            yield block(np.concatenate(ids), np.concatenate(parts))

    if how.block > 1 << 16:
        raise ValueError("a block has at most 65536 rows")
    made = vectors.select("id", "vector").mapInArrow(run, "rows int, ids binary, vectors binary, keys binary, places binary")
    return materialize(made, "neighbour-index")


def distances(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    off = x - query
    return np.sqrt((off * off).sum(axis=1))


@dataclass
class Queries:
    """The queries of one round with their projections and first radii."""

    ids: np.ndarray
    x: np.ndarray
    keys: np.ndarray
    radius: np.ndarray


class Best:
    """The k nearest so far of each query, nearest first, ties to the smaller id."""

    def __init__(self, queries: Queries, k: int):
        self.k, self.rows = k, [[] for _ in queries.ids]
        self.radius = queries.radius.copy()

    def add(self, q: int, far: np.ndarray, ids: np.ndarray) -> None:
        near = far <= self.radius[q]
        if near.any():
            rows = sorted([*self.rows[q], *zip(far[near].tolist(), ids[near].tolist())])[: self.k]
            self.rows[q] = rows
            if len(rows) == self.k:
                self.radius[q] = min(self.radius[q], rows[-1][0])


def search_block(
    ids: np.ndarray, x: np.ndarray, keys: np.ndarray, places: np.ndarray, queries: Queries, best: Best, how: Hashing
) -> int:
    """Offer all vectors of a block to ``best`` that lie in enough windows; the number of verified ones."""
    m, n = keys.shape
    threshold, verified = how.threshold(), 0
    for first in range(0, len(queries.ids), how.chunk):
        active = np.arange(first, min(first + how.chunk, len(queries.ids)))
        base = active[0]
        counts, seen = np.zeros((len(active), n), np.int16), np.zeros((len(active), n), bool)
        own = queries.keys[active]
        low = np.stack([np.searchsorted(keys[i], own[:, i]) for i in range(m)], axis=1)
        high, top = low.copy(), best.radius[active].copy()
        for level in range(how.levels + 1):
            radius = top[active - base] / how.growth ** (how.levels - level)
            slack = 1e-5 * np.abs(queries.keys[active]).max(axis=1) + 1e-30  # projections are held in single precision
            half = (how.reach * radius + slack)[:, None]
            left, right = queries.keys[active] - half, queries.keys[active] + half
            new_low = np.stack([np.searchsorted(keys[i], left[:, i], "left") for i in range(m)], axis=1)
            new_high = np.stack([np.searchsorted(keys[i], right[:, i], "right") for i in range(m)], axis=1)
            still = []
            for a, q in enumerate(active):
                c = q - base
                grown = [places[i, s:e] for i in range(m) for s, e in ((new_low[a, i], low[c, i]), (high[c, i], new_high[a, i])) if s < e]
                if grown:
                    counts[c] += np.bincount(np.concatenate(grown), minlength=n).astype(np.int16)
                    low[c], high[c] = np.minimum(new_low[a], low[c]), np.maximum(new_high[a], high[c])
                    fresh = np.flatnonzero((counts[c] >= threshold) & ~seen[c])
                    seen[c, fresh] = True
                    fresh = fresh[ids[fresh] != queries.ids[q]]
                    verified += len(fresh)
                    if len(fresh):
                        best.add(q, distances(x[fresh], queries.x[q]), ids[fresh])
                if not best.radius[q] <= radius[a]:
                    still.append(q)
            active = np.array(still, int)
            if not len(active):
                break
    return verified


def search_index(index: DataFrame, queries: Queries, k: int, d: int, how: Hashing = Hashing()) -> DataFrame:
    """(query_id, vec_id, score): per task the k nearest that it found for each query."""
    held = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Queries = held.value
        best = Best(asked, k)
        for batch in batches:
            for row in range(batch.num_rows):
                n, ids, x, keys, places = [batch.column(c)[row] for c in range(5)]
                n, x = n.as_py(), x.as_buffer()
                x = np.frombuffer(x, "<f4" if x.size == 4 * n * d else "<f8").reshape(n, d).astype(float)
                keys = np.frombuffer(keys.as_buffer(), "<f4").reshape(-1, n)
                places = np.frombuffer(places.as_buffer(), "<u2").reshape(-1, n)
                search_block(np.frombuffer(ids.as_buffer(), "<i8"), x, keys, places, asked, best, how)
        found = [(int(asked.ids[q]), i, far) for q, rows in enumerate(best.rows) for far, i in rows]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        columns = zip(*found) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def _sample(rows: DataFrame, n: int, how: Hashing) -> tuple[np.ndarray, np.ndarray]:
    """At most twice ``sample`` rows, by a digest."""
    steps = 1 << 20
    share = min(steps, math.ceil(1.2 * how.sample * steps / n))
    some = rows.where(F.pmod(F.xxhash64("id", F.lit(how.seed)), F.lit(steps)) < share).limit(2 * how.sample).collect()
    return np.array([r["id"] for r in some], np.int64), np.array([r["vector"] for r in some], float)


def nearest(
    embeddings: DataFrame,
    every: int = 100,
    k: int = 10,
    how: Hashing = Hashing(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query by Euclidean distance.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but those with the query's
    own id.  Vectors that are missing, empty, zero or hold missing or non-finite entries take no part; nor do
    rows without an id and vectors of another length than most have.  Repeated rows are candidates of their
    own; an id with several vectors is one query, by the least of them.  Ties go to the smaller id.  With
    fewer than k candidates all are told; an empty table gives no rows.  Other columns are ignored.
    """
    rows = usable(embeddings, id_col, vector_col).where("id IS NOT NULL AND exists(vector, c -> c <> 0)")
    d, n = main_dimension(rows)
    spark = embeddings.sparkSession
    if not n:
        return spark.range(0).selectExpr("id AS query_id", "CAST(id AS int) AS rank", "id AS vec_id", "CAST(id AS double) AS score")
    rows = rows.where(F.size("vector") == d)
    index = build_index(rows, d, how)
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = materialize(asked, "neighbour-queries")
    rounds = max(1, -(-asked.count() * (d + how.projections + 2) * 8 // ROUND_BYTES))
    sample_ids, sample = _sample(rows, n, how)
    turns = how.directions(d)
    found = []
    for turn in range(rounds):  # one for some ten thousand queries
        got = asked.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == turn).orderBy("id").collect()
        if not got:
            continue
        ids, x = np.array([r["id"] for r in got], np.int64), np.array([r["vector"] for r in got], float)
        radius = np.full(len(ids), np.inf)
        for q in range(len(ids)):
            far = distances(sample[sample_ids != ids[q]], x[q]) if len(sample) else sample
            if len(far) >= k:
                radius[q] = np.partition(far, k - 1)[k - 1]
        found.append(search_index(index, Queries(ids, x, x @ turns, radius), k, d, how))
    if not found:
        return nearest(embeddings.limit(0), every, k, how, id_col, vector_col)
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
