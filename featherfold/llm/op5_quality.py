"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, and learned filters over 8 bytes move over the whole text in steps of 4.  Each
chunk of 256 bytes, a new one every 128, keeps the largest value of each filter; a hidden layer reads
each chunk; the largest and the mean value of its units over all chunks give one probability.

The network is trained on the driver from a bounded sample of labelled rows and then broadcast (some
tens of kilobytes).  Scoring is one pass over the documents without a shuffle.  Only the text is an
input of a score.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_of, strings, text_of

DIM, STEP, FILTERS, UNITS = 8, 4, 32, 16
HALF = 128  # a chunk is two halves, and each half begins a chunk
SPOTS = HALF // STEP  # filter places in a half


@dataclass(frozen=True)
class Training:
    """Bounds of the sample and steps of the training.

    ``rows`` labelled rows of each class at most (those with the least digests of their ids), of
    texts of ``text_bytes`` bytes at most; longer ones are scored like all others but not learned from.
    """

    rows: int = 2000
    text_bytes: int = 16384
    epochs: int = 10
    batch: int = 24
    rate: float = 0.004
    seed: int = 7


@dataclass
class Net:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # 2 x STEP * DIM x FILTERS: first and second half of 8 bytes
    bias: np.ndarray
    hidden: np.ndarray  # FILTERS x UNITS
    hidden_bias: np.ndarray
    out: np.ndarray  # 2 * UNITS
    out_bias: np.ndarray

    @staticmethod
    def fresh(seed: int) -> "Net":
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        return Net(
            draw(0.5, 256, DIM), draw((2 / (2 * STEP * DIM)) ** 0.5, 2, STEP * DIM, FILTERS), np.zeros(FILTERS, np.float32),
            draw((2 / FILTERS) ** 0.5, FILTERS, UNITS), np.zeros(UNITS, np.float32), draw(0.2, 2 * UNITS), np.zeros(1, np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


@dataclass
class Batch:
    """Texts padded to whole halves, one after the other."""

    data: np.ndarray  # bytes, whole steps
    live: np.ndarray  # for each filter place whether it begins within its text
    halves: np.ndarray  # number of halves of each text
    joined: np.ndarray  # for each half whether the next one is of the same text

    @staticmethod
    def of(texts: list[bytes]) -> "Batch":
        sizes = np.array([len(t) for t in texts])
        halves = np.maximum(1, -(-sizes // HALF))
        data = np.frombuffer(b"".join(t.ljust(h * HALF, b"\0") for t, h in zip(texts, halves.tolist())), np.uint8)
        ends = np.cumsum(halves)
        place = np.arange(ends[-1] * SPOTS) * STEP
        owner = np.repeat(np.arange(len(texts)), halves * SPOTS)
        live = place - (ends - halves)[owner] * HALF < sizes[owner]
        joined = np.ones(ends[-1], bool)
        joined[ends - 1] = False
        return Batch(data, live, halves, joined)


def _forward(net: Net, b: Batch) -> tuple:
    """Probabilities, and what the gradient needs."""
    x = net.embed[b.data].reshape(-1, STEP * DIM)
    left, right = x @ net.filters[0], x @ net.filters[1]
    left[:-1] += right[1:]  # a filter's second half; behind the last place of a text stands padding or the next text
    last = np.cumsum(b.halves) * SPOTS - 1
    left[last] -= np.where((last + 1 < len(right))[:, None], right[np.minimum(last + 1, len(right) - 1)], 0)
    left += net.bias
    np.maximum(left, 0, out=left)
    left[~b.live] = 0
    spots = left.reshape(-1, SPOTS, FILTERS)
    half = spots.max(1)
    after = np.zeros_like(half)
    after[:-1] = half[1:]
    after[~b.joined] = 0
    chunk = np.maximum(half, after)
    # a text of more than one half has one chunk less than halves: its last half stands in the chunk before
    ends = np.cumsum(b.halves)
    keep = np.ones(len(half), bool)
    keep[ends[b.halves > 1] - 1] = False
    units = np.maximum(chunk[keep] @ net.hidden + net.hidden_bias, 0)
    counts = np.where(b.halves > 1, b.halves - 1, 1)
    starts = np.cumsum(counts) - counts
    most = np.maximum.reduceat(units, starts, axis=0)
    mean = np.add.reduceat(units, starts, axis=0) / counts[:, None]
    doc = np.concatenate([most, mean], 1)
    z = doc @ net.out + net.out_bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), (x, spots, half, after, chunk, keep, units, counts, starts, doc)


def _gradient(net: Net, b: Batch, p: np.ndarray, y: np.ndarray, w: np.ndarray, kept: tuple) -> list[np.ndarray]:
    x, spots, half, after, chunk, keep, units, counts, starts, doc = kept
    dz = ((p - y) * w / w.sum()).astype(np.float32)
    d_out, d_out_bias = doc.T @ dz, dz.sum(keepdims=True)
    d_doc = dz[:, None] * net.out[None, :]
    owner = np.repeat(np.arange(len(counts)), counts)
    d_units = (d_doc[:, UNITS:] / counts[:, None])[owner]
    top = units == doc[:, :UNITS][owner]
    share = top / np.add.reduceat(top, starts, axis=0)[owner]
    d_units = (d_units + share * d_doc[:, :UNITS][owner]) * (units > 0)
    d_units = d_units.astype(np.float32)
    d_hidden, d_hidden_bias = chunk[keep].T @ d_units, d_units.sum(0)
    d_chunk = np.zeros_like(chunk)
    d_chunk[keep] = d_units @ net.hidden.T
    own = half >= after
    d_half = np.where(own, d_chunk, 0)
    d_half[1:] += np.where(own, 0, d_chunk)[:-1]
    h, f = np.nonzero((d_half != 0) & (half > 0))
    place = h * SPOTS + spots.argmax(1)[h, f]  # only the largest place of a half learns
    g = d_half[h, f]
    d_filters = np.zeros_like(net.filters)
    d_x = np.zeros_like(x)
    d_bias = np.bincount(f, g, FILTERS).astype(np.float32)
    for k in range(FILTERS):
        at = np.flatnonzero(f == k)
        for side in (0, 1):
            inside = at if side == 0 else at[place[at] + 1 < len(x)]
            if side:  # not over the end of a text
                last = np.zeros(len(x), bool)
                last[np.cumsum(b.halves) * SPOTS - 1] = True
                inside = inside[~last[place[inside]]]
            d_filters[side, :, k] = g[inside] @ x[place[inside] + side]
            np.add.at(d_x, place[inside] + side, g[inside, None] * net.filters[side, :, k][None, :])
    hit = np.flatnonzero(d_x.any(1))
    d_embed = np.zeros_like(net.embed)
    np.add.at(d_embed, b.data.reshape(-1, STEP)[hit].ravel(), d_x[hit].reshape(-1, DIM))
    return [d_embed, d_filters, d_bias, d_hidden, d_hidden_bias, d_out, d_out_bias]


def fit(texts: list[bytes], labels: list[int], weights: list[float], how: Training = Training()) -> Net:
    """Train by Adam on the log loss.  Same input, same network.  Without both labels all scores are the label's share."""
    net = Net.fresh(how.seed)
    y, w = np.array(labels, np.float32), np.array(weights, np.float32)
    share = float(np.clip((y * w).sum() / w.sum(), 0.01, 0.99)) if len(y) else 0.5
    net.out_bias[0] = np.log(share / (1 - share))
    if len(set(labels)) < 2:
        net.out[:] = 0
        return net
    rng = np.random.default_rng(how.seed)
    first, second = [np.zeros_like(a) for a in net.parts()], [np.zeros_like(a) for a in net.parts()]
    step, steps = 0, how.epochs * -(-len(texts) // how.batch)
    for _ in range(how.epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(texts), how.batch):
            mine = order[at : at + how.batch]
            b = Batch.of([texts[i] for i in mine])
            p, kept = _forward(net, b)
            step += 1
            rate = how.rate * min(1, 20 * step / steps) * (1 - 0.9 * step / steps)
            for a, g, m, v in zip(net.parts(), _gradient(net, b, p, y[mine], w[mine], kept), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def score(net: Net, texts: list[str], group_bytes: int = 1 << 16) -> list[float]:
    """Probabilities of whole texts.  A long text goes through in pieces of whole halves that overlap by one."""
    out, group, size = [], [], 0
    for text in texts:
        data = text.encode()
        if len(data) > 4 * group_bytes:
            out += _scores(net, group)
            group, size = [], 0
            out.append(_score_long(net, data, group_bytes))
            continue
        group.append(data)
        size += len(data)
        if size >= group_bytes:
            out += _scores(net, group)
            group, size = [], 0
    return out + _scores(net, group)


def _scores(net: Net, texts: list[bytes]) -> list[float]:
    return _forward(net, Batch.of(texts))[0].astype(float).tolist() if texts else []


def _score_long(net: Net, data: bytes, piece: int) -> float:
    """As one text, but with bounded memory: chunk maxima and sums are carried over the pieces."""
    most, total, n = np.full(UNITS, -np.inf, np.float32), np.zeros(UNITS), 0
    for at in range(0, len(data) - HALF, piece):
        # a chunk and the filter at its end reach into what follows
        part = data[at : at + piece + HALF + STEP]
        halves = -(-min(len(part), piece + HALF) // HALF)
        _, kept = _forward(net, Batch.of([part]))
        units = kept[6][: halves - 1] if halves > 1 else kept[6]
        most, total, n = np.maximum(most, units.max(0)), total + units.sum(0), n + len(units)
    z = np.concatenate([most, total / n]) @ net.out + net.out_bias[0]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, how: Training = Training(), id_col: str = "doc_id", text_col: str = "text") -> Net:
    """A network from labelled rows that are not held out.

    Labels are 0 or 1; other values and missing ones are left out, and of several labels of an id the
    smallest counts.  Rows without an id are not learned from.  Classes are weighted by their true shares.
    """
    marks = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.min("quality").cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    order = F.md5(F.col("id").cast("string"))
    picks = None
    for label in (0, 1):  # twice the rows, as some ids have no text or a long one
        some = marks.where(F.col("label") == label).orderBy(order, "id").limit(2 * how.rows)
        picks = some if picks is None else picks.union(some)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).where(F.octet_length("text") <= how.text_bytes)
    joined = texts.join(F.broadcast(picks), "id")  # at most 4 * rows short rows
    found, used = [], {0: 0, 1: 0}
    sample = joined.select("id", "label", order.alias("digest")).distinct().orderBy("digest", "id").collect()
    chosen = set()
    for r in sample:
        if used[r["label"]] < how.rows:
            used[r["label"]] += 1
            chosen.add(r["id"])
    # a literal, as a frame from a Python list would start Python workers of its own
    kind = joined.schema["id"].dataType.simpleString()
    ids = docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(sorted(chosen))), f"array<{kind}>")).alias("id"))
    rows = joined.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    for r in sorted(rows.collect(), key=lambda r: r["id"]):
        found.append((r["text"].encode(), r["label"], counts[r["label"]] / used[r["label"]]))
    return fit([f[0] for f in found], [f[1] for f in found], [f[2] for f in found], how)


def score_documents(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) per row of ``docs``; missing and empty texts are scored as no bytes.

    Equal texts have scores that are equal up to rounding.  Repeated rows and rows without an id come
    out as they went in; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            scores = score(held.value, strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["id", "score", "predicted"],
            )

    return base.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, net: Net, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the network does not reject."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            yield batch.filter(pa.array([s >= 0.5 for s in score(held.value, strings(batch.column(at)))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
