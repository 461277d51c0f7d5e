"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND by every passage.

Items are the indexed side, training text the queries.  Texts are cut into passages of ``2 * stride``
words, a new one every ``stride`` words, with a stride no shorter than the items of the index, so each copy
of an item lies in one passage whole.  Scores are BM25 divided by the item's score for itself: 1 means
that the passage has all of the item's words.  All items at ``threshold`` or more are retrieved.

WAND runs in the order of its tests.  For all passages of a batch at once, the bounds of the blocks
of items are summed over a passage's words; blocks below the threshold are skipped.  For what is left, cursors
move over the postings: the pivot is found by the terms' bounds, checked by the bounds of the pivot's
block, and only then scored.  A hit must hold both the item's question and its answer:
shares of their word pairs that stand in the passage.

Index blocks have a bounded number of words.  Each is broadcast and the documents are scanned once
per block; statistics (document frequencies, lengths) cover all items.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of, strings, text_of

#: Scripts without spaces between words (Thai, Lao, Myanmar, Khmer, Kana, Han): each character is a token.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U000323af"
TOKEN = re.compile(rf"[^\W{UNSPACED}]+|(?=\w)[{UNSPACED}]")
K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.7  # least share of word pairs, of the question and of the answer
STRIDE = 64
LEAST_WORDS = 5  # of a scored item: shorter ones are found by a run of all their words
INDEX_WORDS = 500_000  # of items per broadcast index
BLOCKS = 64  # most blocks of items per index


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def pairs(words: list[str]) -> set:
    return set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)}


@dataclass
class Item:
    item_id: int | None
    question: list[str]
    answer: list[str]


@dataclass
class Index:
    """Postings by term, in order of item; bounds by term, and by term and block."""

    items: list[Item]
    stride: int
    ids: dict[str, int] = field(default_factory=dict)
    docs: list[list[int]] = field(default_factory=list)
    impacts: list[list[float]] = field(default_factory=list)
    bound: list[float] = field(default_factory=list)
    blocks: np.ndarray | None = None  # term x block
    width: int = 1
    short: dict[tuple[str, ...], list[int]] = field(default_factory=dict)  # words of a short item to its places

    @staticmethod
    def build(items: list[Item], frequency: dict[str, int], n_items: int, mean_length: float, stride: int) -> "Index":
        index = Index(items, stride)
        index.width = max(1, -(-len(items) // BLOCKS))
        for d, item in enumerate(items):
            words = item.question + item.answer
            if len(words) < LEAST_WORDS:
                index.short.setdefault(tuple(words), []).append(d)
                continue
            norm = K1 * (1 - B + B * len(words) / mean_length)
            weights = {}
            for w in dict.fromkeys(words):
                tf = words.count(w)
                idf = math.log(1 + (n_items - frequency[w] + 0.5) / (frequency[w] + 0.5))
                weights[w] = idf * tf * (K1 + 1) / (tf + norm)
            own = sum(weights.values())
            for w, x in weights.items():
                t = index.ids.setdefault(w, len(index.ids))
                if t == len(index.docs):
                    index.docs.append([])
                    index.impacts.append([])
                index.docs[t].append(d)
                index.impacts[t].append(x / own)
        index.bound = [max(x) for x in index.impacts]
        index.blocks = np.zeros((len(index.ids), -(-len(items) // index.width)), np.float32)
        for t, (ds, xs) in enumerate(zip(index.docs, index.impacts)):
            for d, x in zip(ds, xs):
                b = d // index.width
                index.blocks[t, b] = max(index.blocks[t, b], x)
        return index


def block_max_wand(index: Index, terms: list[int], alive: set[int], threshold: float) -> list[tuple[int, float]]:
    """Items of score ``threshold`` or more for a query of distinct terms; blocks not in ``alive`` are known to have none."""
    width, end = index.width, len(index.items)
    cursors = [[index.docs[t], index.impacts[t], 0, index.bound[t], t] for t in terms]
    found = []

    def seek(c: list, target: int) -> None:
        docs, at = c[0], c[2]
        while at < len(docs) and docs[at] < target:
            at += 1
        c[2] = at

    while True:
        cursors = sorted((c for c in cursors if c[2] < len(c[0])), key=lambda c: c[0][c[2]])
        total, pivot = 0.0, None
        for c in cursors:
            total += c[3]
            if total >= threshold:
                pivot = c[0][c[2]]
                break
        if pivot is None:
            return found
        block = pivot // width
        upto = [c for c in cursors if c[0][c[2]] <= pivot]
        if block not in alive or sum(float(index.blocks[c[4], block]) for c in upto) < threshold - 1e-4:
            # the block cannot reach the threshold with these terms: on to its end, or to the next term's item
            later = [c[0][c[2]] for c in cursors if c[0][c[2]] > pivot]
            target = min([(block + 1) * width, end, *later])
            if block not in alive:
                target = (block + 1) * width
                upto = [c for c in cursors if c[0][c[2]] < target]
            for c in upto:
                seek(c, target)
            continue
        if cursors[0][0][cursors[0][2]] == pivot:
            score = sum(c[1][c[2]] for c in upto)
            if score >= threshold:
                found.append((pivot, score))
            for c in upto:
                c[2] += 1
        else:
            for c in upto:
                seek(c, pivot)


def search(index: Index, texts: list[str], threshold: float, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item, score, question share, answer share) of the verified hits, the best passage of each."""
    stride, n_terms = index.stride, len(index.ids)
    known, places, words_of, segments = [], [], [], [0]
    get = index.ids.get
    for text in texts:
        words = tokens(text)
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        words_of.append(words)
        at = np.flatnonzero(ids >= 0)
        known.append(ids[at])
        places.append(at // stride + segments[-1])
        segments.append(segments[-1] + max(1, -(-len(words) // stride)))
    runs: list[set[int]] = [set() for _ in texts]
    for width in sorted({len(k) for k in index.short}):
        for d, words in enumerate(words_of):
            for gram in index.short.keys() & set(zip(*(words[k:] for k in range(width)))):
                runs[d].update(index.short[gram])
    if not sum(map(len, known)):
        yield from ((d, i, 1.0, 1.0, 1.0) for d, found in enumerate(runs) for i in sorted(found))
        return
    keys = np.unique(np.concatenate(places) * n_terms + np.concatenate(known))  # each term once per segment
    where, term = keys // n_terms, keys % n_terms
    starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    sums = np.zeros((segments[-1] + 1, index.blocks.shape[1]), np.float32)
    sums[where[starts]] = np.add.reduceat(index.blocks[term], starts, axis=0)
    bounds = np.append(starts, len(where))
    ends = dict(zip(where[starts].tolist(), zip(bounds[:-1].tolist(), bounds[1:].tolist())))
    for d in range(len(texts)):
        first, after = segments[d], segments[d + 1]
        own = sums[first:after]
        bound = own[:-1] + own[1:] if len(own) > 1 else own  # a passage is two segments
        rows, cols = np.nonzero(bound >= threshold - 1e-4)
        best: dict[int, tuple[float, float, float]] = {i: (1.0, 1.0, 1.0) for i in runs[d]}
        for p in np.unique(rows).tolist():
            terms = set()
            for s in (first + p, first + p + 1):
                if s in ends and s < after:
                    terms.update(term[ends[s][0] : ends[s][1]].tolist())
            hits = block_max_wand(index, sorted(terms), set(cols[rows == p].tolist()), threshold)
            if not hits:
                continue
            held = pairs(words_of[d][p * stride : (p + 2) * stride])
            bare = set(words_of[d][p * stride : (p + 2) * stride])
            for i, score in hits:
                shares = []
                for part in (index.items[i].question, index.items[i].answer):
                    wanted = pairs(part)
                    shares.append(sum(g in held if len(g) == 2 else bare.issuperset(g) for g in wanted) / len(wanted))
                if min(shares) >= overlap and (i not in best or score > best[i][0]):
                    best[i] = (score, *shares)
        for i, (score, q, a) in sorted(best.items()):
            yield d, i, score, q, a


def build_indexes(
    benchmark: DataFrame, item_col: str = "item_id", question_col: str = "text", answer_col: str | None = None,
    index_words: int = INDEX_WORDS,
) -> Iterator[Index]:
    """Indexes over all items, each over at most about ``index_words`` words.

    Without an answer column the last third of the item's words, at least one, is the answer.
    Items of fewer than ``LEAST_WORDS`` words are found by a run of all their words; missing and empty
    ones are not looked for.  Items have the stride of their class of length (a doubling of ``STRIDE``), so the
    passages for one item don't depend on the length of another.  Repeated items are items of their own.
    """
    text = text_of(question_col)
    answer = text_of(answer_col) if answer_col else F.lit(None).cast("string")
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), text.alias("q"), answer.alias("a"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            questions, answers = [], []
            for q, a in zip(strings(batch.column(1)), batch.column(2).to_pylist()):
                words = tokens(q)
                if a is None:
                    k = max(1, len(words) // 3)
                    words, tail = words[: len(words) - k], words[len(words) - k :]
                else:
                    tail = tokens(a)
                questions.append(words)
                answers.append(tail)
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(questions, kind), pa.array(answers, kind)], names=["item_id", "question", "answer"])

    items = materialize(rows.mapInArrow(cut, "item_id long, question array<string>, answer array<string>"), "items")
    items = items.select("*", F.concat("question", "answer").alias("words")).where(F.size("words") > 0)
    doublings = F.ceil(F.log2(F.size("words") / F.lit(STRIDE)))
    items = items.withColumn("stride", (F.lit(STRIDE) * F.pow(F.lit(2), F.greatest(doublings, F.lit(0)))).cast("int"))
    scored = items.where(F.size("words") >= LEAST_WORDS)
    n, total = scored.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    counts = scored.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    strides = items.groupBy("stride").agg(F.sum(F.size("words"))).collect()  # as many as doublings to the longest
    for stride, size in sorted(tuple(r) for r in strides):
        parts = -(-size // index_words)
        for part in range(parts):
            mine = items.where((F.col("stride") == stride) & (F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)) == part))
            rows = sorted((r["item_id"] is not None, r["item_id"] or 0, r["question"], r["answer"]) for r in mine.collect())
            words = mine.select(F.explode(F.array_distinct("words")).alias("word")).distinct()
            frequency = {r["word"]: r["n"] for r in counts.join(words, "word", "left_semi").collect()}
            built = [Item(i if has else None, q, a) for has, i, q, a in rows]
            yield Index.build(built, frequency, n, total / max(n, 1), stride)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
    id_col: str = "doc_id", text_col: str = "text", index_words: int = INDEX_WORDS, **items: str,
) -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap): a row per document row and item in it.

    Clean documents, missing and empty texts have no rows.  Ties between passages do not matter, the
    best score of an item counts.  Repeated rows have rows each; other columns are ignored.
    """
    schema = "id long, item_id long, score double, question_overlap double, answer_overlap double"
    names = [p.split()[0] for p in schema.split(", ")]
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    out = None
    for index in build_indexes(benchmark, index_words=index_words, **items):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in rows_of(batches, 64):
                ids = batch.column(0).to_pylist()
                hits = list(search(held.value, strings(batch.column(1)), threshold, overlap))
                if hits:
                    columns = [[ids[h[0]] for h in hits], [held.value.items[h[1]].item_id for h in hits], *zip(*[h[2:] for h in hits])]
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        found = base.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item.  Missing and empty texts stay."""
    at = docs.columns.index(text_col)
    for index in build_indexes(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in rows_of(batches, 64):
                bad = {h[0] for h in search(held.value, strings(batch.column(at)), threshold, overlap)}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)])) if bad else batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs
