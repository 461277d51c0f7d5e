"""N-gram Jaccard join with a prefix tree: every link of ``percent`` or more, as components.

How it runs, at any size:

1. One pass turns each text into the sorted 64-bit hashes of its distinct word n-grams, keeps
   (id, set size, digest of the set), and counts all n-grams in a table of fixed size.  Equal
   sets form one class; only one member of a class takes part in what follows.
2. The counts give a global order of n-grams, rarest slot first.  Any fixed order is right; this
   one puts shared passages last.  A second pass emits the first ``size - needed + 1`` n-grams of
   each set, without which two sets cannot link.
3. N-grams that only one class holds go away.  The smallest member of each remaining n-gram is a
   hub; a block is a hub with all that share an n-gram with it, so two sets that can link meet
   in a block.  Blocks over ``block_size`` are dealt into chunks, each with the hub.  Members whose
   sizes and numbers of shared n-grams fit no other member of the block leave it before any text moves.
4. Each block stores its sets in a prefix tree, ordered by frequency within the block, and
   walks the tree once per set: sets below a node share the overlap summed so far, and a subtree
   is left when even its longest rest could not reach the overlap that its sizes ask for.
   A subtree that is one component with the walking set already is left too.
5. Sets of chunked blocks that are not in the block's largest component yet meet every member
   chunk by chunk.  Then stars of links become components by alternating star contraction.

Memory per task is bounded by one block; nothing but the fixed table of counts reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize, rows_of, strings, text_of

SLOT_BITS = 20
SLICE = 4096
FEW_IDS = 1 << 20  # longs that are broadcast: 16 MB
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


class WordHashes(dict):
    """Word to 64-bit hash, remembered; forgets all when large."""

    LIMIT = 50_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles (all words as one if there are fewer)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * MIX[k % 4] + h[k : k + len(out)]
    out ^= out >> np.uint64(32)
    out *= MIX[0]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def needed(size: int, percent: int) -> int:
    """Least overlap of a set of ``size`` with anything it links to."""
    return -(-percent * size // 100)


def linked(overlap: int, a: int, b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (a + b - overlap)


# --- the prefix tree of one block -----------------------------------------------------------------


class Node:
    __slots__ = ("tokens", "length", "children", "leaves", "low", "high", "rest", "last", "one", "member")

    def __init__(self, tokens: tuple[int, ...]):
        self.tokens, self.length = frozenset(tokens), len(tokens)
        self.children: list[Node] = []
        self.leaves: list[int] = []  # sets that end here
        self.low, self.high, self.rest, self.last = 1 << 60, 0, 0, -1  # sizes below, longest rest, last set below
        self.one, self.member = False, -1  # whether all sets below are one component; one of them


def _shared(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1  # first difference, by halving
    while low < high:
        mid = (low + high) // 2
        if a[low : mid + 1] == b[low : mid + 1]:
            low = mid + 1
        else:
            high = mid
    return low


def build_tree(paths: list[tuple[int, ...]]) -> Node:
    """Prefix tree of sorted paths with runs of single children joined into one node."""
    root = Node(())
    stack: list[tuple[Node, int, tuple[int, ...]]] = [(root, 0, ())]  # node, depth at its end, its own path

    def close(node: Node) -> None:
        for child in node.children:
            node.low, node.high = min(node.low, child.low), max(node.high, child.high)
            node.rest = max(node.rest, child.length + child.rest)
            node.last = max(node.last, child.last)
            node.member = child.member if node.member < 0 else node.member

    previous: tuple[int, ...] = ()
    for i, path in enumerate(paths):
        common = _shared(previous, path) if i else 0
        while stack[-1][1] > common:
            node, end, own = stack.pop()
            start = end - node.length
            if start < common:  # split the node where the new path leaves it
                upper = Node(own[: common - start])
                lower_tokens = own[common - start :]
                node.tokens, node.length = frozenset(lower_tokens), len(lower_tokens)
                close(node)
                upper.children.append(node)
                stack[-1][0].children[-1] = upper
                stack.append((upper, common, own[: common - start]))
            else:
                close(node)
        if len(path) > common:
            tail = path[common:]
            node = Node(tail)
            stack[-1][0].children.append(node)
            stack.append((node, len(path), tail))
        top = stack[-1][0]
        top.leaves.append(i)
        top.low, top.high = min(top.low, len(path)), max(top.high, len(path))
        top.last, top.member = max(top.last, i), i if top.member < 0 else top.member
        previous = path
    while stack:
        close(stack.pop()[0])
    return root


class Components:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def tree_join(sets: Sequence[Sequence[int]], percent: int) -> list[int]:
    """For each set the number of the first set of its component, by links of ``percent`` or more."""
    often = Counter(t for s in sets for t in s)
    places = {t: k for k, t in enumerate(sorted(often, key=lambda t: (-often[t], t)))}
    ordered = sorted((tuple(sorted(places[t] for t in s)), i) for i, s in enumerate(sets))
    paths = [p for p, _ in ordered]
    found = Components(len(paths))
    root = build_tree(paths)

    def settled(node: Node, own: int) -> bool:
        """All sets below the node are known to be in the component ``own``; known from the leaves up."""
        if not node.one:
            mine = found.find(node.member)
            if any(found.find(x) != mine for x in node.leaves):
                return False
            if any(not c.one or found.find(c.member) != mine for c in node.children):
                return False
            node.one = True
        return found.find(node.member) == own

    for i, path in enumerate(paths):
        mine, size = frozenset(path), len(path)
        stack = [(root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.last <= i or 100 * node.high < percent * size or percent * node.low > 100 * size:
                continue
            overlap += len(mine & node.tokens)
            most = min(overlap + node.rest, size)
            if (100 + percent) * most < percent * (size + max(node.low, needed(size, percent))):
                continue
            if settled(node, found.find(i)):
                continue
            for j in node.leaves:
                if j > i and linked(overlap, size, len(paths[j]), percent):
                    found.join(i, j)
            stack.extend((c, overlap) for c in node.children)
    out = [0] * len(sets)
    first: dict[int, int] = {}
    for k, (_, i) in enumerate(ordered):
        r = found.find(k)
        first[r] = min(first.get(r, i), i)
    for k, (_, i) in enumerate(ordered):
        out[i] = first[found.find(k)]
    return out


# --- the Spark job -------------------------------------------------------------------------------


def _profile(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """One row per document (id, text key, set size, class), and the n-gram counts by slot."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(1 << SLOT_BITS, np.int32)
        for batch in rows_of(batches):
            sets = [shingle_set(t, n, hashes) for t in strings(batch.column(2))]
            if sum(map(len, sets)):
                np.add.at(counts, slot(np.concatenate(sets)), np.int32(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.nulls(len(sets), pa.int32()),
                    pa.nulls(len(sets), pa.binary()),
                ],
                names=names,
            )
        parts = [(k, counts[k * SLICE : (k + 1) * SLICE]) for k in range(len(counts) // SLICE)]
        parts = [(k, c.astype("<i8").tobytes()) for k, c in parts if c.any()]
        m = len(parts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()),
                pa.array([k for k, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary()),
            ],
            names=names,
        )

    names = ["id", "text_key", "n", "class", "slice", "counts"]
    schema = "id long, text_key string, n long, class binary, slice int, counts binary"
    made = materialize(docs.mapInArrow(run, schema), "shingle-profile")

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(c, "<i8")
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())],
            names=["slice", "counts"],
        )

    slices = made.where("slice IS NOT NULL").select("slice", "counts").repartition("slice")
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for row in slices.mapInArrow(add, "slice int, counts binary").collect():  # at most 2^20 numbers in all
        total[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] += np.frombuffer(row["counts"], "<i8")
    return made.where("slice IS NULL").select("id", "text_key", "n", "class"), total


def _prefixes(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(token, mark of the class): the n-grams by which sets can find each other."""
    held = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**32 - 1).astype(np.uint32))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, order = WordHashes(), set(), held.value
        for batch in rows_of(batches):
            tokens, marks = [], []
            for text in strings(batch.column(0)):
                s = shingle_set(text, n, hashes)
                if not len(s):
                    continue
                mark = int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "big", signed=True)
                if mark in seen:  # a copy of what this task has emitted
                    continue
                if len(seen) < WordHashes.LIMIT:
                    seen.add(mark)
                k = len(s) - needed(len(s), percent) + 1
                weight = order[slot(s)]
                if k < len(s):
                    edge = np.partition(weight, k - 1)[k - 1]
                    s, weight = s[weight <= edge], weight[weight <= edge]
                s = s[np.lexsort((s, weight))[:k]]
                tokens.append(s.view(np.int64))
                marks.append(np.full(len(s), mark, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), pa.array(np.concatenate(marks))], names=["token", "mark"]
                )

    return docs.select("text").mapInArrow(run, "token long, mark long")


def _members(rows: DataFrame, reps: DataFrame, block_size: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(hub, mark, n, common, chunks): members of blocks, with set size, how many prefix tokens a member
    shares with anyone, and how many parts the block gets; and (mark, n, tokens), those tokens."""
    hubs = rows.groupBy("token").agg(F.min("mark").alias("hub"), F.max("mark").alias("most")).where("hub < most")
    shared = scratch.write(rows.join(hubs.select("token", "hub"), "token").select("hub", "mark", "token"), "jaccard-shared")
    held = shared.groupBy("mark").agg(F.collect_set("token").alias("tokens"))  # bounded by a set's prefix
    held = scratch.write(held.join(reps.select("mark", "n"), "mark").select("mark", "n", "tokens"), "jaccard-held")
    pairs = scratch.write(shared.select("hub", "mark").distinct(), "jaccard-pairs")
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_size)).cast("int").alias("chunks"))
    common = held.select("mark", "n", F.size("tokens").alias("common"))
    return scratch.write(pairs.join(common, "mark").join(sizes, "hub"), "jaccard-members"), held


def by_block(frame: DataFrame, work: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``work`` on the rows of each block (first column), read as a stream of bounded blocks."""
    parts = [part.split() for part in schema.split(", ")]
    names = [name for name, _ in parts]
    kinds = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in parts])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for batch in rows_of(batches, 64):
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != now:
                    out += work(rows) if len(rows) > 1 else []
                    now, rows = row[0], []
                rows.append(row)
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=kinds)
                out = []
        out += work(rows) if len(rows) > 1 else []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=kinds)

    return frame.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def _promising(placed: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """(block, mark) of ``placed`` (block, mark, n, common) that can link within their block.

    Sets of sizes a <= b that link share at least ``needed overlap - needed(b) + 1`` tokens of their
    prefixes, as the first tokens of what they share stand in both.  Sizes and numbers of shared
    tokens are tested first, then the tokens that two members share with each other are counted.
    """
    p = percent

    def fit(x: Column, y: Column) -> Column:
        big, small = F.greatest(x["n"], y["n"]), F.least(x["n"], y["n"])
        overlap = F.floor((p * (big + small) + 99 + p) / F.lit(100 + p))
        least = overlap - F.floor((p * big + 99) / F.lit(100)) + 1
        return (x["mark"] != y["mark"]) & (100 * small >= p * big) & (least <= F.least(x["common"], y["common"]))

    blocks = placed.groupBy("block").agg(F.collect_list(F.struct("mark", "n", "common")).alias("all"))  # bounded by the block size
    able = F.filter("all", lambda x: F.exists("all", lambda y: fit(x, y)))
    blocks = blocks.select("block", F.explode(able).alias("one")).select("block", F.col("one.mark").alias("mark"))

    def count(rows: list[tuple]) -> list[tuple]:
        block = rows[0][0]
        rows = sorted(((n, mark, frozenset(tokens)) for _, mark, n, tokens in rows), key=lambda r: r[:2])
        kept = [False] * len(rows)
        for i, (a, mark, mine) in enumerate(rows):
            for j in range(i + 1, len(rows)):
                b, other, theirs = rows[j]
                if 100 * a < p * b:
                    break
                if kept[i] and kept[j] or mark == other:
                    continue
                least = -(-p * (a + b) // (100 + p)) - needed(b, p) + 1
                if least <= min(len(mine), len(theirs)) and len(mine & theirs) >= least:
                    kept[i] = kept[j] = True
        return [(block, r[1]) for r, k in zip(rows, kept) if k]

    return by_block(blocks.join(held, "mark").select("block", "mark", "n", "tokens"), count, "block string, mark long")


def _walk(placed: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between nodes of classes, a star per component and block.

    ``placed`` is (block string, mark).  A representative's text goes to all its blocks as a set.
    """
    wanted = placed.join(reps.select("mark", "rep", "text_key"), "mark").select("block", "mark", "rep", "text_key")
    wanted = scratch.write(wanted, "jaccard-placed")
    # a row without an id is told by its text
    ids = wanted.select(F.coalesce("rep", F.xxhash64("text_key")).alias("told")).distinct()
    # other texts need not travel: by a broadcast where the ids are few, else by a shuffle
    docs = docs.withColumn("told", F.coalesce("id", F.xxhash64("text_key")))
    docs = docs.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "told", "left_semi")
    texts = docs.join(wanted, docs["id"].eqNullSafe(wanted["rep"]) & (docs["text_key"] == wanted["text_key"]))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, before, arr, done = WordHashes(), None, None, set()
        for batch in rows_of(batches, 128):
            blocks, ids, marks, out = [], [], [], []
            for block, rep, mark, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strings(batch.column(3))):
                if (rep, text) != before:  # one text's blocks follow each other
                    before, arr, done = (rep, text), shingle_set(text, n, hashes).view(np.int64), set()
                if block not in done:  # a repeated row goes once
                    done.add(block)
                    blocks.append(block)
                    ids.append(rep)
                    marks.append(mark)
                    out.append(arr)
            if out:
                ends = np.concatenate([[0], np.cumsum([len(a) for a in out])]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks, pa.string()), pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), tokens],
                    names=["block", "rep", "mark", "tokens"],
                )

    def join(rows: list[tuple]) -> list[tuple]:
        members = list({mark: (rep, mark, tokens) for _, rep, mark, tokens in sorted(rows, key=lambda r: r[2])}.values())  # repeats count once
        roots = tree_join([t for _, _, t in members], percent)
        return [(*members[i][:2], *members[r][:2]) for i, r in enumerate(roots) if r != i]

    made = texts.select("block", "rep", "mark", "text").mapInArrow(sets, "block string, rep long, mark long, tokens array<long>")
    found = by_block(made, join, "rep_a long, a long, rep_b long, b long")
    return found.select(_node("rep_a", "a").alias("a"), _node("rep_b", "b").alias("b"))


def _node(rep: str, mark: str) -> Column:
    """Node of a class: those with an id first, by their smallest, so that a component's least node has its smallest id."""
    return F.struct(F.col(rep).isNull().alias("none"), F.coalesce(rep, F.lit(0).cast("long")).alias("id"), F.col(mark).alias("mark"))


def _same_id(profile: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) of classes that hold texts of one id: each with a node of the id."""
    mine = profile.where("n > 0 AND id IS NOT NULL").select("id", _mark().alias("mark"))
    several = mine.groupBy("id").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low < high").select("id")
    held = mine.join(several, "id").distinct().join(reps.select("mark", "rep"), "mark").withColumn("zero", F.lit(0).cast("long"))
    return held.select(_node("rep", "mark").alias("a"), _node("id", "zero").alias("b"))


def _mark() -> Column:
    return F.conv(F.substring(F.hex("class"), 1, 16), 16, -10).cast("long")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for links (a, b) of any ordered type: the least node that links reach, by alternating stars.

    Nodes without links are absent.  Rounds grow with the logarithm of the longest chain.  They take turns
    in two folders, each written over the round before the last, so what is stored doesn't grow with them.
    """
    scratch = scratch or Scratch()
    folders = [scratch.folder(edges.sparkSession, "stars") for _ in range(2)]
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.write(edges, "stars", folders[0])
    mark = None
    while True:
        folders.reverse()
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = scratch.write(small.where("u <> v").distinct(), "stars", folders[0])
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())


def jaccard_components(
    docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block_size: int = 256
) -> DataFrame:
    """(id, text_key, n_shingles, component_id) per row of ``docs``, other columns ignored.

    Words are runs without ASCII white space, A-Z in lower case.  Two rows link when
    ``100 * intersection >= percent * union`` of their shingle sets.  ``component_id`` is the
    smallest id that links reach.  Missing and empty texts have an empty set, link with
    nothing and are their own component.  Repeated rows link as equal sets; rows with one id and
    different texts count as one document with the links of both.  Rows without an id link as all
    others; a component that no row with an id is in has no id (NULL).
    """
    return _grouped(docs, n, percent, id_col, text_col, block_size).select("id", "text_key", "n_shingles", "component_id")


def _grouped(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, block_size: int = 256) -> DataFrame:
    """The rows of :func:`jaccard_components`, with the least node of the component as ``group``; NULL for empty sets."""
    scratch = Scratch()
    docs = docs.select(
        F.col(id_col).cast("long").alias("id"), F.md5(text_of(text_col)).alias("text_key"), text_of(text_col).alias("text")
    )
    profile, counts = _profile(docs.select("id", "text_key", "text"), n)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("first")
    reps = profile.where("n > 0").groupBy("class").agg(first, F.first("n").alias("n"))
    reps = materialize(reps.select("class", _mark().alias("mark"), F.col("first.id").alias("rep"), F.col("first.text_key").alias("text_key"), "n"), "classes")

    rows = scratch.write(_prefixes(docs, n, percent, counts), "prefixes")
    members, held = _members(rows, reps, block_size, scratch)
    own = F.pmod(F.xxhash64("mark"), F.col("chunks")).cast("int")
    spread = F.when(F.col("hub") == F.col("mark"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))
    placed = members.withColumn("chunk", F.explode(spread))
    placed = _promising(placed.select(F.concat_ws(":", "hub", "chunk").alias("block"), "mark", "n", "common"), held, percent)
    links = scratch.write(_walk(placed, reps, docs, n, percent, scratch).union(_same_id(profile, reps)), "links")
    found = materialize(components(links, scratch), "components")

    split = members.where("chunks > 1").join(reps.select("mark", _node("rep", "mark").alias("node")), "mark")
    split = split.join(found, "node", "left")
    split = split.select("hub", "mark", "n", "common", "chunks", F.coalesce("component", "node").alias("component"))
    parts = split.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("hub").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = main.where("most < all").select("hub", "main", F.ceil((F.col("all") - F.col("most")) / F.lit(block_size)).cast("int").alias("strays"))
    open_ = scratch.write(split.join(main, "hub"), "strays")
    if not open_.isEmpty():
        stray = F.pmod(F.xxhash64("mark"), F.col("strays")).cast("int")
        named = ["hub", "mark", "n", "common"]
        lone = open_.where("component <> main")
        lone = lone.select(*named, stray.alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"))
        rest = open_.select(*named, F.explode(F.sequence(F.lit(0), F.col("strays") - 1)).alias("i"), own.alias("j"))
        placed = lone.union(rest).select(F.concat_ws(":", "hub", "i", "j").alias("block"), "mark", "n", "common").distinct()
        more = _walk(_promising(placed, held, percent), reps, docs, n, percent, scratch)
        found = materialize(components(links.union(more), scratch), "components")
    scratch.clear(docs.sparkSession)  # what follows reads the profile, the classes and their components alone

    by_class = reps.select("class", _node("rep", "mark").alias("node")).join(found, "node", "left")
    by_class = by_class.select("class", F.coalesce("component", "node").alias("group"))
    least = F.when(F.col("group").isNull(), F.col("id")).when(~F.col("group.none"), F.col("group.id"))
    return profile.join(by_class, "class", "left").select(
        F.col("id"), "text_key", F.col("n").alias("n_shingles"), least.alias("component_id"), "group"
    )


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near copies: the one with the smallest id.

    Documents without words stay.  Of repeated rows (same id and text) one stays; of rows
    with one id and different texts in one group, the one whose text has the smallest digest; so
    too of a group that has no id.
    """
    key = F.md5(text_of(text_col))
    found = _grouped(docs, n, percent, id_col, text_col)
    first = found.where("n_shingles > 0").groupBy("group")
    first = first.agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("f"))
    stay = first.select(F.col("f.id").alias("__ff_id"), F.col("f.text_key").alias("__ff_key"))
    empty = found.where("n_shingles = 0").select(F.col("id").alias("__ff_id"), F.col("text_key").alias("__ff_key"))
    stay = stay.union(empty).distinct()
    kept = docs.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col("__ff_id")) & (key == F.col("__ff_key")), "left_semi")
    return kept.dropDuplicates([id_col, text_col])
