"""Conversation structure repair by the auction algorithm for shortest paths.

A conversation's cheapest repair is a shortest path over a lattice: nodes are (rows behind, state of the
grammar), arcs are edits with whole costs.  Nodes have prices that never exceed an arc's cost plus
the price at its end.  From an origin a path is extended along its cheapest arc while that arc is tight; where
none is, the last node's price rises and the path is contracted by it.  Origins are taken from the end of
the lattice, so that a path stops at the first node that an earlier one has proven.  Prices are then true
distances, an arc is on a cheapest repair just where it is tight, and the least edits are
traced from the start, letter by letter.

How it runs, at any size: rows are put into order by ranges of (conversation, turn) and numbered, so that a
long conversation lies in many tasks.  Narrow rows (a letter each) are repaired in blocks of consecutive rows.
Only the first and last conversation of a block can go on elsewhere: such a piece gives the costs between all
states at its ends, an auction over the conversation's pieces prices these ends, and each piece
is traced from every state.  Texts travel twice, to be ordered and to be read as a stream with their edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of

# Fixed values of the contract: costs of edits, what a truncated row adds, states of ``(s?(ua)+)?``.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (EMPTY, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 50
BLOCK_BITS = 10  # 1024 rows of one task's part
REMEMBERED = 50_000

WORDY = "[^\\x20\\x09-\\x0D]"
SPACES = "[\\x20\\x09-\\x0D]"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that the digest of each row asks for."""
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.withColumn("fault", F.crc32(F.encode(name, "UTF-8")) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


# --- the lattice ---------------------------------------------------------------------------------------

Arc = tuple[str, int, int]  # letter of the edit, cost, node at its end


def auction(origins: Iterable[int], arcs: Callable[[int], list[Arc]], price: list[int], proven: bytearray) -> None:
    """Raise ``price``, which no arc may undercut, to the distance to a proven node, for every origin."""
    for origin in origins:
        path = [origin]
        while not proven[path[-1]]:
            node = path[-1]
            best, end = min((cost + price[to], to) for _, cost, to in arcs(node))
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(end)
        for node in path:
            proven[node] = 1


def following(state: int) -> int:
    """The state after the one role that the grammar allows next, once a user has begun."""
    return ASSISTANT if state == USER else USER


class Lattice:
    """Edits of rows given as letters: s, u, a or x by role, upper case if truncated, ``-`` if to be deleted.

    ``exits`` are the costs that follow in each state.
    """

    def __init__(self, letters: str, exits: Sequence[int]):
        self.letters, self.n, self.exits = letters, len(letters), exits
        self.sink = 4 * (self.n + 1)
        least, ahead = min(exits), [0] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            c = letters[i]
            ahead[i] = ahead[i + 1] + (DELETE if c == "-" or c.isupper() else 0)
        self.price = [a + least for a in ahead for _ in range(4)] + [0]
        proven = bytearray(len(self.price))
        proven[self.sink] = 1
        if min(exits[USER], exits[ASSISTANT]) >= FAR:  # no way back from there, nor from a lone system role but as such
            lost = [USER, ASSISTANT] + ([SYSTEM] if exits[SYSTEM] >= FAR else [])
            for node in (4 * i + q for i in range(self.n + 1) for q in lost):
                self.price[node], proven[node] = FAR, 1
        auction(range(self.sink - 1, -1, -1), self.arcs, self.price, proven)

    def arcs(self, node: int) -> list[Arc]:
        i, state = divmod(node, 4)
        then = following(state)
        out = [("I", INSERT, 4 * i + then)]
        if i == self.n:
            if self.exits[state] < FAR:
                out.append(("", self.exits[state], self.sink))
            return out
        c, after = self.letters[i], 4 * (i + 1)
        out.append(("D", DELETE, after + state))
        if c != "-":
            more = TRUNCATED if c.isupper() else 0
            c = c.lower()
            if c == "s" and state == EMPTY:
                out.append(("K", more, after + SYSTEM))
            if c == ("a" if state == USER else "u"):
                out.append(("K", more, after + then))
            else:
                out.append(("R", REROLE + more, after + then))
        return out

    def trace(self, state: int) -> tuple[str, int]:
        """(least letters of a cheapest repair from ``state``, state at the end)."""
        node, edits = state, []
        while True:
            tight = [(letter, to) for letter, cost, to in self.arcs(node) if cost + self.price[to] == self.price[node]]
            letter, to = min(tight)
            if to == self.sink:
                return "".join(edits), node % 4
            edits.append(letter)
            node = to


LAST = [0 if q in ENDS else FAR for q in range(4)]


def repair(letters: str) -> tuple[int, str]:
    """(cost, edits) of the cheapest repair of whole conversation."""
    lattice = Lattice(letters, LAST)
    return lattice.price[EMPTY], lattice.trace(EMPTY)[0]


def transfer(letters: str) -> list[int]:
    """Costs from each state before the rows to each state after them, row by row."""
    columns = [Lattice(letters, [0 if q == e else FAR for q in range(4)]).price[:4] for e in range(4)]
    return [columns[e][q] for q in range(4) for e in range(4)]


def piece_prices(transfers: list[list[int]]) -> list[list[int]]:
    """The costs that follow each piece of a conversation, by state, from the transfers of its pieces."""
    n = len(transfers)
    sink = 4 * (n + 1)

    def arcs(node: int) -> list[Arc]:
        k, q = divmod(node, 4)
        if k == n:
            return [("", LAST[q], sink)]
        return [("", transfers[k][4 * q + e], 4 * (k + 1) + e) for e in range(4)]

    price, proven = [0] * (sink + 1), bytearray(sink + 1)
    proven[sink] = 1
    auction(range(sink - 1, -1, -1), arcs, price, proven)
    return [price[4 * k : 4 * k + 4] for k in range(1, n + 1)]


# --- the Spark job -------------------------------------------------------------------------------------


def _letters(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, letter, kind): kind is none, blank, duplicate or truncated."""
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    blank = ~F.col("text").rlike(WORDY)
    cut = ~F.substring(F.rtrim(F.regexp_replace("text", SPACES, " ")), -1, 1).isin(".", "!", "?")
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    marked = rows.select("conv_id", "pos", code.alias("code"), blank.alias("blank"), cut.alias("cut"), same.alias("same"))
    seen = marked.where("NOT blank").groupBy("conv_id", "same").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    seen = seen.where("n > 1").select(F.col("conv_id").alias("c"), F.col("same").alias("s"), "first")
    joined = marked.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    kind = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("cut"), "truncated").otherwise("none")
    letter = F.when(kind.isin("blank", "duplicate"), "-").when(kind == "truncated", F.upper("code")).otherwise(F.col("code"))
    return joined.select("conv_id", "pos", letter.alias("letter"), kind.alias("kind"))


def grouped(
    frame: DataFrame, key: str, order: Sequence[str], work: Callable[[list[tuple]], Iterable[tuple]], schema: str
) -> DataFrame:
    """``work`` on the ordered rows of each value of ``key``, the first column; values stay whole numbers or NULL."""
    kinds = {"long": pa.int64(), "string": pa.string(), "longs": pa.list_(pa.int64()), "strings": pa.list_(pa.string())}
    fields = [f.split() for f in schema.split(", ")]
    target = pa.schema([(name, kinds[kind]) for name, kind in fields])
    spark_schema = ", ".join(f"{name} " + {"longs": "array<long>", "strings": "array<string>"}.get(kind, kind) for name, kind in fields)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(target)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = object(), [], []
        for batch in rows_of(batches, 4096):
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != now:
                    out += work(rows) if rows else []
                    now, rows = row[0], []
                rows.append(row)
            if len(out) > 2048:
                yield made(out)
                out = []
        yield made([*out, *(work(rows) if rows else [])])

    return frame.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, spark_schema)


KINDS = ("blank", "duplicate", "truncated")


def _edits(letters: DataFrame) -> DataFrame:
    """(conv_id, cost, audit, blank, duplicate, truncated) per conversation with rows."""

    known: dict[str, tuple[int, str]] = {}

    def fixed(text: str) -> tuple[int, str]:
        if text not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[text] = repair(text)
        return known[text]

    def block(rows: list[tuple]) -> list[tuple]:
        pieces: list[list] = []
        for number, conv, _, letter, kind in rows:
            if not pieces or pieces[-1][0] != conv:
                pieces.append([conv, number, [], [0, 0, 0]])
            pieces[-1][2].append(letter)
            if kind != "none":
                pieces[-1][3][KINDS.index(kind)] += 1
        out = []
        for at, (conv, number, own, counts) in enumerate(pieces):
            text = "".join(own)
            if 0 < at < len(pieces) - 1:
                out.append((conv, number, *fixed(text), counts, None, None))
            else:
                out.append((conv, number, None, None, counts, text, transfer(text)))
        return out

    placed = letters.select(F.shiftright("pos", BLOCK_BITS).alias("block"), "conv_id", "pos", "letter", "kind")
    schema = "conv_id long, block long, cost long, audit string, counts longs, letters string, transfer longs"
    made = materialize(grouped(placed, "block", ["pos"], block, schema), "repair-blocks")
    edges = made.where("letters IS NOT NULL")

    def priced(rows: list[tuple]) -> list[tuple]:
        return [(conv, number, after) for (conv, number, _), after in zip(rows, piece_prices([t for *_, t in rows]))]

    prices = grouped(edges.select("conv_id", "block", "transfer"), "conv_id", ["block"], priced, "conv_id long, block long, exits longs")
    prices = prices.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "exits")
    at = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    exits = edges.join(prices, at).select("block", "conv_id", "letters", "exits", "counts")

    def traced(rows: list[tuple]) -> list[tuple]:
        out = []
        for number, conv, text, after, counts in rows:
            lattice = Lattice(text, after)
            audits, ends = zip(*[lattice.trace(q) for q in range(4)])
            out.append((conv, number, list(audits), list(ends), lattice.price[EMPTY], counts))
        return out

    pieces = grouped(exits, "block", [], traced, "conv_id long, block long, audits strings, ends longs, cost long, counts longs")

    def chained(rows: list[tuple]) -> list[tuple]:
        state, audit, sums = EMPTY, [], [0, 0, 0]
        for _, _, audits, ends, _, counts in rows:
            audit.append(audits[state])
            state = ends[state]
            sums = [a + b for a, b in zip(sums, counts)]
        return [(rows[0][0], rows[0][4], "".join(audit), sums)]

    whole = grouped(pieces, "conv_id", ["block"], chained, "conv_id long, cost long, audit string, counts longs")
    return made.where("letters IS NULL").select("conv_id", "cost", "audit", "counts").union(whole)


def _told(rows: DataFrame, edits: DataFrame, ids: DataFrame) -> DataFrame:
    """The result rows, from texts in order behind their conversation's edits, read as a stream."""
    null = F.lit(None)
    none = [null.cast(kind) for kind in ("string", "long", "string", "string", "array<long>")]
    marks = ids.select("conv_id", F.lit(-2).cast("long").alias("pos"), *[c.alias(n) for c, n in zip(none, ["text", "turn", "role", "audit", "counts"])], null.cast("long").alias("cost"))
    plans = edits.select("conv_id", F.lit(-1).cast("long").alias("pos"), *[c.alias(n) for c, n in zip(none, ["text", "turn", "role"])], "audit", "counts", "cost")
    texts = rows.select("conv_id", "pos", "text", "turn", "role", *[c.alias(n) for c, n in zip(none[3:], ["audit", "counts"])], null.cast("long").alias("cost"))

    class Reader:
        def __init__(self, conv: int | None):
            self.conv, self.audit, self.counts, self.cost, self.at = conv, "", [0, 0, 0], 0, 0
            self.state, self.digest, self.first = EMPTY, hashlib.sha256(), True
            self.before, self.illegal, self.low, self.high, self.turns = None, 0, None, None, 0

        def put(self, role: str, text: str) -> None:
            self.digest.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.first = False

        def inserted(self) -> None:
            while self.audit[self.at : self.at + 1] == "I":
                self.state, self.at = following(self.state), self.at + 1
                self.put(NAMES[self.state], "")

        def row(self, turn: int | None, role: str, text: str) -> None:
            if turn is not None:  # rows come by turn
                self.low = turn if self.low is None else self.low
                self.turns += self.high != turn
                self.high = turn
            if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = role[:1]
            self.inserted()
            edit, self.at = self.audit[self.at], self.at + 1
            if edit == "K" and role[:1] == "s":
                self.state = SYSTEM
                self.put(role, text)
            elif edit != "D":
                self.state = following(self.state)
                self.put(NAMES[self.state] if edit == "R" else role, text)

        def done(self) -> tuple:
            self.inserted()
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            return self.conv, gaps, *self.counts, self.illegal, self.cost, self.audit, self.digest.hexdigest()

    names = ["conv_id", "gaps", *KINDS, "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in rows_of(batches):
            for conv, pos, text, turn, role, audit, counts, cost in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or now.conv != conv:
                    out += [now.done()] if now else []
                    now = Reader(conv)
                if pos == -1:
                    now.audit, now.counts, now.cost = audit, counts, cost
                elif pos >= 0:
                    now.row(turn, role, text)
            if len(out) > 2048:
                yield made(out)
                out = []
        yield made(out + ([now.done()] if now else []))

    ordered = marks.union(plans).union(texts).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.mapInArrow(run, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds)))


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` are (conv_id, turn, role, text), other columns ignored; ``ids`` (conv_id) names conversations to tell
    even if they have no rows: zeros, no audit, the digest of nothing.  Rows without a conversation are one
    conversation.  Turns without a number come first, rows of one turn by role and text; repeated rows are
    rows of their own, and duplicates.  Missing roles and texts count as one space.  Empty texts are blank; an
    empty table gives no rows.  A conversation's texts meet in one task, as its digest is one sequence, but are read
    as a stream.
    """
    base = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    ordered = base.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    placed = materialize(ordered.withColumn("pos", F.monotonically_increasing_id()), "repair-rows")
    told = placed if ids is None else ids
    edits = materialize(_edits(_letters(placed)), "repair-edits")
    return _told(placed, edits, told.select(F.col("conv_id").cast("long")).distinct())
