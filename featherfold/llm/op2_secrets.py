"""Secret scan in Spark functions only: fixed patterns, then entropy over sliding windows.

Every step works on one row and shuffles nothing.  Spans come from splitting the text by a
pattern: the pieces between the matches and the matches themselves give all offsets in code
points.  For entropy, each maximal run of a class's characters is walked once with ``aggregate``;
the state holds the counts of the characters in the window, a few bits each in whole numbers, and each step adds
the character that enters, takes off the one that leaves, and corrects the entropy sum by these two counts alone.
Sums are whole numbers (millionths of a bit), so results never depend on the order of additions.
Arrays grow in parts of bounded size that are then put together, so work is not quadratic in a text's length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of

# Fixed values of the scan's contract: kinds in their order, patterns, least lengths.
BASE = {
    "assign": (
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        12,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: Words of harmless values, in any case: no entropy window that touches one is told.
WORDS = ("example", "sample", "placeholder", "changeme", "redacted", "xxxx", "0123456789", "abcdefghij")
#: Values that are harmless as a whole: a run of this form has no entropy spans.
WHOLE = (
    r"^(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12})$",  # UUID
    r"^[0-9]+$",
    r"^(.)\1*$",
)
ALLOWED = ("(?i)" + "|".join(WORDS), *WHOLE)
#: One character of any word, seen from its place in it, so that words that overlap are covered whole.
COVERED = "(?i)" + "|".join(
    (f"(?<={w[:k]})" if k else "") + w[k] + (f"(?={w[k + 1:]})" if k + 1 < len(w) else "") for w in WORDS for k in range(len(w))
)


@dataclass(frozen=True)
class CharClass:
    """Characters, window length and the entropy in bits from which a window is suspect."""

    name: str
    chars: str
    pattern: str  # of the set, inside brackets
    window: int
    bits: float


CLASSES = (
    CharClass("entropy_hex", "0123456789abcdefABCDEF", "0-9a-fA-F", 20, 3.0),
    CharClass(
        "entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "A-Za-z0-9+/_-", 24, 4.0
    ),
)
SCALE = 1_000_000


def running(values: Column) -> Column:
    """Sums of the values before each value, in about as many parts as a part has values."""
    ints = "CAST(array() AS array<int>)"

    def grow(state: Column, x: Column) -> Column:
        return F.struct((state["at"] + x).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    def part(own: Column) -> Column:
        return F.aggregate(own, F.struct(F.lit(0).alias("at"), F.expr(ints).alias("out")), grow)

    def chain(state: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda v: v + state["at"])
        return F.struct((state["at"] + x["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    def of(width: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / width).cast("int"))
        parts = F.transform(places, lambda c: part(F.slice(values, c * width + 1, width)))
        zero = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<array<int>>)").alias("out"))
        return F.flatten(F.aggregate(parts, zero, chain, lambda s: s["out"]))

    return F.when(F.size(values) > 0, let(F.ceil(F.sqrt(F.size(values))).cast("int"), of)).otherwise(F.expr(ints))


def _offsets(text: Column, pattern: str, group: int) -> Column:
    """Array of (start, end, size of the group, match) of the leftmost matches that don't overlap."""
    rule = F.lit(pattern)
    hits = F.regexp_extract_all(text, rule, F.lit(0))
    sized = hits if not group else F.regexp_extract_all(text, rule, F.lit(group))
    sized = F.zip_with(hits, sized, lambda h, g: F.struct(h.alias("hit"), F.length(g).alias("size")))
    gaps = F.zip_with(
        F.split(text, pattern, -1),
        sized,
        lambda p, h: F.struct(F.length(p).alias("gap"), h["hit"].alias("hit"), h["size"].alias("size")),
    )

    def placed(found: Column) -> Column:
        before = running(F.transform(found, lambda x: x["gap"] + F.length(x["hit"])))
        return F.zip_with(
            found,
            before,
            lambda x, at: F.struct(
                (at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["hit"])).alias("end"), x["size"].alias("size"), x["hit"].alias("hit")
            ),
        )

    empty = F.expr("CAST(array() AS array<struct<start:int,end:int,size:int,hit:string>>)")
    return F.when(text.rlike(pattern), let(F.filter(gaps, lambda x: x["hit"].isNotNull()), placed)).otherwise(empty)


def _base(text: Column, kind: str) -> Column:
    """Array of (start, order of the kind, end) of one fixed pattern's matches."""
    pattern, group, least = BASE[kind]
    if kind == "hex":  # runs are maximal, so those that are too short can be left out by the pattern
        pattern = pattern[:-1] + "{%d,}" % least
    kept = F.filter(_offsets(text, pattern, group), lambda x: x["size"] >= least)
    return _spans(kept, list(BASE).index(kind), F.lit(0))


def _spans(found: Column, order: int, shift: Column) -> Column:
    return F.transform(
        found,
        lambda x: F.struct((shift + x["start"]).alias("start"), F.lit(order).alias("order"), (shift + x["end"]).alias("end")),
    )


LANE = 12  # counts in one long, of five bits each
PART = 1024  # windows that one walk sees


def _walk(run: Column, cls: CharClass) -> Column:
    """Array of (start, end): the suspect windows of a short run, those that touch merged."""
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(cls.chars), c) - 1)
    late = F.concat(F.array_repeat(F.lit(-1), cls.window), codes)
    lane = lambda c: F.floor(c / F.lit(LANE)).cast("int")
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), 5 * (c % LANE))
    moves = F.zip_with(
        F.slice(late, 1, F.size(codes)),
        codes,
        lambda off, into: F.struct(
            into.alias("into"), lane(into).alias("to_lane"), one(into).alias("add"),
            off.alias("off"), F.when(off >= 0, lane(off)).otherwise(-1).alias("off_lane"), F.when(off >= 0, one(off)).otherwise(0).alias("take"),
        ),
    )
    # entropy = log2(window) - sum(k log2 k) / window, k the counts: suspect while the sum is at most ``most``
    term = F.lit([0] + [round(k * math.log2(k) * SCALE) for k in range(1, cls.window + 1)])
    most = round((math.log2(cls.window) - cls.bits) * cls.window * SCALE)
    lanes = [f"l{k}" for k in range(-(-len(cls.chars) // LANE))]

    def count(s: Column, which: Column, code: Column) -> Column:
        held = F.element_at(F.array(*[s[name] for name in lanes]), which + 1)
        return F.call_function("shiftright", held, 5 * (code % LANE)).bitwiseAND(F.lit(31).cast("long")).cast("int")

    def at(k: Column) -> Column:
        return F.element_at(term, k + 1)

    def step(s: Column, x: Column) -> Column:
        less = F.when(x["off"] >= 0, let(count(s, F.greatest(x["off_lane"], F.lit(0)), F.greatest(x["off"], F.lit(0))), lambda k: at(k - 1) - at(k))).otherwise(0)
        more = let(count(s, x["to_lane"], x["into"]), lambda k: at(k + 1) - at(k))
        change = F.when(x["into"] == x["off"], 0).otherwise(less + more)
        moved = [
            (s[name] + F.when(x["to_lane"] == k, x["add"]).otherwise(0) - F.when(x["off_lane"] == k, x["take"]).otherwise(0)).alias(name)
            for k, name in enumerate(lanes)
        ]

        def after(total: Column) -> Column:
            end = s["at"] + 1
            suspect = (end >= cls.window) & (total <= most)
            new = suspect & (s["to"] < end - cls.window)
            return F.struct(
                *moved,
                total.alias("sum"),
                end.alias("at"),
                F.when(new, end - cls.window).otherwise(s["from"]).alias("from"),
                F.when(suspect, end).otherwise(s["to"]).alias("to"),
                F.when(new & (s["to"] >= 0), F.concat(s["out"], span(s))).otherwise(s["out"]).alias("out"),
            )

        return let((s["sum"] + change).cast("long"), after)

    def span(s: Column) -> Column:
        return F.array(F.struct(s["from"].alias("start"), s["to"].alias("end")))

    zero = F.struct(
        *[F.lit(0).cast("long").alias(name) for name in lanes],
        F.lit(0).cast("long").alias("sum"),
        F.lit(0).alias("at"),
        F.lit(-1).alias("from"),
        F.lit(-1).alias("to"),  # no window ends there
        F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("out"),
    )
    return F.aggregate(moves, zero, step, lambda s: F.when(s["to"] < 0, s["out"]).otherwise(F.concat(s["out"], span(s))))


def suspect_windows(run: Column, cls: CharClass) -> Column:
    """Merged (start, end) of the windows of a run whose entropy reaches the class's bound.

    A long run is walked in parts that share no window; spans that touch where parts meet are merged.
    """
    parts = F.sequence(F.lit(0), F.floor((F.length(run) - cls.window) / F.lit(PART)).cast("int"))
    found = F.flatten(
        F.transform(
            parts,
            lambda c: F.transform(
                _walk(F.substring(run, c * PART + 1, F.lit(PART + cls.window - 1)), cls),
                lambda x: F.struct((x["start"] + c * PART).alias("start"), (x["end"] + c * PART).alias("end")),
            ),
        )
    )

    def merged(spans: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), F.transform(spans, lambda x: x["end"]))
        after = F.concat(F.slice(F.transform(spans, lambda x: x["start"]), 2, F.size(spans)), F.array(F.lit(1 << 30)))
        starts = F.filter(F.zip_with(spans, F.slice(before, 1, F.size(spans)), lambda x, b: F.when(b < x["start"], x["start"])), lambda v: v.isNotNull())
        ends = F.filter(F.zip_with(spans, after, lambda x, a: F.when(a > x["end"], x["end"])), lambda v: v.isNotNull())
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))

    return let(found, lambda spans: F.when(F.size(spans) > 1, merged(spans)).otherwise(spans))


def _apart(run: Column, rule: str) -> Column:
    """Array of (start, end, size, hit) of the parts of a run between the words, long enough for a window."""
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(run).alias("end"), F.length(run).alias("size"), run.alias("hit")))
    return F.when(run.rlike(ALLOWED[0]), _offsets(F.regexp_replace(run, COVERED, " "), rule, 0)).otherwise(whole)


def _entropy(text: Column, cls: CharClass, order: int) -> Column:
    """Array of (start, order, end) of a class's suspect windows outside the allow-list.

    A run that is harmless as a whole goes; of other runs the windows that touch a word go, and only those.
    """
    rule = "[%s]{%d,}" % (cls.pattern, cls.window)
    runs = F.filter(_offsets(text, rule, 0), lambda x: ~reduce(or_, [x["hit"].rlike(r) for r in WHOLE]))

    def spans(r: Column) -> Column:
        parts = _apart(r["hit"], rule)
        return F.flatten(F.transform(parts, lambda p: _spans(suspect_windows(p["hit"], cls), order, r["start"] + p["start"])))

    return F.flatten(F.transform(runs, spans))


KINDS = [*BASE, *[c.name for c in CLASSES]]


def _told(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda x: F.concat_ws(":", F.element_at(F.lit(KINDS), x["order"] + 1), x["start"], x["end"]),
        ),
        ",",
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, counts of the fixed patterns, and all spans.

    Columns: id, n_assign, n_access, n_hex, base_spans (kind:start:end, comma-joined, by start and
    kind), spans (the same with the entropy spans).  Offsets are code points, ends exclusive.
    Missing and empty texts have no spans; repeated rows and rows without an id come out as they
    went in; other columns are ignored.
    """
    text = F.col("text")
    found = docs.select(F.col(id_col), text_of(text_col).alias("text")).select(
        id_col,
        *[_base(text, kind).alias(kind) for kind in BASE],
        *[_entropy(text, cls, len(BASE) + i).alias(cls.name) for i, cls in enumerate(CLASSES)],
    )
    return found.select(
        id_col,
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE],
        _told(F.concat(*BASE)).alias("base_spans"),
        _told(F.concat(*KINDS)).alias("spans"),
    )
