"""Chat formatting with a grammar round trip.

A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``.  A deterministic parser reads the
rendering back; while the turns that it finds differ from the source, the parts that conflict are
escaped one step more.  Escaping adds a backslash within each ``<|`` (and ``<\\|``, ``<\\\\|`` and so
on), so it can be undone, and texts without such marks stay as they are.

A rendered turn begins and ends with its own marks, so turns are rendered, parsed and checked row by
row without a shuffle.  Conversations are then read in order, turn by turn: a task never holds more
than one turn, however long its conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, strings

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
MARK, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return MARK.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns of a rendering: role, text, start and end of the rendered text.  ValueError if it is none."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.find("\n", at)
        if line < 0 or "<|" in formatted[at + len(START) : line]:
            raise ValueError(f"no role after {at}")
        mark = formatted.find("<|", line + 1)
        if mark < 0 or not formatted.startswith(END + "\n", mark):
            raise ValueError(f"no turn ends at {mark}")
        role, text = formatted[at + len(START) : line], formatted[line + 1 : mark]
        turns.append((unescape_role(role), unescape(text), line + 1, mark))
        at = mark + len(END) + 1
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendering of a turn that parses back to it, with the start and end of its text."""
    forms = [(role, text), (role, escape(text)), (escape_role(role), text), (escape_role(role), escape(text))]
    for r, t in forms:
        formatted = f"{START}{r}\n{t}{END}\n"
        try:
            back = parse(formatted)
        except ValueError:
            continue
        if len(back) == 1 and back[0][:2] == (role, text):
            return formatted, back[0][2], back[0][3]
    raise ValueError("a turn has no rendering that parses back to it")


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, formatted, loss_start, loss_end) per row of ``conversations``.

    The loss mask covers the texts of assistants; its bounds are code points within ``formatted``,
    NULL for other roles.  Missing texts and roles count as empty.  Repeated rows are turns of their
    own; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            roles, texts = strings(batch.column(2)), strings(batch.column(3))
            made = [render(r, t) for r, t in zip(roles, texts)]
            masks = [(m[1], m[2]) if r == "assistant" else (None, None) for m, r in zip(made, roles)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(roles, pa.string()),
                    pa.array([m[0] for m in made], pa.string()),
                    pa.array([m[0] for m in masks], pa.int64()), pa.array([m[1] for m in masks], pa.int64()),
                ],
                names=["conv_id", "turn", "role", "formatted", "loss_start", "loss_end"],
            )

    base = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return base.mapInArrow(run, "conv_id long, turn long, role string, formatted string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from its rendered turns in order, parsed again.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed per turn), loss_chars and
    loss_sha256 (of the unescaped text under the mask), formatted_chars.  Turns without a number come
    first; turns with one number go by rendering.  Rows without a conversation are one conversation.
    A conversation's rows meet in one task, as its digest is one sequence, but are read as a stream.
    """

    class Read:
        def __init__(self, conv: int | None):
            self.conv, self.turns, self.loss, self.chars = conv, 0, 0, 0
            self.all, self.masked = hashlib.sha256(), hashlib.sha256()

        def add(self, piece: str, start: int | None, end: int | None) -> None:
            for role, text, _, _ in parse(piece):
                self.turns += 1
                self.all.update(f"{role}\n{text}\n".encode())
            if start is not None:
                text = unescape(piece[start:end])
                self.loss += len(text)
                self.masked.update(text.encode())
            self.chars += len(piece)

        def row(self) -> tuple:
            return self.conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in rows_of(batches):
            for conv, piece, start, end in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = Read(conv)
                now.add(piece, start, end)
            if len(done) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done), kinds)], names=names)
                done = []
        if now is not None:
            done.append(now.row())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done), kinds)], names=names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def assemble(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) as training examples: a text per conversation with its masked spans.

    The text of a conversation is one value and so must fit into a task.
    """
    grouped = formatted.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "formatted", "loss_start", "loss_end"))).alias("turns")
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)").alias("out"))
    spans = F.aggregate(
        "turns",
        zero,
        lambda s, t: F.struct(
            (s["at"] + F.length(t["formatted"])).alias("at"),
            F.when(t["loss_start"].isNull(), s["out"])
            .otherwise(
                F.concat(s["out"], F.array(F.struct((s["at"] + t["loss_start"]).alias("start"), (s["at"] + t["loss_end"]).alias("end"))))
            )
            .alias("out"),
        ),
        lambda s: s["out"],
    )
    return grouped.select("conv_id", F.array_join(F.transform("turns", lambda t: t["formatted"]), "").alias("formatted"), spans.alias("loss_mask"))
