"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much goes.

Rows are independent, so nothing is shuffled; a task holds one batch of documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, strings, text_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
WINDOW = 8
LONG_WORDS = 4096
MIX = np.uint64(0x9E3779B97F4A7C15)
NAVIGATION = re.compile(
    r"(?i)^\W*(?:home|menu|next|previous|prev|back|more|read more|skip to (?:main )?content|click here|sign in|log ?in|"
    r"sign up|register|search|site ?map|contact us|about us|share|tweet|print|top)\W*$"
)
BOILERPLATE = re.compile(
    r"(?i)\b(?:cookie policy|uses? cookies|accept (?:all )?cookies|privacy policy|terms of (?:use|service)|enable javascript|"
    r"javascript is (?:disabled|required)|subscribe to our|sign up for our|follow us on|lorem ipsum|page not found)\b"
)
ENDS = tuple(".!?…:;。！？")
CLOSERS = "\"'”’»)]}"


@dataclass(frozen=True)
class LineRules:
    """Bounds of the line rules and of the verdict.

    A line fails when it has under ``prose_words`` words and no sentence end, more than
    ``symbols_per_word`` of the marks #*$%&|<>, more than ``capitals`` of its letters in upper case
    from ``judged_words`` words on, fewer than ``distinct`` of its words different from
    ``repeat_words`` words on (but not with ``varied_words`` different ones, as long lines repeat common words), or
    when it has up to ``navigation_words`` words and is navigation, or up to ``boilerplate_words`` and holds
    boilerplate.  A document goes when over ``lost`` of its words stand in failing lines.
    """

    prose_words: int = 25
    symbols_per_word: float = 0.3
    capitals: float = 0.5
    judged_words: int = 4
    distinct: float = 0.35
    repeat_words: int = 12
    varied_words: int = 40
    navigation_words: int = 6
    boilerplate_words: int = 40
    lost: float = 0.5


def line_fails(line: str, words: list[bytes], rules: LineRules) -> bool:
    n = len(words)
    if n < rules.prose_words and not line.rstrip().rstrip(CLOSERS).endswith(ENDS):
        return True
    if sum(map(line.count, SYMBOLS)) > rules.symbols_per_word * n:
        return True
    if n >= rules.repeat_words and len(set(words)) < min(rules.distinct * n, rules.varied_words):
        return True
    if n >= rules.judged_words and not line.islower():
        upper = sum(map(str.isupper, line))
        if 2 * upper > n and upper > rules.capitals * sum(map(str.isalpha, line)):
            return True
    if n <= rules.navigation_words and NAVIGATION.match(line):
        return True
    return n <= rules.boilerplate_words and BOILERPLATE.search(line) is not None


def repeated_words_long(words: list[bytes], window: int = WINDOW) -> int:
    """:func:`repeated_words` of a long text in some bytes a word: hashes of windows, and those that meet compared."""
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    m = len(a) - window + 1
    h = np.zeros(m, np.uint64)
    for k in range(window):
        h = h * MIX + a[k : k + m].astype(np.uint64) + np.uint64(1)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    at = np.sort(order[np.r_[same, False] | np.r_[False, same]])
    if not len(at):
        return 0
    _, which, often = np.unique(a[at[:, None] + np.arange(window)], axis=0, return_inverse=True, return_counts=True)
    at = at[often[which.ravel()] > 1]
    edges = np.zeros(len(a) + 1, np.int64)
    edges[at] += 1
    edges[at + window] -= 1
    return int((np.cumsum(edges) > 0).sum())


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of ``window`` words found twice or more in the text."""
    if len(words) > LONG_WORDS:
        return repeated_words_long(words, window)
    grams = list(zip(*[words[k:] for k in range(window)]))
    if len(set(grams)) == len(grams):
        return 0
    often = Counter(grams)
    covered, end = 0, 0
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered += i + window - max(i, end)
            end = i + window
    return covered


def judge(text: str, rules: LineRules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, lost_words, clean text)."""
    words = text.encode().split()
    n = len(words)
    lines, seen, doubles, good, lost = 0, set(), 0, [], 0
    for line in text.split("\n"):
        own = line.encode().split()
        if not own:
            continue
        lines += 1
        if line in seen:
            doubles += 1
        seen.add(line)
        if line_fails(line, own, rules):
            lost += len(own)
        else:
            good.append(line)
    repeats = repeated_words(words)
    failed = n < 20 or 100 * repeats > 30 * n
    return (
        n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), doubles, repeats, failed,
        not failed and lost <= rules.lost * n, lines, lost, "\n".join(good),
    )


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines long, lost_words long, clean_text string"
)


def clean_lines(
    docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, the counts, verdicts and the text without failing lines.

    Missing and empty texts have no words: all counts are 0, they fail the base rule and are not
    kept.  Repeated rows and rows without an id come out as they went in; other columns are
    ignored.  ``n_lines`` and ``lost_words`` count lines with words, and words in failing lines.
    """
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = list(zip(*[judge(t, rules) for t in strings(batch.column(1))]))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(v, k) for v, k in zip(found, kinds)]], names=["id", *names]
                )

    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
