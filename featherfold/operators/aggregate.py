"""Grouped aggregation driven by specs: ``{column: [function, ...]}``.

Several slices of one table (all rows, active loans, last six months, ...) are
worked out in a single ``groupBy``: a slice turns each function into
``f(column) FILTER (WHERE condition)``.  One scan and one shuffle then replace a
filter, a group-by and a join back for every slice.  All functions but the
distinct count combine map-side, so a hot key costs one partial row per task.

Aggregates are handed over as SQL text: one call per output column, where column
objects would take a dozen.  Wide frames have several hundred outputs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import float_sum_text, total_text
from ..functions.scalar import all_present, as_col, ratio
from .ordered import quantiles_per_group

Spec = Mapping[str, Sequence[str]]
SMALL_GROUPS = 100_000  # rows of a group table that may be broadcast
SMALL_KEY_BYTES = 8 << 20  # and the bytes its keys may have
WIDE = 40  # outputs of one aggregate from which its groups outweigh its rows


@dataclass(frozen=True)
class Slice:
    """Aggregates ``spec`` over the rows where the SQL condition ``where`` holds; names get ``prefix``.

    Sums are exact; with ``doubles`` they are doubles, the type of a feature, which hold whole numbers below 2**53.
    """

    spec: Spec
    prefix: str = ""
    where: str | None = None
    names: Mapping[tuple[str, str], str] = field(default_factory=dict)
    doubles: bool = False

    def name(self, column: str, func: str) -> str:
        return self.names.get((column, func), f"{self.prefix}{column}_{func.upper()}")

    def outputs(self) -> list[str]:
        return [self.name(c, f) for c, funcs in self.spec.items() for f in funcs]


def merge_specs(*specs: Spec) -> dict[str, list[str]]:
    """Union of specs: a column named twice keeps every function, each once."""
    out: dict[str, list[str]] = {}
    for spec in specs:
        for column, funcs in spec.items():
            held = out.setdefault(column, [])
            held.extend(f for f in funcs if f not in held)
    return out


def shares(columns: Sequence[str]) -> dict[str, list[str]]:
    """Spec for the mean of 0/1 columns."""
    return {c: ["mean"] for c in columns}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(func: str, x: str, where: str | None, order: Sequence[str], kind: str = "double") -> str:
    """SQL of one aggregate of ``x`` of type ``kind``; NULL when the slice has no row, as after an unmatched left join.

    ``sum`` is exact for whole numbers and decimals, ``fsum`` free of the order of rows for floating ones.
    """
    only = f" FILTER (WHERE {where})" if where else ""
    if func == "size":
        return f"nullif(count(1){only}, 0)" if where else "count(1)"
    if func in ("sum", "fsum"):  # all values missing gives 0
        total = total_text(x, kind, only) if func == "sum" else f"coalesce({float_sum_text(x, only)}, 0D)"
        return f"if(count(1){only} > 0, {total}, NULL)" if where else total
    if func in ("first", "last"):
        if not order:
            raise ValueError("first/last need an order")
        pick = "min_by" if func == "first" else "max_by"
        by = ", ".join([*[quoted(o) for o in order], x])
        return f"{pick}({x}, if({x} IS NOT NULL, struct({by}), NULL)){only}"
    # fixed values: spec name -> SQL aggregate
    sql = {"mean": "avg", "var": "var_samp", "std": "stddev_samp", "min": "min", "max": "max"}
    if func not in sql:
        raise ValueError(f"unknown aggregate function: {func}")
    return f"{sql[func]}({x}){only}"


def gathered(rows: DataFrame, keys: Sequence[str], outputs: int) -> DataFrame:
    """``rows`` with those of a key brought together, in parts of bounded size, where an aggregate of many ``outputs`` follows.

    A map task holds a group for each key it meets, and a wide group takes kilobytes: a task of a scan that meets most
    keys would hold most of the result.  Parts by key meet few keys, and there are as many as the rows ask for.  A part that a
    hot key makes too large is split, so its rows still meet as partial states.
    """
    return rows.hint("rebalance", *keys) if outputs >= WIDE else rows


def together(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows that have ``keys``, those of a key in one part.

    Put under derived columns and wide aggregates, it moves each row once and narrow; groups, windows and joins by
    these keys then need no exchange of their own, and no wide state is ever shuffled.
    """
    return rows.where(all_present(keys)).hint("rebalance", *keys)


def aggregate(
    df: DataFrame, keys: str | Sequence[str], slices: Sequence[Slice], order: Sequence[str] = (), met: bool = False
) -> DataFrame:
    """One row per key with every output of every slice.

    ``met`` tells that the rows of a key are together already (see :func:`together`).

    Rows whose key is missing are left out.  Distinct counts run as narrow
    two-step aggregates of their own and join back on the key: in one aggregate
    they would multiply every input row by the number of counted columns.
    ``first``/``last`` follow ``order`` and also run apart, as they need sorting.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    kinds = dict(df.dtypes)
    rows = df.where(all_present(keys))
    plain, ordered, distinct = [], [], []
    for s in slices:
        for column, funcs in s.spec.items():
            x = f"cast({quoted(column)} AS int)" if kinds[column] == "boolean" else quoted(column)
            for func in funcs:
                name = s.name(column, func)
                if func == "nunique":
                    distinct.append((name, x, s.where))
                else:
                    target = ordered if func in ("first", "last") else plain
                    kind = "double" if s.doubles else kinds[column]
                    target.append(f"{_text(func, x, s.where, order, kind)} AS {quoted(name)}")
    parts = [(rows if met else gathered(rows, keys, len(exprs))).groupBy(*keys).agg(*[F.expr(e) for e in exprs]) for exprs in (plain, ordered) if exprs]
    if not parts:  # a filtered count would know only the keys of its own rows
        parts.append(rows.select(*keys).distinct())
    for name, x, where in distinct:
        # a NULL value keeps the key alive with count 0
        seen = rows.where(where) if where else rows
        pairs = seen.select(*keys, F.expr(x).alias("__x")).distinct()
        parts.append(pairs.groupBy(*keys).agg(F.count("__x").alias(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, keys, "left")
    outputs = [n for s in slices for n in s.outputs()]
    return out if len(parts) == 1 else out.select(*keys, *[quoted(n) for n in outputs])


def aggregate_unfused(
    df: DataFrame, keys: str | Sequence[str], slices: Sequence[Slice], order: Sequence[str] = ()
) -> DataFrame:
    """The same result by one filter, group-by and left join per slice (for comparison)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    out = df.where(all_present(keys)).select(*keys).distinct()
    for s in slices:
        rows = df.where(s.where) if s.where else df
        out = out.join(aggregate(rows, keys, [Slice(s.spec, s.prefix, None, s.names, s.doubles)], order), keys, "left")
    return out


def _few_groups(rows: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the table of distinct keys is small; reads the key columns alone."""
    size = F.octet_length(F.concat_ws("", *[as_col(k).cast("string") for k in keys]))
    groups = rows.select(*keys).distinct().limit(SMALL_GROUPS + 1)
    n, total = groups.agg(F.count(F.lit(1)), F.sum(size)).collect()[0]
    return n <= SMALL_GROUPS and (total or 0) <= SMALL_KEY_BYTES


def group_statistics(
    df: DataFrame, keys: Sequence[str], stats: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Give every row statistics of its group: ``{output: (column, function)}``.

    Functions: mean, std, sum, median.  The group table joins back to the rows; a
    window over the group would hold a hot group in one task.  Up to
    ``SMALL_GROUPS`` groups (counted first, with the size of their keys) the table
    is broadcast and the rows stay where they are; beyond that the join shuffles,
    and the adaptive skew join splits hot groups.  Rows with a missing key get NULL.
    """
    keys = list(keys)
    plain = {n: (c, f) for n, (c, f) in stats.items() if f != "median"}
    rows = df.where(all_present(keys))
    parts = []
    if plain:
        kinds = dict(df.dtypes)
        exprs = [F.expr(f"{_text(f, quoted(c), None, (), kinds[c])} AS {quoted(n)}") for n, (c, f) in plain.items()]
        parts.append(rows.groupBy(*keys).agg(*exprs))
    for name, (column, func) in stats.items():
        if func == "median":
            parts.append(quantiles_per_group(rows, keys, column, {name: 0.5}))
    table = parts[0]
    for part in parts[1:]:
        table = table.join(part, keys, "left" if plain else "full")
    if _few_groups(rows, keys):
        table = F.broadcast(table)
    out = df.join(table, keys, "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *stats)


def roll_up(
    child: DataFrame,
    parent: DataFrame,
    key: str,
    slices: Sequence[Slice],
    child_key: str | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Aggregate a child table by its foreign key and left-join it to the parent."""
    fk = child_key or key
    features = aggregate(child, fk, slices, order)
    if fk != key:
        features = features.withColumnRenamed(fk, key)
    return parent.join(features, key, "left")


def add_ratios(df: DataFrame, ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Ratio columns ``{name: (numerator, divisor)}`` in one projection."""
    return df.withColumns({n: ratio(a, b) for n, (a, b) in ratios.items()})


def add_differences(df: DataFrame, differences: Mapping[str, tuple[str, str]]) -> DataFrame:
    return df.withColumns({n: as_col(a) - as_col(b) for n, (a, b) in differences.items()})


def keep_loans_seen_since(df: DataFrame, loan: str, when: str, name: str) -> DataFrame:
    """Add the latest ``when`` of each loan, so a recency test keeps whole loans.

    "Some row of the loan is recent" equals "its latest row is recent", hence one
    small per-loan table serves every window length.
    """
    latest = df.groupBy(loan).agg(F.max(when).alias(name))
    return df.join(latest, loan, "left")
