"""Sums that no order of rows can change.

Whole numbers are added as whole numbers, beyond 64 bits as decimals; decimals stay decimals.  Floating
numbers are cut into limbs of 21 bits at fixed places, each added as a whole number, so that
partial sums of tasks can meet in any order.  All of it is SQL text over built-in aggregates, which
combine map-side and stay in generated code.
"""

from __future__ import annotations

LIMB = 21  # bits; sums of limbs stay within 64 bits for over 10**12 rows
FRACTION_LIMBS = 5
_MASK, _UNIT = (1 << LIMB) - 1, float(1 << LIMB)
_DOUBLE_LIMIT = 2.0**62


def sum_type(kind: str) -> str:
    """Type of the sum of a column of type ``kind``."""
    if kind in ("boolean", "tinyint", "smallint", "int"):
        return "bigint"
    if kind == "bigint":
        return "decimal(38,0)"
    if kind.startswith("decimal"):
        scale = kind[:-1].split(",")[1] if "," in kind else "0"
        return f"decimal(38,{scale})"
    return "double"


def sum_text(x: str, kind: str, only: str = "") -> str:
    """SQL of the sum of ``x``, exact for whole numbers and decimals; NULL where no value is."""
    out = sum_type(kind)
    if kind == "bigint":
        parts = [f"{x} & {_MASK}L", f"shiftright({x}, {LIMB}) & {_MASK}L", f"shiftright({x}, {2 * LIMB})"]
        terms = [f"cast(sum({p}){only} AS decimal(20,0)) * {1 << (LIMB * i)}BD" for i, p in enumerate(parts)]
        return f"cast({' + '.join(terms)} AS {out})"
    if kind.startswith("decimal"):
        return f"cast(sum({x}){only} AS {out})"
    return f"sum(cast({x} AS {out})){only}"


def total_text(x: str, kind: str, only: str = "") -> str:
    """:func:`sum_text`, but 0 where no value is."""
    return f"coalesce({sum_text(x, kind, only)}, cast(0 AS {sum_type(kind)}))"


def float_sum_text(x: str, only: str = "") -> str:
    """SQL of the sum of floating ``x`` that is the same bit for bit in any order of rows; NULL where no value is.

    Each value is taken to 105 binary places, which is all of a value that is 2**-53 or more apart from
    zero; what is below does not count.  Where a value is infinite, NaN or 2**62 and more, the plain sum is given.
    """
    v = f"cast({x} AS double)"
    good = f"if(abs({v}) < {_DOUBLE_LIMIT!r}D, {v}, NULL)"
    sign, whole = f"cast(sign({good}) AS bigint)", f"cast(abs({good}) AS bigint)"
    parts = [f"{whole} & {_MASK}L", f"shiftright({whole}, {LIMB}) & {_MASK}L", f"shiftright({whole}, {2 * LIMB})"]
    terms = []
    for k in range(FRACTION_LIMBS, 0, -1):  # smallest first
        limb = f"floor(((abs({good}) * {2.0 ** (LIMB * (k - 1))!r}D) % 1D) * {_UNIT!r}D)"
        terms.append(f"cast(sum({sign} * {limb}){only} AS double) * {2.0 ** (-LIMB * k)!r}D")
    whole_sum = " + ".join(f"cast(sum({sign} * ({p})){only} AS decimal(20,0)) * {1 << (LIMB * i)}BD" for i, p in enumerate(parts))
    exact = f"({' + '.join(terms)}) + cast({whole_sum} AS double)"
    return f"if(count({v}){only} > count({good}){only}, sum({v}){only}, {exact})"
