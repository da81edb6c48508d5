"""Rounding that agrees with the decimal value of a double, digit for digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2**27 + 1: halves a double into two exact 26-bit parts


def _exact_units(x: Column, digits: int) -> Column:
    scale = float(10 ** digits)
    carry = x * F.lit(_SPLITTER)
    high = carry - (carry - x)
    high_scaled, low_scaled = high * scale, (x - high) * scale
    whole = F.floor(high_scaled + low_scaled)
    beyond_half = ((high_scaled - whole) - 0.5) + low_scaled
    up = (beyond_half > 0) | ((beyond_half == 0) & (whole % 2 != 0))
    return whole + F.when(up, 1).otherwise(0)


def round_exact(x: Column, digits: int) -> Column:
    """Nearest decimal to the true binary value of ``x``, ties to even.

    ``F.round`` and ``F.bround`` look at the shortest decimal rendering instead, so they differ
    on values such as 0.55*0.5 + 0.45*0.15, whose rendering is a tie but whose value is not.
    """
    return _exact_units(x, digits) / F.lit(float(10 ** digits))


def fixed2(x: Column) -> Column:
    """``x`` with two decimals, as text."""
    units = _exact_units(x, 2)
    return F.concat(F.floor(units / 100).cast("string"), F.lit("."),
                    F.lpad((units % 100).cast("string"), 2, "0"))


def round_scaled(x: Column, digits: int) -> Column:
    """Scale, round half-even, scale back: the array-library convention for table columns."""
    scale = float(10 ** digits)
    return F.rint(x * scale) / scale


def whole(x: Column) -> Column:
    return F.rint(x).cast("long")


def percent(x: Column) -> Column:
    return F.concat(whole(x * 100.0).cast("string"), F.lit("%"))


def money(x: Column) -> Column:
    """Display string with thousands separators; never a join key."""
    return F.concat(F.lit("AED "), F.format_number(F.rint(x), 0))
