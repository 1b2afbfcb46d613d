"""Rounding, money and number texts.

Rounding is floor(x + 0.5) throughout, because the stored figures were made
that way; `round` differs on ties of binary fractions and on negatives. Money
is added up in whole cents (long), which is exact in any order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Whole number nearest to x, ties upward, as long."""
    return F.floor(x + F.lit(0.5)).cast("long")


def money(x: Column) -> Column:
    """x at two decimals, ties upward, as double."""
    return F.floor(x * F.lit(100.0) + F.lit(0.5)).cast("double") / F.lit(100.0)


def cents(x: Column) -> Column:
    return F.floor(x.cast("double") * F.lit(100.0) + F.lit(0.5)).cast("long")


def from_cents(c: Column) -> Column:
    return c.cast("double") / F.lit(100.0)


def sum_money(x: Column) -> Column:
    """Exact sum of money values, as double."""
    return from_cents(F.sum(cents(x)))


def sum_quantity(x: Column) -> Column:
    """Sum of quantities or areas, exact at six decimals in any order of addition, as double."""
    millionths = F.floor(x.cast("double") * F.lit(1e6) + F.lit(0.5)).cast("decimal(38,0)")
    return F.sum(millionths).cast("double") / F.lit(1e6)


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def deviation_pct(actual: Column, expected: Column) -> Column:
    """Absolute deviation in percent; 100 where nothing positive is expected."""
    return F.when(
        expected > 0, F.abs(actual - expected) / expected * F.lit(100.0)
    ).otherwise(F.lit(100.0))


def leading_number(raw: Column) -> Column:
    """The number a text starts with, or null when it starts with none."""
    prefix = F.regexp_extract(raw, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.nullif(prefix, F.lit("")).try_cast("double")


def indian_digits(x: Column, rounded: bool = False) -> Column:
    """Number text grouped 3-2-2 from the right, up to three decimals."""
    milli = F.when(F.lit(rounded), F.floor(x + 0.5) * 1000).otherwise(
        F.floor(F.abs(x) * 1000.0 + 0.5) * F.signum(x)
    )
    size = F.abs(milli).cast("decimal(38,0)")
    whole = F.floor(size / F.lit(1000)).cast("decimal(38,0)")
    part = (size - whole * F.lit(1000)).cast("int")
    grouped = F.regexp_replace(whole.cast("string"), r"(\d)(?=(\d\d)+\d$)", "$1,")
    tail = F.regexp_replace(F.format_string(".%03d", part), r"\.?0+$", "")
    sign = F.when(milli < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, grouped, tail)
