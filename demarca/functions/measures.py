"""Rates, shares and encodings with fixed rounding rules.

Ratios are computed on exact decimals with at least 15 fraction digits and
rounded half away from zero. Sums of doubles never take part, so results do not
depend on the order rows are added in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(18,0)"
MONEY = "decimal(18,2)"
MONEY_SUM = "decimal(24,2)"

# The five ordered grades, lowest first, and the missing marker.
GRADES = ["Muy bajo", "Bajo", "Medio", "Alto", "Muy alto"]
NO_GRADE = "sin_dato"


def ratio(num: Column, den: Column, scale: int = 1, digits: int = 2) -> Column:
    """``round(num * scale / den, digits)`` for integer columns, NULL unless den is not 0."""
    d = F.nullif(den.cast(EXACT), F.lit(0).cast(EXACT))
    return F.round(num.cast(EXACT) * F.lit(scale) / d, digits)


def ratio_positive(num: Column, den: Column, scale: int = 1, digits: int = 2) -> Column:
    """As ``ratio`` but NULL unless the denominator is above 0."""
    return F.when(den > 0, ratio(num, den, scale, digits))


def money_ratio(amount: Column, den: Column, scale: int = 1, digits: int = 2) -> Column:
    """Amounts with two decimals over an integer count."""
    return F.round(amount.cast(MONEY_SUM) * F.lit(scale) / F.nullif(den.cast(EXACT), F.lit(0).cast(EXACT)), digits)


def money_share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percent of one amount in another."""
    return F.round(part.cast(MONEY_SUM) * F.lit(100) / F.nullif(whole.cast(MONEY_SUM), F.lit(0).cast(MONEY_SUM)), digits)


def percent(num: Column, den: Column, digits: int = 2) -> Column:
    return ratio(num, den, 100, digits)


def per_thousand(num: Column, den: Column, digits: int = 2) -> Column:
    return ratio_positive(num, den, 1000, digits)


def per_hundred_thousand(num: Column, den: Column, digits: int = 2) -> Column:
    return ratio_positive(num, den, 100000, digits)


def change_percent(now: Column, base: Column, digits: int = 1) -> Column:
    """Percent change against a baseline, NULL unless the baseline is above 0."""
    return ratio_positive(now - base, base, 100, digits)


def round_to_long(c: Column) -> Column:
    """Integer nearest to a decimal, halves away from zero (a bare cast would truncate)."""
    return F.round(c, 0).cast("long")


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def sum_where(cond: Column, value: Column) -> Column:
    """Conditional sum, NULL when no row qualifies."""
    return F.sum(F.when(cond, value))


def sum_where0(cond: Column, value: Column) -> Column:
    """Conditional sum, 0 when no row qualifies."""
    return F.coalesce(sum_where(cond, value), F.lit(0))


def grade_or_missing(c: Column) -> Column:
    """The grade if it is one of the five, else the missing marker."""
    return F.when(c.isin(GRADES), c).otherwise(F.lit(NO_GRADE))


def ordinal(c: Column, order: list[str] = GRADES, base: int = 1) -> Column:
    """Position of a category in its order; unknown categories are NULL."""
    pairs = [x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i + base))]
    return F.try_element_at(F.create_map(*pairs), c)
