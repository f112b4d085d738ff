"""Grouped aggregates: counts, conditional sums, shares, modes, period rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.functions.measures import EXACT, ratio, ratio_positive, sum_where, sum_where0
from demarca.operators.ordered import SALTS, top_per_group


def count_by(df: DataFrame, keys: list[str], name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def agg_where(df: DataFrame, keys: list[str], measures: dict[str, tuple[Column | None, Column | None]]) -> DataFrame:
    """Conditional counts and sums in one pass.

    ``measures`` maps a name to ``(predicate, value)``: no value counts rows, no
    predicate takes them all. Conditional sums give 0 when no row qualifies.
    """
    cols = []
    for name, (cond, value) in measures.items():
        if value is None:
            c = F.count(F.lit(1)) if cond is None else F.count_if(cond)
        elif cond is None:
            c = F.sum(value)
        else:
            c = sum_where0(cond, value)
        cols.append(c.alias(name))
    return df.groupBy(*keys).agg(*cols)


def share(value: Column, cond: Column, digits: int = 2) -> Column:
    """Percent of a summed measure on qualifying rows, over all rows."""
    return ratio(sum_where0(cond, value), F.sum(value), 100, digits)


def share_known(value: Column, cond: Column, known: Column, digits: int = 2) -> Column:
    """As ``share`` but only rows whose category is known make up the denominator."""
    return ratio(sum_where0(cond, value), sum_where(known, value), 100, digits)


def tier_shares(value: Column, tier: Column, names: dict[int, str], digits: int = 2) -> list[Column]:
    """Percent per tier over classified rows; every share is NULL when none is classified."""
    known = sum_where(tier.isNotNull(), value)
    return [
        ratio_positive(sum_where0(tier == code, value), known, 100, digits).alias(name) for code, name in names.items()
    ]


def weighted_mean(value: Column, weight: Column, digits: int = 2) -> Column:
    """Mean of decimal percentages by integer weight; missing weights count as 0."""
    w = F.coalesce(weight, F.lit(0))
    total = F.nullif(F.sum(w).cast(EXACT), F.lit(0).cast(EXACT))
    return F.round(F.sum(value * w).cast("decimal(24,4)") / total, digits)


def weighted_ratio(num: Column, den: Column, digits: int = 2) -> Column:
    """Percent of one weighted sum in another."""
    return ratio(F.sum(num), F.sum(den), 100, digits)


def period_average(total: Column, period: Column) -> Column:
    """A summed weight averaged over the periods present, as an integer."""
    return F.round(total.cast(EXACT) / F.count_distinct(period), 0).cast("long")


def best_category(df: DataFrame, keys: list[str], category: str, size: Column, names: tuple[str, str]) -> DataFrame:
    """Category with the largest measure per key; equal measures go to the smallest category.

    The measure is summed per (key, category) first; picking the best of a key is
    then a minimum, which combines on the map side and needs no sorted window. Rows
    without a category never win; a key with no other rows gets NULLs.
    """
    code, amount = names
    summed = df.groupBy(*keys, category).agg(size.alias("_size"))
    unknown = F.col(category).isNull()
    entry = F.struct(unknown.alias("u"), (-F.col("_size")).alias("s"), F.col(category).alias("c"))
    best = summed.groupBy(*keys).agg(F.min(entry).alias("_best"))
    known = ~F.col("_best.u")
    return best.select(
        *keys, F.when(known, F.col("_best.c")).alias(code), F.when(known, -F.col("_best.s")).alias(amount)
    )


def mode_by(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Most frequent non-NULL value per key, smallest on a tie."""
    found = best_category(df.filter(F.col(value).isNotNull()), keys, value, F.count(F.lit(1)), (name, "_n"))
    return found.drop("_n")


def top_n_array(df: DataFrame, keys: list[str], value: str, n: int, name: str) -> DataFrame:
    """The ``n`` most frequent values per key, most frequent first, as an array."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    order = [F.desc("_n"), F.asc(value)]
    top = top_per_group(counts, keys, order, n, salt=F.pmod(F.hash(value), F.lit(SALTS)), rank="_rk")
    return (
        top.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_rk", value))).alias("_list"))
        .select(*keys, F.transform("_list", lambda x: x[value]).alias(name))
    )


def id_pages(df: DataFrame, keys: list[str], ident: str, page: Column, name: str = "ids") -> DataFrame:
    """Ordered id list per group, in pages.

    ``page`` must not decrease as ``ident`` grows and must bound how many ids share
    a page (an id range, say); the pages of a group read in order are its list.
    """
    return (
        df.select(*keys, page.alias("page"), ident)
        .groupBy(*keys, "page")
        .agg(F.sort_array(F.collect_list(ident)).alias(name))
    )


def numbered_columns(columns: list[str], prefix: str) -> list[str]:
    """Columns named by the prefix and digits only."""
    return [c for c in columns if re.fullmatch(rf"{re.escape(prefix)}\d+", c)]


def row_sum(columns: list[str], missing: str = "NULL") -> Column:
    """Sum of text columns in one row; missing cells count 0."""
    if not columns:
        raise ValueError("no columns match the prefix")
    total = F.lit(0).cast("long")
    for c in columns:
        total = total + F.coalesce(F.nullif(F.col(c), F.lit(missing)).cast("long"), F.lit(0))
    return total


def complete_periods(df: DataFrame, period: str, part: str, parts: int) -> DataFrame:
    """Periods in which all parts (months of a year, say) occur."""
    return df.groupBy(period).agg(F.count_distinct(part).alias("parts")).filter(F.col("parts") == parts)


def large_periods(df: DataFrame, period: str, floor: int) -> DataFrame:
    """Periods with at least ``floor`` rows."""
    return df.groupBy(period).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= floor)


def latest_period(periods: DataFrame, period: str, up_to: int) -> DataFrame:
    """Latest listed period not after ``up_to``, as one row."""
    return periods.filter(F.col(period) <= up_to).agg(F.max(period).alias(period))


def period_value(period: Column, value: Column, which: int) -> Column:
    """Largest value in one period."""
    return F.max(F.when(period == which, value))


def period_mean(period: Column, value: Column, which: list[int]) -> Column:
    """Mean over a set of periods, rounded to an integer."""
    inside = period.isin(which)
    return F.round(sum_where(inside, value).cast(EXACT) / F.nullif(F.count_if(inside & value.isNotNull()), F.lit(0)), 0)
