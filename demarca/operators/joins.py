"""Joins of units with their measures.

Measure tables come in at one row per unit, aggregated before the join. No join
carries a hint: the engine picks broadcast or shuffle from measured sizes and
splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.functions.keys import at_grain, label_key
from demarca.operators.ordered import latest_per_key


def enrich(spine: DataFrame, tables: Sequence[DataFrame], on: str | list[str]) -> DataFrame:
    """Left join of all units with any number of one-row-per-unit tables."""
    out = spine
    for t in tables:
        out = out.join(t, on, "left")
    return out


def with_label(
    df: DataFrame, lookup: DataFrame, code: str, label: str, name: str, missing: Column | None = None
) -> DataFrame:
    """Name of a code from a fixed lookup (columns ``code``, ``label``)."""
    names = lookup.select(F.col("code").alias(code), F.col(label).alias(name))
    out = df.join(names, code, "left")
    return out if missing is None else out.withColumn(name, F.coalesce(F.col(name), missing))


def join_on_label(df: DataFrame, lookup: DataFrame, label: str) -> DataFrame:
    """Inner join on a name compared trimmed and in upper case."""
    right = lookup.withColumn("_label", label_key(F.col(label))).drop(label)
    return df.withColumn("_label", label_key(F.col(label))).join(right, "_label").drop("_label")


def compare_periods(
    df: DataFrame, keys: list[str], period: str, current: int, baseline: int, measure: str, name: str
) -> DataFrame:
    """Rows of the current period with one measure of the baseline period beside them."""
    base = df.filter(F.col(period) == baseline).select(*keys, F.col(measure).alias(name))
    return df.filter(F.col(period) == current).join(base, keys, "left")


def latest_join(outer: DataFrame, inner: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Each outer row with the latest inner row of its key, if any."""
    return outer.join(latest_per_key(inner, [key], order), key, "left")


def with_single(df: DataFrame, one: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns of a table that has at most one row on every row of another; NULLs if it has none.

    The single row is a scalar subquery, so no join takes place; more rows are an error.
    """
    names = list(columns or one.columns)
    out = df.withColumn("_single", one.select(F.struct(*names)).scalar())
    return out.select(*df.columns, *[F.col("_single")[n].alias(n) for n in names])


def one_row(key: str, value: str, sides: Sequence[DataFrame]) -> DataFrame:
    """Exactly one row for a key, with NULLs for sides that have no row for it."""
    out = sides[0].sparkSession.range(1).select(F.lit(value).alias(key))
    for side in sides:
        out = with_single(out, side.filter(F.col(key) == value).drop(key))
    return out


def broadcast_parent(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, grain: str) -> DataFrame:
    """Values of the enclosing area on every child row."""
    return child.withColumn(parent_key, at_grain(F.col(child_key), grain)).join(parent, parent_key, "left")


def deserts(units: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Units in which no point lies."""
    return units.join(points.select(key).distinct(), key, "left_anti")


def stratum_join(df: DataFrame, strata: DataFrame, state: str, is_urban: Column, key: str = "estrato") -> DataFrame:
    """Contextual values by state and urban or rural class."""
    stratum = F.concat_ws("_", F.col(state), F.when(is_urban, "urbano").otherwise("rural"))
    return df.withColumn(key, stratum).join(strata, key, "left")


def assemble_layers(keys: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """One column per layer on the distinct keys; keys without any value are dropped.

    A layer has the columns ``k`` and ``v`` with one row per key.
    """
    if not layers:
        raise ValueError("no layer given")
    out = keys.select("k").filter(F.col("k").isNotNull()).distinct()
    for name, layer in layers.items():
        out = out.join(layer.select("k", F.col("v").alias(name)), "k", "left")
    return out.filter(F.coalesce(*[F.col(n) for n in layers]).isNotNull())
