"""Coverage, reconciliation and other checks on loaded tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType, StringType

from demarca.functions.keys import STATE
from demarca.functions.measures import ratio, ratio_positive
from demarca.functions.text import guarded_number
from demarca.operators.joins import with_single
from demarca.operators.ordered import first

# Coverage bands in percent.
GREEN, YELLOW = 99, 90


def coverage(
    df: DataFrame, key: str, present: dict[str, Column], created: str | None = None, updated: str | None = None
) -> DataFrame:
    """Rows and rows with each kind of content per state; states outside 01–32 are left out."""
    cols = [F.count(F.lit(1)).alias("loaded")]
    if created:
        cols.append(F.min(created).alias("first_loaded_at"))
    if updated:
        cols.append(F.max(updated).alias("last_updated_at"))
    cols += [F.count_if(c).alias(f"with_{name}") for name, c in present.items()]
    return df.filter(F.col(key).rlike(STATE)).groupBy(key).agg(*cols)


def filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def with_status(df: DataFrame) -> DataFrame:
    """Coverage percent and band of rows with ``loaded`` and ``official_total``."""
    loaded, official = F.col("loaded"), F.col("official_total")
    band = (
        F.when(official.isNull(), "unverified")
        .when(loaded * 100 >= official * GREEN, "green")
        .when(loaded * 100 >= official * YELLOW, "yellow")
        .otherwise("red")
    )
    return df.withColumns({"coverage_pct": ratio_positive(loaded, official, 100, 2), "status": band})


def coverage_status(counts: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Loaded rows against authoritative totals (``key``, ``official_total``), with a status band."""
    return with_status(counts.join(totals, key, "left"))


def reconcile(parts: dict[str, DataFrame], measures: dict[str, str]) -> DataFrame:
    """Totals of the same measures in several tables, one row per table (``source``)."""
    rows = [
        df.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(name) for name, c in measures.items()]).select(
            F.lit(label).alias("source"), "*"
        )
        for label, df in parts.items()
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def reconcile_difference(detail: DataFrame, coarse: DataFrame, measures: dict[str, str]) -> DataFrame:
    """Coarse total minus detail total of each measure, as one row."""
    fine = detail.agg(*[F.sum(c).alias(f"{n}_detail") for n, c in measures.items()])
    both = with_single(fine, coarse.agg(*[F.sum(c).alias(f"{n}_coarse") for n, c in measures.items()]))
    return both.withColumns({f"{n}_difference": F.col(f"{n}_coarse") - F.col(f"{n}_detail") for n in measures})


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def required_nulls(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Missing values of each required field over the whole table, one row per field."""

    def missing(c: str) -> Column:
        col = F.col(c)
        blank = F.trim(col.cast("string")) == ""
        return F.count_if(col.isNull() | blank).alias(c)

    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[missing(f) for f in fields])
    return counted.unpivot(["_rows"], list(fields), "field", "missing").withColumnRenamed("_rows", "rows")


def match_rate(df: DataFrame, ref: DataFrame, key: str, floor: float) -> DataFrame:
    """Share of rows whose key exists in the reference table, and whether it reaches the floor.

    Rows are counted per key before the join.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    known = ref.select(key).distinct().withColumn("_known", F.lit(True))
    hit = F.when(F.col("_known"), F.col("_n")).otherwise(0)
    out = counts.join(known, key, "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(hit), F.lit(0)).alias("matched")
    )
    return out.withColumn("match_pct", ratio(F.col("matched"), F.col("rows"), 100, 2)).withColumn(
        "passed", F.col("match_pct") >= floor
    )


def profile(df: DataFrame) -> DataFrame:
    """Row count and the minimum, maximum and mean of every column of numbers without missing values.

    A text column counts if all of its texts are numbers. Integers and decimals are summed
    exactly, the others as doubles. One row per such column; one aggregation over the table.
    """
    stats = []
    for f in df.schema.fields:
        c, text = f.name, isinstance(f.dataType, StringType)
        if not (text or isinstance(f.dataType, NumericType)):
            continue
        number = guarded_number(F.trim(F.col(c))) if text else F.col(c)
        v = number.cast("double")
        total = F.sum(number.cast("decimal(38,0)") if isinstance(f.dataType, IntegralType) else number)
        stats.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(v).alias("present"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                (total.cast("double") / F.count(v)).alias("mean"),
            )
        )
    one = df.agg(F.count(F.lit(1)).alias("row_count"), F.array(*stats).alias("_stats"))
    rows = one.select("row_count", F.inline("_stats"))
    return rows.filter((F.col("present") == F.col("row_count")) & (F.col("row_count") > 0)).drop("present")


def first_rows(df: DataFrame, order: list[Column], n: int | None = None) -> DataFrame:
    """The rows in a stable order, or the first ``n`` as shown beside a profile."""
    return first(df.orderBy(*order), n)
