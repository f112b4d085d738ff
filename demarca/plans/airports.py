"""Airport movements per airport and municipality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demarca.functions.measures import change_percent
from demarca.operators.aggregate import period_mean, period_value
from demarca.operators.joins import join_on_label


def movements_yearly(movements: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Flights per airport and year with the airport's municipality; operators are added up."""
    summed = movements.groupBy("airport_name", "ano").agg(F.sum("mar_flights").alias("mar_flights"))
    return join_on_label(summed, crosswalk, "airport_name").select("airport_name", "cve_mun", "ano", "mar_flights")


def airports_of_municipality(
    yearly: DataFrame, municipality: str | None, latest: int, recent: list[int], base: int
) -> DataFrame:
    """Airports with the latest year, the mean of recent years and the change against a base year."""
    rows = yearly.filter(F.col("cve_mun") == municipality) if municipality else yearly
    year, n = F.col("ano"), F.col("mar_flights")
    keys = ["airport_name"] if municipality else ["cve_mun", "airport_name"]
    per = rows.groupBy(*keys).agg(
        period_value(year, n, latest).alias("_now"),
        period_mean(year, n, recent).alias("_recent"),
        period_value(year, n, base).alias("_base"),
    )
    return per.select(
        *keys,
        F.coalesce("_now", F.lit(0)).cast("long").alias("flights_latest"),
        F.coalesce("_recent", F.lit(0)).cast("long").alias("flights_recent_avg"),
        F.col("_base").cast("long").alias("flights_base"),
        change_percent(F.col("_now"), F.col("_base")).alias("pct_change_vs_base"),
    )


def municipality_movements(yearly: DataFrame, latest: int, recent: list[int], base: int) -> DataFrame:
    """All airports of a municipality together: per year first, then over the years."""
    per_year = yearly.groupBy("cve_mun", "ano").agg(
        F.sum("mar_flights").alias("flights"), F.count_distinct("airport_name").alias("airports")
    )
    year, n = F.col("ano"), F.col("flights")
    now, then = period_value(year, n, latest), period_value(year, n, base)
    return per_year.groupBy("cve_mun").agg(
        period_value(year, F.col("airports"), latest).alias("num_airports_latest"),
        period_mean(year, n, recent).cast("long").alias("flights_recent_avg"),
        then.alias("flights_base"),
        now.alias("flights_latest"),
        change_percent(now, then).alias("pct_change_vs_base"),
    )
