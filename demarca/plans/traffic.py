"""Traffic stations: cleaning, placing, and composition weighted by volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.functions.keys import at_grain
from demarca.functions.measures import EXACT
from demarca.functions.text import null_tokens
from demarca.operators.aggregate import top_n_array
from demarca.operators.joins import enrich
from demarca.operators.ordered import latest_per_key
from demarca.operators.spatial import point_in_polygon

# Missing-value tokens, numeric columns and the identity of a station.
MISSING = ["", "sin dato", "*"]
COMPOSITION = ["m", "a", "b", "c2", "c3", "t3s2", "t3s3", "t3s2r4", "otros", "a1", "b1", "c", "k_prime", "d"]
IDENTITY = ["latitud", "longitud", "clave", "punto_generador", "km", "te", "sc"]
TRUCKS = ["c2", "c3", "t3s2", "t3s3", "t3s2r4"]
ROUTES = 3


def stations(raw: DataFrame) -> DataFrame:
    """Typed stations with a position and a volume; copies published by two states count once.

    Of several copies the first in the order of all remaining columns stays.
    """
    known = raw
    for c in ("latitud", "longitud", "tdpa"):
        known = known.filter(null_tokens(F.col(c), [""]).isNotNull())
    rest = [c for c in known.columns if c not in IDENTITY]
    once = latest_per_key(known, IDENTITY, [F.asc_nulls_last(c) for c in rest])
    numbers = [c for c in COMPOSITION if c in raw.columns]
    typed = {c: null_tokens(F.col(c), MISSING).cast("decimal(9,3)") for c in numbers}
    typed |= {c: null_tokens(F.col(c), MISSING).cast("double") for c in ("latitud", "longitud")}
    typed["tdpa"] = null_tokens(F.col("tdpa"), MISSING).cast("long")
    return once.withColumns(typed)


def placed_stations(raw: DataFrame, municipalities: DataFrame, cell: float) -> DataFrame:
    """Stations with the municipality (``cve_mun``) that holds them, if any."""
    return point_in_polygon(stations(raw), municipalities, ["cve_mun"], "longitud", "latitud", cell, "left")


def _weighted(share: Column) -> Column:
    volume = F.sum("tdpa").cast(EXACT)
    total = F.nullif(volume, F.lit(0).cast(EXACT))
    return F.round(F.sum(share * F.col("tdpa")).cast("decimal(28,3)") / total, 2)


def traffic(placed: DataFrame, grain: str) -> DataFrame:
    """Stations, volume, composition weighted by volume and the commonest routes per unit.

    State results come from the stations, not from municipal percentages.
    """
    key = "cve_mun" if grain == "municipality" else "cve_ent"
    rows = placed.filter(F.col("cve_mun").isNotNull()).withColumn("cve_ent", at_grain(F.col("cve_mun"), "state"))
    trucks = sum((F.col(c) for c in TRUCKS[1:]), F.col(TRUCKS[0]))
    volume = F.col("tdpa")
    totals = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("station_count"),
        F.sum(volume).alias("tdpa_total"),
        F.max(volume).alias("tdpa_max"),
        F.round(F.sum(volume).cast(EXACT) / F.count(volume), 0).cast("long").alias("tdpa_mean"),
        _weighted(F.col("m")).alias("pct_motos"),
        _weighted(F.col("a")).alias("pct_autos"),
        _weighted(F.col("b")).alias("pct_buses"),
        _weighted(trucks).alias("pct_camiones"),
        _weighted(F.col("otros")).alias("pct_otros"),
        F.count_distinct("ruta").alias("route_count"),
    )
    routes = top_n_array(rows, [key], "ruta", ROUTES, "routes_top")
    empty = F.array().cast("array<string>")
    return enrich(totals, [routes], key).withColumn("routes_top", F.coalesce("routes_top", empty))
