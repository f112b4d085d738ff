"""Tracts, blocks and localities.

``areas`` has one row per tract: ``cvegeo``, ``cve_mun``, ``ambito`` and ``ring``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.functions.keys import at_grain, make_key
from demarca.functions.measures import ratio, ratio_positive
from demarca.functions.text import COORDINATE, guarded_number
from demarca.operators.aggregate import agg_where, count_by
from demarca.operators.filters import grade_filter, taxonomy_filter
from demarca.operators.joins import broadcast_parent, enrich
from demarca.operators.ordered import first, latest_per_key, ranked_by, with_total
from demarca.operators.spatial import area_geometry, point_in_polygon, points_per_area
from demarca.plans.establishments import LEVEL_COLUMNS


def positioned_units(raw: DataFrame) -> DataFrame:
    """Health units whose coordinates look like numbers, with ``lon`` and ``lat``."""
    return raw.withColumns(
        {
            "lon": guarded_number(F.col("longitud"), pattern=COORDINATE),
            "lat": guarded_number(F.col("latitud"), pattern=COORDINATE),
        }
    ).filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())


def _counts(registry: DataFrame, municipality: str | None, measures: dict[str, Column | None]) -> DataFrame:
    rows = registry.filter(F.col("ageb") != "")
    if municipality:
        rows = rows.filter(F.col("area_geo") == municipality)
    return agg_where(
        rows.withColumnRenamed("ageb", "cvegeo"), ["cvegeo"], {name: (cond, None) for name, cond in measures.items()}
    )


def _described(areas: DataFrame) -> DataFrame:
    shaped = area_geometry(areas.withColumn("ambito", F.nullif(F.trim("ambito"), F.lit(""))))
    return shaped.select("cvegeo", "ambito", "centroid_lat", "centroid_lon", "area_km2")


def _zero(*names: str) -> dict[str, Column]:
    return {n: F.coalesce(n, F.lit(0)) for n in names}


def tracts_of_municipality(
    areas: DataFrame,
    registry: DataFrame,
    units: DataFrame,
    municipality: str | None,
    pharmacy: Column,
    cell: float,
    order: str = "establecimientos",
    limit: int | None = None,
) -> DataFrame:
    """Tracts with area, centroid, establishments, pharmacies and clinics inside; all of them without a limit."""
    scope = areas.filter(F.col("cve_mun") == municipality) if municipality else areas
    counts = _counts(registry, municipality, {"establecimientos": None, "farmacias": pharmacy})
    inside = points_per_area(units, scope, "cvegeo", "lon", "lat", cell, "clues")
    out = enrich(_described(scope), [counts, inside], "cvegeo").withColumns(
        _zero("establecimientos", "farmacias", "clues")
    )
    if limit is None:
        return out
    by = {"establecimientos": "establecimientos", "farmacias": "farmacias", "clues": "clues", "area": "area_km2"}
    orders = {k: [F.col(c).desc_nulls_last(), F.asc("cvegeo")] for k, c in by.items()}
    return ranked_by(out, order, orders, limit)


def pharmacy_opportunity(
    areas: DataFrame,
    registry: DataFrame,
    units: DataFrame,
    census: DataFrame,
    municipality: str | None,
    pharmacy: Column,
    cell: float,
    limit: int | None = None,
) -> DataFrame:
    """Score of half the clinics plus 0.3 of the establishments less the pharmacies, also per 1,000."""
    base = tracts_of_municipality(areas, registry, units, municipality, pharmacy, cell, limit=None)
    out = base.withColumnsRenamed(
        {"establecimientos": "num_establecimientos", "farmacias": "num_farmacias", "clues": "num_clues"}
    ).join(census.select("cvegeo", F.col("pobtot").alias("population")), "cvegeo", "left")
    tenths = F.col("num_clues") * 5 + F.col("num_establecimientos") * 3 - F.col("num_farmacias") * 10
    out = out.withColumns(
        {
            "_tenths": tenths,
            "score": ratio(tenths, F.lit(10), 1, 3),
            "score_per_1k": ratio_positive(tenths, F.col("population") * 10, 1000, 3),
        }
    )
    if limit is not None:
        out = out.orderBy(F.col("_tenths").desc_nulls_last(), F.asc("cvegeo")).limit(limit)
    return out.drop("_tenths")


def activity_opportunity(
    areas: DataFrame,
    registry: DataFrame,
    census: DataFrame,
    lag: DataFrame,
    morbidity: DataFrame,
    municipality: str | None,
    codes: list[str],
    grades: list[str] | None = None,
    order: str = "score",
    limit: int | None = None,
) -> DataFrame:
    """People per competitor in each tract, with lag grade, uncovered share and the municipality's morbidity."""
    scope = areas.filter(F.col("cve_mun") == municipality) if municipality else areas
    counts = _counts(registry, municipality, {"target_count": taxonomy_filter(codes, LEVEL_COLUMNS), "total_estab": None})
    people = census.select("cvegeo", "pobtot", "psinder")
    graded = lag.select("cvegeo", F.col("grado").alias("rezago_grado"))
    latest = latest_per_key(morbidity, ["cve_mun"], [F.col("anio").desc_nulls_last()]).select(
        "cve_mun",
        F.col("casos_dm2_promedio").alias("casos_dm2_muni"),
        F.col("casos_hta_promedio").alias("casos_hta_muni"),
        F.col("casos_obesidad_promedio").alias("casos_obesidad_muni"),
    )
    out = enrich(_described(scope), [counts, people, graded], "cvegeo").filter(
        grade_filter(F.col("rezago_grado"), grades or [])
    )
    out = broadcast_parent(out, latest, "cvegeo", "cve_mun", "municipality").drop("cve_mun")
    populated = F.nullif("pobtot", F.lit(0))
    out = out.withColumns(_zero("target_count", "total_estab")).withColumns(
        {
            "score": ratio(populated, F.col("target_count"), 1, 2),
            "pct_sin_cobertura_salud": ratio_positive(F.col("psinder"), F.col("pobtot"), 100, 1),
        }
    )
    result = out.drop("psinder")
    if limit is None:
        return result
    raw = populated / F.nullif("target_count", F.lit(0))
    orders = {
        "score": [raw.desc_nulls_last(), F.asc("cvegeo")],
        "pobtot": [F.desc_nulls_last("pobtot"), F.asc("cvegeo")],
        "target_count": [F.desc("target_count"), F.asc("cvegeo")],
        "total_estab": [F.desc("total_estab"), F.asc("cvegeo")],
    }
    return ranked_by(result, order, orders, limit)


def tract_detail(
    areas: DataFrame,
    registry: DataFrame,
    units: DataFrame,
    census: DataFrame,
    lag: DataFrame,
    localities: DataFrame,
    tract: str,
    pharmacy: Column,
    cell: float,
    top: int | None = None,
    sample: int | None = None,
) -> dict[str, DataFrame]:
    """Everything known about one tract, as small independent results."""
    area = areas.filter(F.col("cvegeo") == tract)
    here = registry.filter(F.col("ageb") == tract)
    inside = point_in_polygon(units, area, ["cvegeo"], "lon", "lat", cell)
    return {
        "identity": area_geometry(area.withColumn("ambito", F.nullif(F.trim("ambito"), F.lit("")))).drop("ring"),
        "locality": localities.filter(F.col("cve_loc") == at_grain(F.lit(tract), "locality")).select(
            F.col("pobtot").alias("loc_population"), F.col("nom_loc").alias("loc_name")
        ),
        "census": census.filter(F.col("cvegeo") == tract),
        "lag": lag.filter(F.col("cvegeo") == tract),
        "totals": here.agg(
            F.count(F.lit(1)).alias("total_establecimientos"), F.count_if(pharmacy).alias("total_farmacias")
        ),
        "top_sectors": first(
            count_by(here.filter(F.col("sector_actividad_id") != ""), ["sector_actividad_id"]).orderBy(
                F.desc("count"), F.asc("sector_actividad_id")
            ),
            top,
        ),
        "clinics": with_total(first(inside.orderBy("clues"), sample), inside, "total_clues").select(
            "clues", "lat", "lon", "total_clues"
        ),
    }


def tract_wide(census: DataFrame, lag: DataFrame, municipality: str | None = None) -> DataFrame:
    """Population and lag grade of the tracts."""
    rows = census.filter(at_grain(F.col("cvegeo"), "municipality") == municipality) if municipality else census
    people = rows.select("cvegeo", F.col("ageb").alias("cve_ageb"), F.col("pobtot").alias("pobtot_ageb"))
    return enrich(people, [lag.select("cvegeo", F.col("grado").alias("grado_rezago_ageb"))], "cvegeo")


BLOCK_ORDERS = ["pobtot", "tvivpar", "vph_inter"]
LOCALITY_ORDERS = ["pobtot", "tamloc", "altitud_m", "vph_inter", "nom_loc"]


def blocks_of_tract(blocks: DataFrame, tract: str, order: str = "pobtot", limit: int | None = None) -> DataFrame:
    """Blocks of a tract in one of three orders."""
    rows = blocks.filter(F.col("cvegeo_ageb") == tract).withColumn(
        "cvegeo_mza", make_key((F.col("cvegeo_ageb"), None), (F.col("mza"), None))
    )
    columns = ["cvegeo_mza", "mza", "pobtot", "pobfem", "pobmas", "tvivpar", "vph_inter", "vph_autom"]
    orders = {c: [F.desc_nulls_last(c), F.asc("mza")] for c in BLOCK_ORDERS}
    return ranked_by(rows.select(*columns), order, orders, limit)


def localities_of_municipality(
    localities: DataFrame, municipality: str, order: str = "pobtot", limit: int | None = None
) -> DataFrame:
    """Localities in one of five orders, beside their total number."""
    rows = localities.filter(F.col("cve_mun") == municipality)
    columns = ["cve_loc", "nom_loc", "tamloc", "altitud_m", "pobtot", "tvivpar", "vph_inter"]
    orders = {c: [F.desc_nulls_last(c), F.asc("cve_loc")] for c in LOCALITY_ORDERS}
    orders["nom_loc"] = [F.asc_nulls_last("nom_loc"), F.asc("cve_loc")]
    return with_total(ranked_by(rows.select(*columns), order, orders, limit), rows, "total_localities")
