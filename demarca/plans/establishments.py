"""Results over the establishment registry.

Registry tables carry ``clee``, ``entidad``, ``area_geo`` (municipality), ``ageb``
(tract), ``colonia``, the five activity columns, ``estrato`` and a position. Counts
are taken before any join, so a municipality that holds most rows is one row by
the time it meets another table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.functions.keys import at_grain, label_key
from demarca.functions.measures import NO_GRADE, per_hundred_thousand, per_thousand, ratio
from demarca.operators.aggregate import agg_where, best_category, count_by, mode_by, weighted_mean
from demarca.operators.filters import taxonomy_filter
from demarca.operators.joins import enrich, one_row, with_label, with_single
from demarca.operators.ordered import first, ranked_by
from demarca.operators.quality import coverage, coverage_status, filled, with_status
from demarca.sources.increments import Summary

LEVEL_COLUMNS = {
    2: "sector_actividad_id",
    3: "subsector_actividad_id",
    4: "rama_actividad_id",
    5: "subrama_actividad_id",
    6: "clase_actividad_id",
}
# Two published readings of "pharmacy"; callers choose.
PHARMACY_PREFIX = "4659"
PHARMACY_CLASSES = ["464111", "464112"]


def pharmacy_by_prefix(prefix: str = PHARMACY_PREFIX) -> Column:
    return F.startswith(F.col("clase_actividad_id"), F.lit(prefix))


def pharmacy_by_class(classes: list[str] | None = None) -> Column:
    return F.col("clase_actividad_id").isin(classes or PHARMACY_CLASSES)


def national_treemap(registry: DataFrame, lag: DataFrame, poverty: DataFrame) -> DataFrame:
    """Per state: establishments, modal grade, poverty weighted by population."""
    counts = count_by(registry.filter(F.col("entidad").isNotNull()), ["entidad"], "establecimientos")
    grades = mode_by(
        lag.select(at_grain(F.col("cve_mun"), "state").alias("entidad"), "irs_grado"),
        ["entidad"],
        "irs_grado",
        "modal_irs_grado",
    )
    poor = poverty.groupBy(at_grain(F.col("cve_mun"), "state").alias("entidad")).agg(
        weighted_mean(F.col("pobreza_pct"), F.col("poblacion")).alias("pobreza_pct_promedio")
    )
    return enrich(counts, [grades, poor], "entidad")


#: Per state the establishments, how many classes they have, and the class most of them share, kept by change.
STATE_CLASSES = Summary(
    "state_classes",
    ("entidad", "clase_actividad_id"),
    lambda registry, keys: count_by(registry.filter(F.col("entidad").isNotNull()), keys, "n"),
    {"n": "sum"},
    lambda cells: enrich(
        cells.groupBy("entidad").agg(F.sum("n").alias("establecimientos"), F.count("clase_actividad_id").alias("clases")),
        [best_category(cells.filter(F.col("clase_actividad_id").isNotNull()), ["entidad"], "clase_actividad_id", F.sum("n"), ("clase_modal", "en_clase_modal"))],
        "entidad",
    ),
)


def sector_grade_matrix(registry: DataFrame, lag: DataFrame) -> DataFrame:
    """Establishments by sector and grade of their municipality."""
    cells = count_by(
        registry.filter(F.col("sector_actividad_id").isNotNull()), ["sector_actividad_id", "area_geo"], "_n"
    )
    graded = cells.join(lag.select(F.col("cve_mun").alias("area_geo"), "irs_grado"), "area_geo", "left")
    return graded.groupBy(
        F.col("sector_actividad_id").alias("scian"), F.coalesce("irs_grado", F.lit(NO_GRADE)).alias("irs_grado")
    ).agg(F.sum("_n").alias("count"))


def municipality_panel(
    registry: DataFrame,
    census: DataFrame,
    clinics: DataFrame,
    poverty: DataFrame,
    lag: DataFrame,
    state: str,
    pharmacy: Column,
) -> DataFrame:
    """Municipalities of a state with establishments, pharmacies, clinics, population and poverty."""
    counts = agg_where(
        registry.filter((F.col("entidad") == state) & F.col("area_geo").isNotNull()).withColumnRenamed(
            "area_geo", "cve_mun"
        ),
        ["cve_mun"],
        {"establecimientos": (None, None), "farmacias": (pharmacy, None)},
    )
    units = count_by(clinics.filter(at_grain(F.col("cve_mun"), "state") == state), ["cve_mun"], "unidades_clues")
    people = census.select("cve_mun", F.col("nom_mun").alias("municipio"), F.col("pobtot").alias("poblacion"))
    out = enrich(
        counts,
        [people, units, poverty.select("cve_mun", "pobreza_pct"), lag.select("cve_mun", "irs_grado", "irs_indice")],
        "cve_mun",
    )
    return out.withColumn("unidades_clues", F.coalesce("unidades_clues", F.lit(0)))


def top_sectors(registry: DataFrame, sectors: DataFrame, state: str, limit: int | None = None) -> DataFrame:
    """Largest sectors of a state with their names."""
    rows = registry.filter((F.col("entidad") == state) & F.col("sector_actividad_id").isNotNull())
    counts = count_by(rows, ["sector_actividad_id"]).withColumnRenamed("sector_actividad_id", "scian")
    top = ranked_by(counts, "count", {"count": [F.desc("count"), F.asc("scian")]}, limit)
    return with_label(top, sectors, "scian", "nombre", "name", _unnamed_sector())


def _unnamed_sector() -> Column:
    return F.concat(F.lit("(SCIAN "), F.col("scian"), F.lit(" — sin etiqueta)"))


def sector_list(registry: DataFrame, sectors: DataFrame) -> DataFrame:
    """All sectors with their national counts."""
    rows = registry.filter(F.col("sector_actividad_id").isNotNull())
    counts = count_by(rows, ["sector_actividad_id"], "national_count").withColumnRenamed("sector_actividad_id", "scian")
    return with_label(counts, sectors, "scian", "nombre", "name", _unnamed_sector())


def sector_national(registry: DataFrame, sector: str, limit: int | None = None) -> DataFrame:
    """States with most establishments of one sector, beside the national total."""
    by_state = count_by(registry.filter(F.col("sector_actividad_id") == sector), ["entidad"])
    total = by_state.agg(F.sum("count"))
    return (
        first(by_state.orderBy(F.desc("count"), F.asc("entidad")), limit).withColumn("national_total", total.scalar())
    )


def top_classes(registry: DataFrame, limit: int | None = None, state: str | None = None) -> DataFrame:
    """Most frequent activity classes, nationally or in one state."""
    rows = registry.filter(F.col("entidad") == state) if state else registry
    counts = count_by(rows, ["clase_actividad_id"], "total")
    return first(counts.orderBy(F.desc("total"), F.asc_nulls_last("clase_actividad_id")), limit)


def top_municipalities(registry: DataFrame, limit: int | None = None, state: str | None = None) -> DataFrame:
    """Municipalities with most establishments, nationally or in one state."""
    rows = registry.filter(F.col("area_geo").isNotNull())
    rows = rows.filter(F.col("entidad") == state) if state else rows
    return first(count_by(rows, ["area_geo"], "total").orderBy(F.desc("total"), F.asc("area_geo")), limit)


def class_summary(registry: DataFrame) -> DataFrame:
    """Establishments per state and class; feeds rankings and state summaries."""
    return count_by(registry, ["entidad", "clase_actividad_id"], "total")


def size_distribution(registry: DataFrame) -> DataFrame:
    """Establishments per state and size band."""
    return count_by(registry.filter(F.col("estrato").isNotNull()), ["entidad", "estrato"], "total")


def registry_coverage(registry: DataFrame) -> DataFrame:
    """Rows, load times, and rows with a position, telephone and e-mail per state."""
    present = {
        "geom": F.col("latitud").isNotNull() & F.col("longitud").isNotNull(),
        "telefono": filled(F.col("telefono")),
        "correo_e": filled(F.col("correo_e")),
    }
    return coverage(registry, "entidad", present, "created_at", "updated_at")


def official(totals: DataFrame) -> DataFrame:
    return totals.withColumnRenamed("code", "entidad")


def coverage_report(registry: DataFrame, totals: DataFrame) -> DataFrame:
    """Coverage of every state against the authoritative totals."""
    return coverage_status(registry_coverage(registry), official(totals), "entidad")


def state_list(registry: DataFrame, states: DataFrame, totals: DataFrame) -> DataFrame:
    """All 32 states, loaded or not, with their coverage status."""
    loaded = count_by(registry, ["entidad"], "loaded")
    spine = states.withColumnsRenamed({"code": "entidad"})
    known = spine.join(loaded, "entidad", "left").withColumn("loaded", F.coalesce("loaded", F.lit(0)))
    return coverage_status(known, official(totals), "entidad").drop("coverage_pct")


def state_summary(registry: DataFrame, totals: DataFrame, state: str, top: int | None = None) -> dict[str, DataFrame]:
    """Coverage of one state, its most frequent classes and its size bands."""
    rows = registry.filter(F.col("entidad") == state)
    known = one_row("entidad", state, [official(totals)])
    return {
        "coverage": with_status(with_single(known, rows.agg(F.count(F.lit(1)).alias("loaded")))),
        "top_classes": top_classes(rows, top),
        "sizes": size_distribution(rows),
    }


def _labelled(registry: DataFrame, scope: Column) -> DataFrame:
    rows = registry.filter(scope & F.col("colonia").isNotNull() & (F.trim("colonia") != ""))
    return rows.withColumn("colonia", label_key(F.col("colonia")))


def neighbourhoods(
    registry: DataFrame, municipality: str, order: str = "num_establecimientos", limit: int | None = None
) -> DataFrame:
    """Neighbourhood labels of a municipality."""
    counts = count_by(_labelled(registry, F.col("area_geo") == municipality), ["colonia"], "num_establecimientos")
    orders = {
        "num_establecimientos": [F.desc("num_establecimientos"), F.asc("colonia")],
        "colonia": [F.asc("colonia")],
    }
    return ranked_by(counts, order, orders, limit)


def neighbourhoods_of_tract(registry: DataFrame, tract: str, limit: int | None = None) -> DataFrame:
    """Neighbourhood labels found in a tract."""
    counts = count_by(_labelled(registry, F.col("ageb") == tract), ["colonia"], "num_establecimientos")
    return first(counts.orderBy(F.desc("num_establecimientos"), F.asc("colonia")), limit)


def neighbourhood_opportunity(
    registry: DataFrame, municipality: str, codes: list[str], order: str = "score", limit: int | None = None
) -> DataFrame:
    """Establishments per competitor in each neighbourhood of a municipality."""
    target = taxonomy_filter(codes, LEVEL_COLUMNS)
    counts = agg_where(
        _labelled(registry, F.col("area_geo") == municipality),
        ["colonia"],
        {"target_count": (target, None), "total_estab": (None, None)},
    )
    score = ratio(F.col("total_estab"), F.col("target_count"), 1, 2)
    raw = F.col("total_estab") / F.nullif(F.col("target_count"), F.lit(0))
    orders = {
        "score": [raw.desc_nulls_last(), F.asc("colonia")],
        "target_count": [F.desc("target_count"), F.asc("colonia")],
        "total_estab": [F.desc("total_estab"), F.asc("colonia")],
        "colonia": [F.asc("colonia")],
    }
    return ranked_by(counts.withColumn("score", score), order, orders, limit)


def health_cover_top(panel: DataFrame, floor: int = 0, limit: int | None = None) -> DataFrame:
    """Clinics and pharmacies per 100,000 in the most populous municipalities of a panel."""
    people = F.col("poblacion")
    top = first(panel.filter(people > floor).orderBy(people.desc(), F.asc("cve_mun")), limit)
    return top.select(
        "cve_mun",
        "poblacion",
        per_hundred_thousand(F.col("unidades_clues"), people).alias("clues_per_100k"),
        per_hundred_thousand(F.col("farmacias"), people).alias("farmacias_per_100k"),
    )


def density_against_poverty(panel: DataFrame) -> DataFrame:
    """Establishments per 1,000 beside poverty, with a marker size between 4 and 36."""
    people = F.col("poblacion")
    rows = panel.filter((people > 0) & F.col("pobreza_pct").isNotNull())
    size = F.least(F.lit(36.0), F.greatest(F.lit(4.0), F.sqrt(people / 1000.0)))
    return rows.select(
        "cve_mun",
        F.coalesce("irs_grado", F.lit(NO_GRADE)).alias("irs_grado"),
        per_thousand(F.col("establecimientos"), people).alias("densidad"),
        "pobreza_pct",
        F.round(size, 6).alias("marker_size"),
    )
