"""Licensed pharmacies, morbidity and health units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demarca.functions.keys import TRACT, YEAR, make_key
from demarca.functions.measures import ratio
from demarca.functions.text import LICENCE_PATTERNS, class_flags, null_tokens
from demarca.operators.aggregate import agg_where, numbered_columns, row_sum
from demarca.operators.reshape import zero_row
from demarca.operators.spatial import with_point

# Licence status counted, and the flags of controlled goods.
VALID_LICENCE = "Vigente"
LICENCE_COUNTS = {
    "con_estupefacientes": "has_estupefacientes",
    "con_psicotropicos": "has_psicotropicos",
    "con_vacunas": "has_vacunas",
    "con_toxoides": "has_toxoides",
    "con_sueros_antitoxinas": "has_sueros_antitoxinas",
    "con_hemoderivados": "has_hemoderivados",
}
CONTROLLED = ["has_estupefacientes", "has_psicotropicos", "has_vacunas", "has_hemoderivados"]
MUNICIPAL_COUNTS = ["total_licenciadas", *LICENCE_COUNTS, "hospitalarias", "boticas", "droguerias"]
TRACT_COUNTS = ["total_licenciadas", "con_controlados"]
# Case columns are a prefix and two digits.
DISEASES = {"casos_dm2_promedio": "adm", "casos_hta_promedio": "aha", "casos_obesidad_promedio": "aob"}
IN_OPERATION = "EN OPERACION"


def flag_licences(df: DataFrame, text: str = "lineas_autorizadas") -> DataFrame:
    """Six flags read from the authorised lines."""
    return df.withColumns(class_flags(F.col(text), LICENCE_PATTERNS))


def licences_by_municipality(licences: DataFrame) -> DataFrame:
    """Valid licences per municipality, by class of goods and kind of shop."""
    kind = F.lower("giro")
    rows = licences.filter((F.col("estatus_licencia") == VALID_LICENCE) & F.col("cve_mun").rlike("^[0-9]{5}$"))
    return agg_where(
        rows,
        ["cve_mun"],
        {
            "total_licenciadas": (None, None),
            **{name: (F.col(flag), None) for name, flag in LICENCE_COUNTS.items()},
            "hospitalarias": (kind == "farmacia hospitalaria", None),
            "boticas": (kind == "botica", None),
            "droguerias": ((kind == "drogueria") | F.startswith(kind, F.lit("drogu")), None),
        },
    )


def licences_by_tract(licences: DataFrame) -> DataFrame:
    """Valid licences per tract and those for any controlled class."""
    rows = licences.filter((F.col("estatus_licencia") == VALID_LICENCE) & F.col("cvegeo_ageb").rlike(TRACT))
    controlled = F.greatest(*[F.col(c) for c in CONTROLLED])
    return agg_where(rows, ["cvegeo_ageb"], {"total_licenciadas": (None, None), "con_controlados": (controlled, None)})


def municipality_licences(licences: DataFrame, municipality: str) -> DataFrame:
    """Counts of one municipality, zeros when it has none."""
    here = licences.filter(F.col("cve_mun") == municipality)
    return zero_row(licences_by_municipality(here), "cve_mun", municipality, MUNICIPAL_COUNTS)


def tract_licences(licences: DataFrame, tract: str) -> DataFrame:
    """Counts of one tract, zeros when it has none."""
    here = licences.filter(F.col("cvegeo_ageb") == tract)
    return zero_row(licences_by_tract(here), "cvegeo_ageb", tract, TRACT_COUNTS)


def morbidity(raw: DataFrame) -> DataFrame:
    """Monthly mean cases of three diseases and reporting units per municipality and year."""
    keep = (
        F.col("clave_entidad").rlike("^[0-9]{2}$")
        & F.col("clave_municipio").rlike("^[0-9]{3}$")
        & F.col("anio").rlike(YEAR)
    )
    means = [
        ratio(F.sum(row_sum(numbered_columns(raw.columns, prefix))), F.lit(12), 1, 1).alias(name)
        for name, prefix in DISEASES.items()
    ]
    key = make_key((F.col("clave_entidad"), None), (F.col("clave_municipio"), None))
    return (
        raw.filter(keep)
        .groupBy(key.alias("cve_mun"), F.col("anio").cast("int").alias("anio"))
        .agg(*means, F.count_distinct("clues").alias("clues_reportando"))
    )


def health_units(raw: DataFrame) -> DataFrame:
    """Units in operation with keys and position."""
    ent, mun, loc = (F.col(c) for c in ("clave_de_la_entidad", "clave_del_municipio", "clave_de_la_localidad"))
    typed = raw.filter(F.col("estatus_de_operacion") == IN_OPERATION).select(
        F.col("clues").alias("clave_clues"),
        ent.alias("entidad"),
        F.concat(ent, mun).alias("cve_mun"),
        F.concat(ent, mun, loc).alias("cve_loc"),
        null_tokens(F.col("clave_nivel_atencion"), [""]).cast("int").alias("nivel_atencion"),
        null_tokens(F.col("latitud"), [""]).cast("double").alias("lat"),
        null_tokens(F.col("longitud"), [""]).cast("double").alias("lon"),
    )
    return with_point(typed, "lon", "lat")
