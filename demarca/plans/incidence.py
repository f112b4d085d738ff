"""Crime and mortality: yearly roll-ups, summaries, series, latest usable year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.functions.keys import STATE, YEAR, at_grain, is_catch_all, make_key
from demarca.functions.measures import change_percent, per_thousand
from demarca.operators.aggregate import agg_where, complete_periods, large_periods, latest_period
from demarca.operators.joins import enrich
from demarca.operators.reshape import months_to_rows
from demarca.sources.increments import Summary

# Categories counted apart, as (column, value).
CRIME_CATEGORIES = {
    "robo_negocio": ("subtipo_delito", "Robo a negocio"),
    "homicidio_doloso": ("subtipo_delito", "Homicidio doloso"),
    "extorsion": ("subtipo_delito", "Extorsión"),
    "patrimoniales": ("bien_juridico", "El patrimonio"),
    "violentos": ("bien_juridico", "La vida y la Integridad corporal"),
}
# Chapters of causes of death counted apart, and the age units below one year.
CHAPTERS = {"def_circulatorio": 9, "def_neoplasias": 2, "def_endocrinas": 4, "def_externas": 20}
INFANT_UNITS = ["1", "2", "3"]
PRIMARY_YEAR_ROWS = 100_000

Categories = dict[str, tuple[str, str]]


def crime_long(wide: DataFrame) -> DataFrame:
    """Monthly columns to rows, with a padded municipality key where the file has municipalities.

    Other columns (sex and age band of victims, say) stay as they are.
    """
    rows = wide.withColumn("ano", F.nullif(F.col("ano"), F.lit("")).cast("int"))
    if "cve_municipio" in wide.columns:
        rows = rows.withColumn("cve_mun", make_key((F.col("cve_municipio"), 5))).drop("cve_municipio")
    return months_to_rows(rows)


def _crime_measures(categories: Categories) -> dict[str, tuple[Column | None, Column | None]]:
    n = F.col("count")
    parts = {name: (F.col(c) == v, n) for name, (c, v) in categories.items()}
    return {**parts, "total_delitos": (None, n)}


def crime_yearly(long: DataFrame, categories: Categories = CRIME_CATEGORIES) -> DataFrame:
    """Stored roll-up: categories and total per municipality and year."""
    keyed = long.filter(F.length("cve_mun") == 5)
    return agg_where(keyed, ["cve_mun", "ano"], _crime_measures(categories))


#: The same roll-up, kept by change of its monthly rows' partitions.
CRIME_YEARLY = Summary(
    "crime_yearly",
    ("cve_mun", "ano"),
    lambda long, keys: agg_where(long.filter(F.length("cve_mun") == 5), keys, _crime_measures(CRIME_CATEGORIES)),
    dict.fromkeys([*CRIME_CATEGORIES, "total_delitos"], "sum"),
)


def crime_summary(
    yearly: DataFrame, census: DataFrame, state: str, current: int, baseline: int, categories: Categories
) -> DataFrame:
    """Municipalities of a state: categories, total per 1,000 and change against a baseline year."""
    rows = yearly.filter((at_grain(F.col("cve_mun"), "state") == state) & ~is_catch_all(F.col("cve_mun")))
    now = rows.filter(F.col("ano") == current).drop("ano")
    base = rows.filter(F.col("ano") == baseline).select("cve_mun", F.col("total_delitos").alias("total_baseline"))
    people = census.select("cve_mun", F.col("nom_mun").alias("municipio"), F.col("pobtot").alias("poblacion"))
    total = F.col("total_delitos")
    return enrich(now, [base, people], "cve_mun").select(
        "cve_mun",
        "municipio",
        "poblacion",
        "total_delitos",
        *categories,
        "total_baseline",
        per_thousand(total, F.col("poblacion")).alias("delitos_per_1k_pop"),
        change_percent(total, F.col("total_baseline")).alias("delitos_change_pct"),
    )


def crime_summary_live(
    long: DataFrame, census: DataFrame, state: str, current: int, baseline: int, categories: Categories
) -> DataFrame:
    """The same from monthly rows; only the two years of the state are aggregated."""
    scope = (at_grain(F.col("cve_mun"), "state") == state) & F.col("ano").isin(current, baseline)
    return crime_summary(crime_yearly(long.filter(scope), categories), census, state, current, baseline, categories)


def crime_series(long: DataFrame, municipality: str, categories: Categories) -> DataFrame:
    """Monthly series of one municipality."""
    rows = long.filter(F.col("cve_mun") == municipality)
    named = {k: v for k, v in categories.items() if v[0] == "subtipo_delito"}
    measures = _crime_measures(named)
    measures["total"] = measures.pop("total_delitos")
    return agg_where(rows, ["ano", "mes"], measures)


def latest_complete_crime_year(long: DataFrame, up_to: int) -> DataFrame:
    """Latest year in which all 12 months occur."""
    return latest_period(complete_periods(long, "ano", "mes", 12), "ano", up_to)


def resident_deaths(raw: DataFrame) -> DataFrame:
    """Deaths with a state and municipality of residence and a year of occurrence.

    The stored and the live result share this filter, so they agree on every row.
    """
    keep = (
        F.col("ent_resid").rlike(STATE)
        & F.col("mun_resid").isNotNull()
        & (F.col("mun_resid") != "999")
        & F.col("anio_ocur").rlike(YEAR)
    )
    return raw.filter(keep).select(
        make_key((F.col("ent_resid"), None), (F.col("mun_resid"), None)).alias("cve_mun"),
        F.col("anio_ocur").cast("int").alias("ano"),
        F.left("edad", F.lit(1)).isin(INFANT_UNITS).alias("infant"),
        F.nullif("capitulo", F.lit("")).cast("int").alias("chapter"),
    )


def _death_measures() -> dict[str, tuple[Column | None, Column | None]]:
    chapters = {name: (F.col("chapter") == c, None) for name, c in CHAPTERS.items()}
    return {"total_defunciones": (None, None), "def_menores_1ano": (F.col("infant"), None), **chapters}


def mortality_yearly(raw: DataFrame) -> DataFrame:
    """Stored roll-up: deaths per municipality and year."""
    return agg_where(resident_deaths(raw), ["cve_mun", "ano"], _death_measures())


def mortality_summary(yearly: DataFrame, census: DataFrame, state: str, year: int) -> DataFrame:
    """Municipalities of a state in one year, with total and infant deaths per 1,000."""
    rows = yearly.filter((at_grain(F.col("cve_mun"), "state") == state) & (F.col("ano") == year)).drop("ano")
    people = census.select("cve_mun", F.col("nom_mun").alias("municipio"), F.col("pobtot").alias("poblacion"))
    return enrich(rows, [people], "cve_mun").withColumns(
        {
            "tasa_mortalidad_per_1k": per_thousand(F.col("total_defunciones"), F.col("poblacion")),
            "tasa_infantil_per_1k": per_thousand(F.col("def_menores_1ano"), F.col("poblacion")),
        }
    )


def mortality_summary_live(raw: DataFrame, census: DataFrame, state: str, year: int) -> DataFrame:
    """The same from records."""
    scope = (F.col("ent_resid") == state) & (F.col("anio_ocur") == str(year))
    return mortality_summary(mortality_yearly(raw.filter(scope)), census, state, year)


def mortality_series(yearly: DataFrame, municipality: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Yearly series of one municipality, of all years or between two."""
    rows = yearly.filter(F.col("cve_mun") == municipality)
    rows = rows if first is None else rows.filter(F.col("ano") >= first)
    rows = rows if last is None else rows.filter(F.col("ano") <= last)
    return rows.drop("cve_mun")


def primary_mortality_year(raw: DataFrame, up_to: int, floor: int = PRIMARY_YEAR_ROWS) -> DataFrame:
    """Latest year with enough deaths to be a full release."""
    return latest_period(large_periods(resident_deaths(raw), "ano", floor), "ano", up_to)


