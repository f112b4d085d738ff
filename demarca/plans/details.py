"""Wide and nested rows that bring many sources together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.functions.keys import at_grain
from demarca.functions.measures import ratio_positive
from demarca.operators.aggregate import agg_where, count_by
from demarca.operators.joins import enrich
from demarca.operators.reshape import any_known, nest
from demarca.plans.census import CENSUS_GROUPS, economic_totals
from demarca.plans.finance import MODALITY_SHARES, TIER_SHARES

TRAFFIC_MIX = ["pct_motos", "pct_autos", "pct_buses", "pct_camiones", "pct_otros"]


def _in_state(df: DataFrame, key: str, state: str | None) -> DataFrame:
    return df.filter(at_grain(F.col(key), "state") == state) if state else df


def municipality_wide(
    census: DataFrame,
    registry: DataFrame,
    clinics: DataFrame,
    poverty: DataFrame,
    lag: DataFrame,
    economic: DataFrame,
    morbidity: DataFrame,
    licences: DataFrame,
    traffic: DataFrame,
    credit: DataFrame,
    housing: DataFrame,
    pharmacy: Column,
    state: str | None = None,
) -> DataFrame:
    """One row per municipality with measures of ten sources on the census spine."""
    sources = municipality_sources(
        census, registry, clinics, poverty, lag, economic, morbidity, licences, traffic, credit, housing, pharmacy, state
    )
    return municipality_wide_from(sources)


def municipality_wide_from(sources: dict[str, DataFrame]) -> DataFrame:
    """The wide row from ``municipality_sources``, live or stored."""
    spine, *measures = sources.values()
    return enrich(spine, measures, "cve_mun").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("establecimientos", "farmacias", "unidades_salud")}
    )


def municipality_sources(
    census: DataFrame,
    registry: DataFrame,
    clinics: DataFrame,
    poverty: DataFrame,
    lag: DataFrame,
    economic: DataFrame,
    morbidity: DataFrame,
    licences: DataFrame,
    traffic: DataFrame,
    credit: DataFrame,
    housing: DataFrame,
    pharmacy: Column,
    state: str | None = None,
) -> dict[str, DataFrame]:
    """The census spine, then ten sources with one row per municipality each, by name.

    Sources with several periods give their latest (a missing period counts as latest, as
    in the published result). Each is small enough to be stored and joined many times.
    """
    rows = _in_state(registry.withColumnRenamed("area_geo", "cve_mun").filter(F.col("cve_mun").isNotNull()), "cve_mun", state)
    counts = agg_where(rows, ["cve_mun"], {"establecimientos": (None, None), "farmacias": (pharmacy, None)})
    units = count_by(_in_state(clinics, "cve_mun", state), ["cve_mun"], "unidades_salud")

    def latest(df: DataFrame, period: str, columns: dict[str, str]) -> DataFrame:
        values = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
        order = F.struct(F.col(period).isNull().alias("open"), F.col(period).alias("period"))
        newest = _in_state(df, "cve_mun", state).groupBy("cve_mun").agg(F.max_by(values, order).alias("_newest"))
        return newest.select("cve_mun", *[F.col(f"_newest.{n}") for n in columns])

    people, adults = F.col("pobtot"), F.col("p_15ymas")
    spine = _in_state(census, "cve_mun", state).select(
        "cve_mun",
        F.col("nom_mun").alias("municipio"),
        people.alias("poblacion"),
        "pea",
        "graproes",
        ratio_positive(F.col("pea"), adults, 100, 2).alias("pct_pea"),
        ratio_positive(F.col("psinder"), people, 100, 2).alias("pct_sin_cobertura_salud"),
    )
    totals = economic_totals(economic).select(
        "cve_mun",
        F.col("ue").alias("economico_ue"),
        F.col("personal_ocupado_total").alias("economico_personal_ocupado"),
        F.col("valor_agregado_censal_bruto").alias("economico_valor_agregado"),
    )
    disease = {
        "dm2_promedio": "casos_dm2_promedio",
        "hta_promedio": "casos_hta_promedio",
        "obesidad_promedio": "casos_obesidad_promedio",
    }
    return {
        "spine": spine,
        "registry": counts,
        "clinics": units,
        "poverty": poverty.select("cve_mun", "pobreza_pct", "pobreza_extrema_pct", "carencia_acceso_salud_pct"),
        "lag": lag.select("cve_mun", "irs_indice", "irs_grado"),
        "economic": totals,
        "morbidity": latest(morbidity, "anio", disease),
        "licences": licences.select("cve_mun", "total_licenciadas", "con_estupefacientes"),
        "traffic": traffic.select("cve_mun", "tdpa_total"),
        "credit": latest(
            credit, "periodo", {"credito_monto_total": "monto_total", "credito_pct_femenino": "pct_femenino"}
        ),
        "housing": latest(
            housing, "periodo", {"vivienda_monto_total": "monto_total", "vivienda_acciones_total": "acciones_total"}
        ),
    }


def _prefixed(df: DataFrame, key: str, prefix: str, columns: list[str]) -> DataFrame:
    return df.select(key, *[F.col(c).alias(f"{prefix}{c}") for c in columns if c in df.columns])


def _finance_columns(extra: list[str]) -> list[str]:
    return [
        "periodo",
        "acciones_total",
        "monto_total",
        "monto_per_accion_avg",
        *extra,
        *MODALITY_SHARES.values(),
        "pct_femenino",
        *TIER_SHARES.values(),
    ]


HOUSING_COLUMNS = _finance_columns(
    ["top_organismo_code", "top_organismo_nombre", "top_organismo_share", "pct_credito_individual"]
)
CREDIT_COLUMNS = _finance_columns(
    [
        "top_intermediario_code",
        "top_intermediario_nombre",
        "top_intermediario_share",
        "top_linea_credito_code",
        "top_esquema_code",
        "pct_indigena",
    ]
)
TRAFFIC_COLUMNS = ["station_count", "tdpa_total", "tdpa_max", "tdpa_mean", *TRAFFIC_MIX, "route_count", "routes_top"]
WELFARE_COLUMNS = "periodo_cve anio trimestre fecha beneficiarios intervenciones dependencias padrones programas".split()


def _blocks(flat: DataFrame, prefixes: dict[str, tuple[str, str]]) -> tuple[dict, dict]:
    """Groups and markers of the joined blocks: ``name -> (prefix, marker column)``."""
    groups = {n: [c for c in flat.columns if c.startswith(p)] for n, (p, _) in prefixes.items()}
    markers = {n: F.col(f"{p}{m}").isNotNull() for n, (p, m) in prefixes.items() if m}
    return groups, markers


def unit_detail(
    key: str,
    census: DataFrame,
    inclusion: DataFrame,
    traffic: DataFrame,
    housing: DataFrame,
    credit: DataFrame,
    welfare: DataFrame | None = None,
) -> DataFrame:
    """Flat detail of municipalities (or states, with welfare) from all sources, with prefixed columns."""
    numbers = [c for c in inclusion.columns if c not in (key, "periodo")]
    tables = [
        _prefixed(inclusion, key, "cp_", numbers),
        _prefixed(traffic, key, "sv_", TRAFFIC_COLUMNS),
        _prefixed(housing, key, "sf_", HOUSING_COLUMNS),
        _prefixed(credit, key, "cc_", CREDIT_COLUMNS),
    ]
    if welfare is not None:
        tables.append(_prefixed(welfare, key, "bl_", WELFARE_COLUMNS))
    return enrich(census, tables, key)


def nest_detail(flat: DataFrame) -> DataFrame:
    """Nested form: nine census groups and one block per source.

    A block is NULL when its source has no row, and the dwelling tiers are NULL when
    no tier is known.
    """
    groups = {n: [c for c in cols if c in flat.columns] for n, cols in CENSUS_GROUPS.items()}
    groups = {n: cols for n, cols in groups.items() if cols}
    out = flat
    for prefix in ("sf_", "cc_"):
        tiers = [f"{prefix}{c}" for c in TIER_SHARES.values()]
        if all(c in out.columns for c in tiers):
            out = nest(out, {f"{prefix}tiers": tiers}, {f"{prefix}tiers": any_known(*tiers)})
    mix = [f"sv_{c}" for c in TRAFFIC_MIX]
    out = nest(out, {"sv_composition": mix})
    prefixes = {
        "inclusion_financiera": ("cp_", ""),
        "datos_viales": ("sv_", "station_count"),
        "vivienda_financiamientos": ("sf_", "acciones_total"),
        "vivienda_credito_comercial": ("cc_", "acciones_total"),
    }
    if any(c.startswith("bl_") for c in out.columns):
        prefixes["bienestar_latest"] = ("bl_", "periodo_cve")
    more, markers = _blocks(out, prefixes)
    return nest(out, {**groups, **more}, markers)


def locality_detail(localities: DataFrame, locality: str) -> DataFrame:
    """Nested census groups of one locality."""
    groups = {n: [c for c in cols if c in localities.columns] for n, cols in CENSUS_GROUPS.items()}
    return nest(localities.filter(F.col("cve_loc") == locality), {n: c for n, c in groups.items() if c})
