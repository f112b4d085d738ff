"""Housing finance and commercial credit per municipality and state.

Both tables hold counts (``acciones``, integers) and amounts (``monto``,
``decimal(18,2)``) with coded dimensions. State results are taken from the rows,
not from municipal results: rows without a municipality count for their state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.functions.keys import make_key
from demarca.functions.measures import MONEY, MONEY_SUM, money_ratio, ratio
from demarca.functions.text import null_tokens
from demarca.operators.aggregate import best_category, share, share_known, tier_shares
from demarca.operators.filters import valid_territory
from demarca.operators.joins import enrich, with_label

# Result columns per modality and tier code.
MODALITY_SHARES = {1: "pct_vivienda_nueva", 2: "pct_mejoramientos", 3: "pct_vivienda_usada", 4: "pct_otros"}
TIER_SHARES = {
    1: "pct_economica",
    2: "pct_popular",
    3: "pct_tradicional",
    4: "pct_media",
    5: "pct_residencial",
    6: "pct_residencial_plus",
}
FEMALE, INDIVIDUAL, INDIGENOUS, NOT_INDIGENOUS = 2, 1, 1, 2


def typed_rows(raw: DataFrame, codes: list[str], grain: str) -> DataFrame:
    """Text rows to numbers at one grain; the municipal grain drops rows without a municipality."""
    municipal = grain == "municipality"
    rows = valid_territory(raw, "cve_ent", "cve_mun" if municipal else None)
    typed = {c: null_tokens(F.trim(c), ["", "NULL"]).cast("int") for c in codes}
    typed["acciones"] = null_tokens(F.trim("acciones"), ["", "NULL"]).cast("long")
    typed["monto"] = null_tokens(F.trim("monto"), ["", "NULL"]).cast(MONEY)
    typed["cve_ent"] = F.trim("cve_ent")
    if municipal:
        typed["cve_mun"] = make_key((F.trim("cve_ent"), None), (F.trim("cve_mun"), 3))
    return rows.withColumns(typed)


def _measures() -> list[Column]:
    n = F.col("acciones")
    return [
        F.min("ano").cast("string").alias("periodo"),
        F.sum(n).alias("acciones_total"),
        F.sum("monto").cast(MONEY_SUM).alias("monto_total"),
        *[share(n, F.col("modalidad") == code).alias(name) for code, name in MODALITY_SHARES.items()],
        share_known(n, F.col("sexo") == FEMALE, F.col("sexo").isNotNull()).alias("pct_femenino"),
        *tier_shares(n, F.col("vivienda_valor"), TIER_SHARES),
    ]


def _combinations(rows: DataFrame, keys: list[str], categories: list[str]) -> DataFrame:
    """Counts per combination of the categories; all rankings of a table read this one small result."""
    return rows.groupBy(*keys, *categories).agg(F.coalesce(F.sum("acciones"), F.lit(0)).alias("acciones"))


def _top(combos: DataFrame, keys: list[str], category: str, code: str, amount: str) -> DataFrame:
    return best_category(combos, keys, category, F.sum("acciones"), (code, amount))


def _average() -> Column:
    return money_ratio(F.col("monto_total"), F.col("acciones_total"))


def _keys(grain: str) -> list[str]:
    return ["cve_mun", "cve_ent"] if grain == "municipality" else ["cve_ent"]


def finance_totals(rows: DataFrame, grain: str) -> DataFrame:
    """Totals and shares of the measures that both kinds of finance have, without leading categories."""
    return rows.groupBy(*_keys(grain)).agg(*_measures())


def housing_finance(rows: DataFrame, bodies: DataFrame, grain: str) -> DataFrame:
    """Totals, shares by modality, sex, credit type and dwelling tier, and the leading body."""
    keys = _keys(grain)
    n = F.col("acciones")
    individual = share_known(n, F.col("tipo") == INDIVIDUAL, F.col("tipo").isNotNull())
    totals = rows.groupBy(*keys).agg(*_measures(), individual.alias("pct_credito_individual"))
    top = _top(_combinations(rows, keys, ["organismo"]), keys, "organismo", "top_organismo_code", "_top")
    out = with_label(enrich(totals, [top], keys), bodies, "top_organismo_code", "nombre", "top_organismo_nombre")
    return out.withColumns(
        {
            "monto_per_accion_avg": _average(),
            "top_organismo_share": ratio(F.col("_top"), F.col("acciones_total"), 100, 2),
        }
    ).drop("_top")


def commercial_credit(rows: DataFrame, banks: DataFrame, grain: str) -> DataFrame:
    """As housing finance, with the share of indigenous borrowers and the leading bank, line and scheme."""
    keys = _keys(grain)
    n, who = F.col("acciones"), F.col("poblacion_indigena")
    indigenous = share_known(n, who == INDIGENOUS, who.isin(INDIGENOUS, NOT_INDIGENOUS))
    totals = rows.groupBy(*keys).agg(*_measures(), indigenous.alias("pct_indigena"))
    combos = _combinations(rows, keys, ["intermediario_financiero", "linea_credito", "esquema"])
    tops = [
        _top(combos, keys, "intermediario_financiero", "top_intermediario_code", "_top"),
        _top(combos, keys, "linea_credito", "top_linea_credito_code", "_line").drop("_line"),
        _top(combos, keys, "esquema", "top_esquema_code", "_scheme").drop("_scheme"),
    ]
    out = with_label(enrich(totals, tops, keys), banks, "top_intermediario_code", "nombre", "top_intermediario_nombre")
    return out.withColumns(
        {
            "monto_per_accion_avg": _average(),
            "top_intermediario_share": ratio(F.col("_top"), F.col("acciones_total"), 100, 2),
        }
    ).drop("_top")


