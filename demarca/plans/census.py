"""Typed views of census, poverty, welfare, economic-census and inclusion tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.functions.keys import make_key, pad
from demarca.functions.measures import GRADES
from demarca.functions.text import guarded_number, null_tokens, strip_thousands, typed
from demarca.operators.filters import select_grain, select_tract_grain, totals_only
from demarca.operators.ordered import latest_per_key
from demarca.sources.contracts import (
    INCLUSION_MUNICIPAL_NUMBERS,
    INCLUSION_STATE_LABELS,
    INCLUSION_STATE_NUMBERS,
)

LOCALITY_MISSING = ["", "N/D"]
TRACT_MISSING = ["*"]
POVERTY_MISSING = ["n.d"]
WELFARE_MISSING = ["", "N/D", "n.d"]
INCLUSION_MISSING = ["*"]
INCLUSION_CATCH_ALL = "99999"

# Census measures by theme.
CENSUS_GROUPS = {
    "population": "pobtot pobfem pobmas p_60ymas p_15ymas p_18ymas pea pocupada graproes tvivhab tvivpar".split(),
    "religion": "pcatolica pro_crieva potras_rel psin_relig".split(),
    "indigenous_afro": "p3ym_hli p3hlinhe p3hli_he phog_ind pob_afro".split(),
    "migration": "pnacent pnacoe pres2015 presoe15".split(),
    "education": "p15ym_an p15ym_se p15pri_in p15pri_co p15sec_in p15sec_co p18ym_pb".split(),
    "civil_status": "p12ym_solt p12ym_casa p12ym_sepa".split(),
    "disability": "pcon_disc pcon_limi psind_lim".split(),
    "health_coverage": "psinder pder_ss pder_imss pder_iste pder_segp pder_imssb pafil_ipriv".split(),
    "assets": (
        "vph_inter vph_autom vph_refri vph_lavad vph_hmicro vph_moto vph_bici vph_radio vph_tv vph_pc vph_telef "
        "vph_cel vph_stvp vph_spmvpi vph_cvj vph_snbien"
    ).split(),
}
#: Measures that only exist from the municipality up.
NOT_AT_LOCALITY = (
    "p15pri_in p15pri_co p15sec_in p15sec_co p12ym_solt p12ym_casa p12ym_sepa pcon_disc pcon_limi psind_lim "
    "vph_hmicro vph_moto vph_bici vph_radio vph_telef vph_stvp vph_spmvpi vph_cvj"
).split()
TRACT_MEASURES = (
    "pobtot pobfem pobmas p_60ymas p_15ymas p_18ymas pea pocupada graproes tvivhab tvivpar vph_inter vph_autom pder_ss "
    "pder_imss pder_imssb pder_iste pder_istee pder_segp pafil_ipriv psinder"
).split()
BLOCK_MEASURES = "pobtot pobfem pobmas tvivpar vph_inter vph_autom".split()
DECIMALS = {"graproes": "decimal(9,2)"}


def _measures(df: DataFrame, names: list[str], missing: list[str]) -> list[Column]:
    present = [c for c in names if c in df.columns]
    return [typed(F.col(c), missing, DECIMALS.get(c, "long")).alias(c) for c in present]


def census(raw: DataFrame, grain: str) -> DataFrame:
    """States, municipalities or localities of the locality census."""
    rows = select_grain(raw, grain)
    names = [c for cols in CENSUS_GROUPS.values() for c in cols]
    state = pad(F.col("entidad"), 2)
    mun = make_key((F.col("entidad"), 2), (F.col("mun"), 3))
    if grain == "state":
        ids = [state.alias("cve_ent"), "entidad", "nom_ent"]
    elif grain == "municipality":
        ids = [mun.alias("cve_mun"), "entidad", "mun", "nom_mun", "nom_ent"]
    else:
        names = [c for c in names if c not in NOT_AT_LOCALITY]
        ids = [
            make_key((F.col("entidad"), 2), (F.col("mun"), 3), (F.col("loc"), 4)).alias("cve_loc"),
            mun.alias("cve_mun"),
            "entidad",
            "mun",
            "loc",
            "nom_loc",
            "nom_mun",
            "nom_ent",
            typed(F.col("tamloc"), LOCALITY_MISSING, "int").alias("tamloc"),
            guarded_number(F.col("altitud"), "decimal(9,2)").alias("altitud_m"),
        ]
    return rows.select(*ids, *_measures(rows, names, LOCALITY_MISSING))


def with_tract_key(raw: DataFrame) -> DataFrame:
    """The tract key stored beside the raw row."""
    return raw.withColumn("cvegeo", F.concat("entidad", "mun", "loc", "ageb"))


def tract_census(raw: DataFrame) -> DataFrame:
    """Tract totals of the tract census."""
    rows = select_tract_grain(with_tract_key(raw), "tract")
    return rows.select(
        "cvegeo", "entidad", "mun", "loc", "ageb", "nom_loc", *_measures(rows, TRACT_MEASURES, TRACT_MISSING)
    )


def block_census(raw: DataFrame) -> DataFrame:
    """Blocks of the tract census."""
    rows = select_tract_grain(with_tract_key(raw), "block").withColumnRenamed("cvegeo", "cvegeo_ageb")
    return rows.select(
        "cvegeo_ageb", "entidad", "mun", "loc", "ageb", "mza", *_measures(rows, BLOCK_MEASURES, TRACT_MISSING)
    )


# Poverty measures, result name to file column.
POVERTY_RATES = {
    "pobreza_pct": "pobreza",
    "pobreza_extrema_pct": "pobreza_e",
    "pobreza_moderada_pct": "pobreza_m",
    "vulnerable_carencias_pct": "vul_car",
    "vulnerable_ingreso_pct": "vul_ing",
    "no_pobre_no_vul_pct": "npnv",
    "carencia_rezago_edu_pct": "ic_rezedu",
    "carencia_acceso_salud_pct": "ic_asalud",
    "carencia_seg_social_pct": "ic_segsoc",
    "carencia_calidad_vivienda_pct": "ic_cv",
    "carencia_serv_basicos_pct": "ic_sbv",
    "carencia_alimentacion_pct": "ic_ali",
    "pob_lp_ingreso_pct": "plp",
}
POVERTY_COUNTS = {
    "poblacion": "poblacion",
    "pobreza_personas": "pobreza_pob",
    "pobreza_extrema_personas": "pobreza_e_pob",
}
LAG_RATES = {
    "analfabeta_15ymas_pct": "analfabeta_15ymas",
    "no_asisten_escuela_6a14_pct": "no_asisten_6a14",
    "edu_basica_incompleta_pct": "edu_basica_incompleta_15ymas",
    "sin_derechohab_salud_pct": "sin_derechohab_salud",
    "viv_piso_tierra_pct": "piso_tierra",
    "viv_sin_excusado_pct": "sin_excusado",
    "viv_sin_agua_pct": "sin_agua",
    "viv_sin_drenaje_pct": "sin_drenaje",
    "viv_sin_electricidad_pct": "sin_electricidad",
    "viv_sin_refrigerador_pct": "sin_refrigerador",
    "viv_sin_lavadora_pct": "sin_lavadora",
}
RATE = "decimal(12,4)"


def poverty(raw: DataFrame) -> DataFrame:
    """Municipal poverty: thousands separators and missing marks removed."""
    counts = [
        null_tokens(strip_thousands(F.col(src)), ["", *POVERTY_MISSING]).cast("long").alias(n)
        for n, src in POVERTY_COUNTS.items()
    ]
    rates = [typed(F.col(src), POVERTY_MISSING, RATE).alias(n) for n, src in POVERTY_RATES.items() if src in raw.columns]
    names = [c for c in ("clave_entidad", "entidad_federativa", "municipio") if c in raw.columns]
    return raw.select(pad(F.col("clave_municipio"), 5).alias("cve_mun"), *names, *counts, *rates)


def social_lag(raw: DataFrame) -> DataFrame:
    """Municipal social lag."""
    rates = [F.col(src).cast(RATE).alias(n) for n, src in LAG_RATES.items() if src in raw.columns]
    return raw.select(
        F.col("cve_mun_local").alias("cve_mun"),
        F.col("pob_total").cast("long").alias("pob_total"),
        *rates,
        typed(F.col("irs_indice"), POVERTY_MISSING, RATE).alias("irs_indice"),
        null_tokens(F.col("irs_grado"), POVERTY_MISSING).alias("irs_grado"),
        typed(F.col("irs_lugar_nacional"), POVERTY_MISSING, "int").alias("irs_lugar_nacional"),
    )


def tract_lag(raw: DataFrame) -> DataFrame:
    """Tract social lag; rows outside the five grades are dropped."""
    numbers = [typed(F.col(c), TRACT_MISSING, "long").alias(c) for c in ("pobtot", "vivpar_hab") if c in raw.columns]
    rates = [typed(F.col(c), TRACT_MISSING, RATE).alias(c) for c in raw.columns if c.startswith("ind_")]
    return raw.filter(F.col("grado").isin(GRADES)).select("cvegeo", *numbers, *rates, "grado")


def welfare_panel(raw: DataFrame) -> DataFrame:
    """State programmes per quarter; the national code 99 is left out."""
    kinds = {
        "beneficiarios": "long",
        "intervenciones": "decimal(20,2)",
        "dependencias": "int",
        "padrones": "int",
        "programas": "int",
    }
    rows = raw.filter(F.col("cveent").rlike("^[0-9]+$")).filter(F.col("cveent").cast("int") != 99)
    return rows.select(
        pad(F.col("cveent"), 2).alias("cve_ent"),
        F.col("entidad_etq").alias("nom_ent_bienestar"),
        *[typed(F.col(c), WELFARE_MISSING, t).alias(c) for c, t in kinds.items()],
        "periodo_cve",
        F.nullif("anio", F.lit("")).cast("int").alias("anio"),
        "trimestre",
        F.nullif("fecha", F.lit("")).cast("date").alias("fecha"),
    )


def welfare_latest(panel: DataFrame, ties: list[Column] | None = None) -> DataFrame:
    """Latest quarter of each state."""
    return latest_per_key(panel, ["cve_ent"], [F.desc_nulls_last("fecha"), *(ties or [])])


# Economic-census measures, result name to file column.
ECONOMIC_MEASURES = {
    "personal_ocupado_total": "h001a",
    "personal_dependiente": "h000a",
    "personal_remunerado": "h010a",
    "personal_no_remunerado": "h020a",
    "horas_trabajadas": "i000a",
    "remuneraciones": "j000a",
    "produccion_bruta_total": "a111a",
    "consumo_intermedio": "a121a",
    "valor_agregado_censal_bruto": "a131a",
    "inversion_total": "a211a",
    "formacion_bruta_capital_fijo": "a221a",
    "margen_reventa": "a511a",
    "gastos_totales": "a700a",
    "ingresos_totales": "a800a",
    "gastos_operacion": "k000a",
    "ingresos_suministro": "m000a",
}
ECONOMIC_DIMS = ["sector", "subsector", "rama", "subrama", "clase"]


def economic_census(raw: DataFrame) -> DataFrame:
    """Municipal rows, detail and totals alike; blank dimensions become NULL."""

    def blank(c: str) -> Column:
        return F.nullif(c, F.lit(""))

    rows = raw.filter((F.col("e03") != "") & (F.col("e04") != ""))
    return rows.select(
        F.concat("e03", "e04").alias("cve_mun"),
        F.col("e03").alias("cve_ent"),
        *[blank(c).alias(c) for c in ECONOMIC_DIMS if c in raw.columns],
        blank("id_estrato").cast("int").alias("id_estrato"),
        blank("ue").cast("long").alias("ue"),
        *[blank(src).cast("decimal(20,3)").alias(n) for n, src in ECONOMIC_MEASURES.items() if src in raw.columns],
    )


def economic_totals(typed_rows: DataFrame) -> DataFrame:
    """The source's own totals over all sectors and sizes."""
    return totals_only(typed_rows, ["sector", "id_estrato"])


NUMBER = "decimal(28,6)"


def inclusion_municipal(raw: DataFrame) -> DataFrame:
    """Municipal financial inclusion without the catch-all municipality."""
    numbers = [c for c in INCLUSION_MUNICIPAL_NUMBERS if c in raw.columns]
    return raw.filter(F.col("cve_mun").rlike("^[0-9]{5}$") & (F.col("cve_mun") != INCLUSION_CATCH_ALL)).select(
        "cve_mun",
        null_tokens(F.col("rezago_social"), INCLUSION_MISSING).alias("rezago_social"),
        *[typed(F.col(c), INCLUSION_MISSING, NUMBER).alias(c) for c in numbers],
        "periodo",
    )


def inclusion_state(raw: DataFrame) -> DataFrame:
    """State financial inclusion, states 1 to 32."""
    numbers = [c for c in INCLUSION_STATE_NUMBERS if c in raw.columns]
    labels = [c for c in INCLUSION_STATE_LABELS if c in raw.columns]
    code = F.col("cve_estado_num")
    return raw.filter(code.rlike("^[0-9]+$")).filter(code.cast("int").between(1, 32)).select(
        pad(code, 2).alias("cve_ent"),
        *[typed(F.col(c), INCLUSION_MISSING, NUMBER).alias(c) for c in numbers],
        *[null_tokens(F.col(c), INCLUSION_MISSING).alias(f"{c}_label") for c in labels],
        "periodo",
    )
