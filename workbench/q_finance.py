"""Housing finance, credit, traffic, health, census views and details."""

from __future__ import annotations

from pyspark.sql import functions as F

from demarca.operators import quality
from demarca.plans import census, details, finance, health, traffic
from demarca.plans.establishments import pharmacy_by_prefix
from demarca.sources.lookups import BANKS, BODIES, lookup
from demarca.sources.summaries import build_summaries
from workbench.kit import big, dbl, query, ratio
from workbench.roles import CELL, rings
from workbench.scratch import scratch_folder

CODES = "ano mes organismo modalidad tipo sexo vivienda_valor poblacion_indigena linea_credito esquema".split()
BODIES_SQL = "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in BODIES.items()) + ") bod(code, nombre)"
BANKS_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in BANKS.items()) + ") ban(code, nombre)"


def finance_rows(t, grain):
    return finance.typed_rows(t.finance_raw, CODES, grain)


def _rows_sql(grain: str) -> str:
    mun = "trim(cve_ent) || lpad(trim(cve_mun), 3, '0')" if grain == "municipality" else "NULL"
    keep = "regexp_full_match(trim(cve_ent), '0[1-9]|[12][0-9]|3[0-2]')"
    if grain == "municipality":
        keep += " AND regexp_full_match(trim(cve_mun), '[0-9]<1,3>')"
    ints = ", ".join(f"TRY_CAST(nullif({c}, '') AS BIGINT) AS {c}" for c in CODES)
    return f"""SELECT {mun} AS cve_mun, trim(cve_ent) AS cve_ent, {ints}, intermediario_financiero, CAST(acciones AS BIGINT) AS acciones,
      CAST(monto AS DECIMAL(20,2)) AS monto FROM {{finance_raw}} WHERE {keep}"""


def _finance_sql(grain: str, credit: bool) -> str:
    key = "cve_mun" if grain == "municipality" else "cve_ent"
    group = "cve_mun, cve_ent" if grain == "municipality" else "cve_ent"

    def share(cond: str, known: str = "true") -> str:
        return ratio(f"coalesce(sum(acciones) FILTER (WHERE {cond}), 0)", f"sum(acciones) FILTER (WHERE {known})", 100)

    def tops(category: str, name: str) -> str:
        return f"""(SELECT {key} AS k, {category} AS {name}, s AS {name}_n FROM (SELECT {key}, {category}, sum(acciones) AS s,
          row_number() OVER (PARTITION BY {key} ORDER BY sum(acciones) DESC, {category}) AS rk FROM r WHERE {category} IS NOT NULL GROUP BY 1, 2)
          WHERE rk = 1)"""

    tier_names = ["economica", "popular", "tradicional", "media", "residencial", "residencial_plus"]
    tiers = ", ".join(f"{share(f'vivienda_valor = {i}', 'vivienda_valor IS NOT NULL')} AS pct_{n}" for i, n in enumerate(tier_names, 1))
    modes = ["vivienda_nueva", "mejoramientos", "vivienda_usada", "otros"]
    modal = ", ".join(f"{share(f'modalidad = {i}')} AS pct_{n}" for i, n in enumerate(modes, 1))
    extra = (
        f"{share('poblacion_indigena = 1', 'poblacion_indigena IN (1, 2)')} AS pct_indigena"
        if credit
        else f"{share('tipo = 1', 'tipo IS NOT NULL')} AS pct_credito_individual"
    )
    base = f"""SELECT {group}, CAST(min(ano) AS VARCHAR) AS periodo, {big("sum(acciones)")} AS acciones_total, {dbl("sum(monto)")} AS monto_total,
      {ratio("sum(monto) * 100", "sum(acciones) * 100")} AS monto_per_accion_avg, {modal},
      {share("sexo = 2", "sexo IS NOT NULL")} AS pct_femenino, {tiers}, {extra} FROM r GROUP BY {group}"""
    if not credit:
        return f"""WITH r AS ({_rows_sql(grain)}) SELECT b.*, a.top AS top_organismo_code, bod.nombre AS top_organismo_nombre,
          {ratio("a.top_n", "b.acciones_total", 100)} AS top_organismo_share FROM ({base}) b LEFT JOIN {tops("organismo", "top")} a ON a.k = b.{key}
          LEFT JOIN {BODIES_SQL} ON bod.code = a.top"""
    return f"""WITH r AS ({_rows_sql(grain)}) SELECT b.*, a.top AS top_intermediario_code, ban.nombre AS top_intermediario_nombre,
      {ratio("a.top_n", "b.acciones_total", 100)} AS top_intermediario_share, l.line AS top_linea_credito_code, e.scheme AS top_esquema_code
      FROM ({base}) b LEFT JOIN {tops("intermediario_financiero", "top")} a ON a.k = b.{key} LEFT JOIN {tops("linea_credito", "line")} l
      ON l.k = b.{key} LEFT JOIN {tops("esquema", "scheme")} e ON e.k = b.{key} LEFT JOIN {BANKS_SQL} ON ban.code = a.top"""


@query("housing_finance_by_municipality", _finance_sql("municipality", False))
def housing_municipal(t):
    return finance.housing_finance(finance_rows(t, "municipality"), lookup(t.spark, "bodies"), "municipality")


@query("housing_finance_by_state", _finance_sql("state", False))
def housing_state(t):
    return finance.housing_finance(finance_rows(t, "state"), lookup(t.spark, "bodies"), "state")


@query("commercial_credit_by_municipality", _finance_sql("municipality", True))
def credit_municipal(t):
    return finance.commercial_credit(finance_rows(t, "municipality"), lookup(t.spark, "banks"), "municipality")


@query("commercial_credit_by_state", _finance_sql("state", True))
def credit_state(t):
    return finance.commercial_credit(finance_rows(t, "state"), lookup(t.spark, "banks"), "state")


@query(
    "finance_reconciliation",
    f"""WITH m AS ({_rows_sql("municipality")}), s AS ({_rows_sql("state")})
    SELECT 'municipality' AS source, count(*) AS rows, {big("sum(acciones)")} AS acciones, {dbl("sum(monto)")} AS monto FROM m
    UNION ALL SELECT 'state', count(*), {big("sum(acciones)")}, {dbl("sum(monto)")} FROM s""",
)
def reconciliation(t):
    parts = {g: finance_rows(t, g) for g in ("municipality", "state")}
    return quality.reconcile(parts, {"acciones": "acciones", "monto": "monto"})


@query(
    "finance_grain_difference",
    f"""WITH m AS ({_rows_sql("municipality")}), s AS ({_rows_sql("state")})
    SELECT *, acciones_coarse - acciones_detail AS acciones_difference FROM (SELECT {big("(SELECT sum(acciones) FROM m)")} AS acciones_detail,
      {big("(SELECT sum(acciones) FROM s)")} AS acciones_coarse)""",
)
def grain_difference(t):
    return quality.reconcile_difference(finance_rows(t, "municipality"), finance_rows(t, "state"), {"acciones": "acciones"})


STATIONS_SQL = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY latitud, longitud, clave, punto_generador, km, te, sc
    ORDER BY entidad, ruta NULLS LAST, tdpa, m, a, b, c2, c3, t3s2, t3s3, t3s2r4, otros, estado) AS rn FROM {stations_raw}
    WHERE latitud <> '' AND longitud <> '' AND tdpa <> '') WHERE rn = 1"""
PLACED_SQL = f"""SELECT s.ruta, s.punto_generador, CAST(tdpa AS BIGINT) AS tdpa, TRY_CAST(nullif(m, '*') AS DOUBLE) AS m, TRY_CAST(nullif(a, '*') AS BIGINT) AS a,
    CAST(b AS BIGINT) AS b, CAST(c2 AS BIGINT) + CAST(c3 AS BIGINT) + CAST(t3s2 AS BIGINT) + CAST(t3s3 AS BIGINT) + CAST(t3s2r4 AS BIGINT) AS tr,
    CAST(otros AS BIGINT) AS otros, x.cve_mun
  FROM ({STATIONS_SQL}) s LEFT JOIN {{boxes}} x ON CAST(longitud AS DOUBLE) >= x0 AND CAST(longitud AS DOUBLE) < x1
    AND CAST(latitud AS DOUBLE) >= y0 AND CAST(latitud AS DOUBLE) < y1
    AND NOT (notched AND CAST(longitud AS DOUBLE) >= xm AND CAST(latitud AS DOUBLE) >= ym)"""


def placed(t):
    return traffic.placed_stations(t.stations_raw, rings(t.boxes, notched=True), CELL)


@query("stations_placed", f"SELECT punto_generador, ruta, tdpa, cve_mun FROM ({PLACED_SQL})")
def stations_placed(t):
    return placed(t).select("punto_generador", "ruta", "tdpa", "cve_mun")


def _traffic_sql(grain: str) -> str:
    key = "cve_mun" if grain == "municipality" else "cve_ent"

    def mix(c: str) -> str:
        return ratio(f"sum(CAST({c} AS BIGINT) * tdpa)", "sum(tdpa)")

    return f"""WITH p AS (SELECT *, left(cve_mun, 2) AS cve_ent FROM ({PLACED_SQL}) WHERE cve_mun IS NOT NULL)
    SELECT g.*, coalesce(r.routes, '') AS routes_top FROM (SELECT {key}, count(*) AS station_count, {big("sum(tdpa)")} AS tdpa_total,
      max(tdpa) AS tdpa_max, {big(ratio("sum(tdpa)", "count(tdpa)", 1, 0))} AS tdpa_mean, {mix("m")} AS pct_motos, {mix("a")} AS pct_autos,
      {mix("b")} AS pct_buses, {mix("tr")} AS pct_camiones, {mix("otros")} AS pct_otros, count(DISTINCT ruta) AS route_count FROM p GROUP BY 1) g
    LEFT JOIN (SELECT {key}, array_to_string(list(ruta ORDER BY n DESC, ruta), '|') AS routes FROM (SELECT {key}, ruta, count(*) AS n,
      row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, ruta) AS rk FROM p WHERE ruta IS NOT NULL GROUP BY 1, 2) WHERE rk <= 3 GROUP BY 1) r
      ON r.{key} = g.{key}"""


@query("traffic_by_municipality", _traffic_sql("municipality"))
def traffic_municipal(t):
    return traffic.traffic(placed(t), "municipality")


@query("traffic_by_state", _traffic_sql("state"))
def traffic_state(t):
    return traffic.traffic(placed(t), "state")


FLAGGED_SQL = """SELECT *, regexp_matches(f, '\\bESTUPEFACIENTES?\\b') AS e, regexp_matches(f, '\\bPSICOTROPIC[OA]S?\\b') AS p,
    regexp_matches(f, '\\bVACUNAS?\\b') AS v, regexp_matches(f, '\\bTOXOIDES?\\b') AS x, regexp_matches(f, '\\b(SUEROS?|ANTITOXINAS?)\\b') AS s,
    regexp_matches(f, '\\bHEMODERIVADOS?\\b') AS h
  FROM (SELECT *, regexp_replace(upper(strip_accents(coalesce(lineas_autorizadas, ''))), '[^A-Z0-9 ]', ' ', 'g') AS f FROM {licences})"""
LICENCES_SQL = f"""SELECT cve_mun, count(*) AS total_licenciadas, count(*) FILTER (WHERE e) AS con_estupefacientes,
    count(*) FILTER (WHERE p) AS con_psicotropicos, count(*) FILTER (WHERE v) AS con_vacunas, count(*) FILTER (WHERE x) AS con_toxoides,
    count(*) FILTER (WHERE s) AS con_sueros_antitoxinas, count(*) FILTER (WHERE h) AS con_hemoderivados,
    count(*) FILTER (WHERE giro ILIKE 'farmacia hospitalaria') AS hospitalarias, count(*) FILTER (WHERE giro ILIKE 'botica') AS boticas,
    count(*) FILTER (WHERE giro ILIKE 'drogu%' OR giro ILIKE 'drogueria') AS droguerias
  FROM ({FLAGGED_SQL}) WHERE estatus_licencia = 'Vigente' AND regexp_full_match(cve_mun, '[0-9]<5>') GROUP BY 1"""
TRACT_LICENCES_SQL = f"""SELECT cvegeo_ageb, count(*) AS total_licenciadas, count(*) FILTER (WHERE e OR p OR v OR h) AS con_controlados
  FROM ({FLAGGED_SQL}) WHERE estatus_licencia = 'Vigente' AND regexp_full_match(cvegeo_ageb, '[0-9A-Z]<9>|[0-9A-Z]<13>') GROUP BY 1"""


def flagged(t):
    return health.flag_licences(t.licences)


@query(
    "licence_flags",
    f"""SELECT num, e AS has_estupefacientes, p AS has_psicotropicos, v AS has_vacunas, x AS has_toxoides, s AS has_sueros_antitoxinas,
    h AS has_hemoderivados FROM ({FLAGGED_SQL})""",
)
def licence_flags(t):
    return flagged(t).select("num", *health.LICENCE_COUNTS.values())


@query("licences_by_municipality", LICENCES_SQL)
def licences_municipal(t):
    return health.licences_by_municipality(flagged(t))


@query("licences_by_tract", TRACT_LICENCES_SQL)
def licences_tract(t):
    return health.licences_by_tract(flagged(t))


@query(
    "licences_of_one_municipality",
    "SELECT '21001' AS cve_mun, "
    + ", ".join(f"coalesce(CAST(sum({c}) AS BIGINT), 0) AS {c}" for c in health.MUNICIPAL_COUNTS)
    + f" FROM ({LICENCES_SQL}) WHERE cve_mun = '21001'",
)
def licences_one(t):
    return health.municipality_licences(flagged(t), "21001").select("cve_mun", *health.MUNICIPAL_COUNTS)


@query(
    "licences_of_tract_without_any",
    f"""SELECT u.k AS cvegeo_ageb, coalesce(CAST(sum(total_licenciadas) AS BIGINT), 0) AS total_licenciadas,
    coalesce(CAST(sum(con_controlados) AS BIGINT), 0) AS con_controlados FROM (SELECT '9999900019999' AS k UNION ALL
      SELECT min(cvegeo_ageb) AS k FROM ({TRACT_LICENCES_SQL})) u LEFT JOIN ({TRACT_LICENCES_SQL}) x ON x.cvegeo_ageb = u.k GROUP BY 1""",
)
def licences_none(t):
    rows = flagged(t)
    known = health.licences_by_tract(rows).agg(F.min("cvegeo_ageb")).first()[0]
    return health.tract_licences(rows, "9999900019999").unionByName(health.tract_licences(rows, known))


def _cases(cols: str) -> str:
    total = " + ".join(f"coalesce(TRY_CAST(nullif({c}, 'NULL') AS BIGINT), 0)" for c in cols.split())
    return ratio(f"sum({total})", "12", 1, 1)


@query(
    "morbidity_by_municipality_year",
    f"""SELECT clave_entidad || clave_municipio AS cve_mun, CAST(anio AS BIGINT) AS anio, {_cases("adm02 adm03")} AS casos_dm2_promedio,
      {_cases("aha02")} AS casos_hta_promedio, {_cases("aob02")} AS casos_obesidad_promedio, count(DISTINCT clues) AS clues_reportando
    FROM {{morbidity_raw}} WHERE regexp_full_match(clave_entidad, '[0-9]<2>') AND regexp_full_match(anio, '[0-9]<4>') GROUP BY 1, 2""",
)
def morbidity(t):
    return health.morbidity(t.morbidity_raw)


@query(
    "health_units_in_operation",
    """SELECT clues AS clave_clues, left(cve_mun, 2) AS entidad, cve_mun, cve_mun || '0001' AS cve_loc, CAST(NULL AS BIGINT) AS nivel_atencion,
      TRY_CAST(nullif(CASE WHEN latitud = 'sin dato' THEN '' ELSE latitud END, '') AS DOUBLE) AS lat, TRY_CAST(nullif(longitud, '') AS DOUBLE) AS lon,
      (longitud <> '' AND latitud NOT IN ('', 'sin dato')) AS has_point FROM {clinics} WHERE right(clues, 1) NOT IN ('3', '7')""",
)
def units_in_operation(t):
    closed = F.right("clues", F.lit(1)).isin("3", "7")
    raw = t.clinics.select(
        "clues",
        F.left("cve_mun", F.lit(2)).alias("clave_de_la_entidad"),
        F.right("cve_mun", F.lit(3)).alias("clave_del_municipio"),
        F.lit("0001").alias("clave_de_la_localidad"),
        F.lit("").alias("clave_nivel_atencion"),
        F.when(closed, "FUERA DE OPERACION").otherwise("EN OPERACION").alias("estatus_de_operacion"),
        F.when(F.col("latitud") == "sin dato", "").otherwise(F.col("latitud")).alias("latitud"),
        "longitud",
    )
    return health.health_units(raw)


def _n(c: str, kind: str = "BIGINT", *tokens: str) -> str:
    inner = c
    for tok in tokens or ("", "N/D"):
        inner = f"nullif({inner}, '{tok}')"
    return f"CAST({inner} AS {kind}) AS {c}"


CENSUS_NUMBERS = ", ".join(_n(c, "DOUBLE" if c == "graproes" else "BIGINT") for c in "pobtot pea graproes tvivpar vph_inter pcatolica psinder pnacent".split())


@query(
    "census_localities",
    f"""SELECT entidad || mun || loc AS cve_loc, entidad || mun AS cve_mun, entidad, mun, loc, nom_loc, nom_mun, nom_ent, {_n("tamloc")},
      CASE WHEN altitud LIKE '00-%' THEN NULL ELSE CAST(TRY_CAST(altitud AS BIGINT) AS DOUBLE) END AS altitud_m, {CENSUS_NUMBERS}
    FROM {{census_raw}} WHERE loc <> '0000' AND mun <> '000'""",
)
def census_localities(t):
    return census.census(t.census_raw, "locality")


@query(
    "census_municipalities",
    f"""SELECT entidad || mun AS cve_mun, entidad, mun, nom_mun, nom_ent, {CENSUS_NUMBERS}, {_n("pcon_disc")}
    FROM {{census_raw}} WHERE loc = '0000' AND mun <> '000'""",
)
def census_municipalities(t):
    return census.census(t.census_raw, "municipality")


@query(
    "census_states",
    f"""SELECT entidad AS cve_ent, entidad, nom_ent, {CENSUS_NUMBERS}, {_n("pcon_disc")}
    FROM {{census_raw}} WHERE loc = '0000' AND mun = '000' AND entidad <> '00'""",
)
def census_states(t):
    return census.census(t.census_raw, "state")


STAR = ", ".join(_n(c, "BIGINT", "*") for c in "pobtot pobfem pobmas tvivpar vph_inter vph_autom".split())


@query(
    "census_tracts",
    f"""SELECT entidad || mun || loc || ageb AS cvegeo, entidad, mun, loc, ageb, nom_loc, {STAR}, {_n("psinder", "BIGINT", "*")}
    FROM {{tract_raw}} WHERE mza = '000' AND ageb NOT IN ('0000', '*') AND loc NOT IN ('0000', '*') AND mun NOT IN ('000', '*')""",
)
def census_tracts(t):
    return census.tract_census(t.tract_raw)


@query(
    "census_blocks",
    f"""SELECT entidad || mun || loc || ageb AS cvegeo_ageb, entidad, mun, loc, ageb, mza, {STAR} FROM {{tract_raw}}
    WHERE mza <> '000' AND regexp_full_match(mza, '[0-9]+')""",
)
def census_blocks(t):
    return census.block_census(t.tract_raw)


@query(
    "poverty_municipal",
    """SELECT lpad(clave_municipio, 5, '0') AS cve_mun, CAST(nullif(replace(poblacion, ',', ''), '') AS BIGINT) AS poblacion,
      CAST(nullif(replace(pobreza_pob, ',', ''), 'n.d') AS BIGINT) AS pobreza_personas, CAST(pobreza_e_pob AS BIGINT) AS pobreza_extrema_personas,
      CAST(nullif(pobreza, 'n.d') AS DOUBLE) AS pobreza_pct, CAST(pobreza_e AS DOUBLE) AS pobreza_extrema_pct,
      CAST(ic_asalud AS DOUBLE) AS carencia_acceso_salud_pct FROM {poverty_raw}""",
)
def poverty_municipal(t):
    return census.poverty(t.poverty_raw)


@query(
    "social_lag_municipal",
    """SELECT cve_mun_local AS cve_mun, CAST(pob_total AS BIGINT) AS pob_total, CAST(piso_tierra AS DOUBLE) AS viv_piso_tierra_pct,
      CAST(nullif(irs_indice, 'n.d') AS DOUBLE) AS irs_indice, nullif(irs_grado, 'n.d') AS irs_grado,
      CAST(nullif(irs_lugar_nacional, 'n.d') AS BIGINT) AS irs_lugar_nacional FROM {lag_raw}""",
)
def social_lag_municipal(t):
    return census.social_lag(t.lag_raw)


@query(
    "social_lag_tract",
    """SELECT cvegeo, CAST(nullif(pobtot, '*') AS BIGINT) AS pobtot, CAST(vivpar_hab AS BIGINT) AS vivpar_hab,
      CAST(nullif(ind_sin_salud, '*') AS DOUBLE) AS ind_sin_salud, grado FROM {tract_lag_raw} WHERE grado IS NOT NULL AND grado <> 'Sin grado'""",
)
def social_lag_tract(t):
    return census.tract_lag(t.tract_lag_raw)


WELFARE_SQL = """SELECT lpad(cveent, 2, '0') AS cve_ent, entidad_etq AS nom_ent_bienestar, CAST(nullif(beneficiarios, 'N/D') AS BIGINT) AS beneficiarios,
    CAST(nullif(intervenciones, 'n.d') AS DOUBLE) AS intervenciones, CAST(nullif(dependencias, '') AS BIGINT) AS dependencias,
    CAST(padrones AS BIGINT) AS padrones, CAST(programas AS BIGINT) AS programas, periodo_cve, CAST(anio AS BIGINT) AS anio, trimestre,
    nullif(fecha, '') AS fecha FROM {welfare_raw} WHERE cveent <> 'cveent' AND cveent <> '99'"""


@query("welfare_panel", WELFARE_SQL)
def welfare_panel(t):
    return census.welfare_panel(t.welfare_raw)


@query(
    "welfare_latest",
    f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cve_ent ORDER BY fecha DESC NULLS LAST, periodo_cve) AS rn
    FROM ({WELFARE_SQL})) WHERE rn = 1""",
)
def welfare_latest(t):
    return census.welfare_latest(census.welfare_panel(t.welfare_raw), [F.asc("periodo_cve")])


ECONOMIC_SQL = """SELECT e03 || e04 AS cve_mun, e03 AS cve_ent, nullif(sector, '') AS sector, nullif(clase, '') AS clase,
    CAST(nullif(id_estrato, '') AS BIGINT) AS id_estrato, CAST(ue AS BIGINT) AS ue, CAST(h001a AS DOUBLE) AS personal_ocupado_total,
    CAST(nullif(a131a, '') AS DOUBLE) AS valor_agregado_censal_bruto FROM {economic_raw} WHERE e04 <> ''"""


@query("economic_census_rows", ECONOMIC_SQL)
def economic_rows(t):
    return census.economic_census(t.economic_raw)


@query("economic_census_totals", f"SELECT * FROM ({ECONOMIC_SQL}) WHERE sector IS NULL AND id_estrato IS NULL")
def economic_totals(t):
    return census.economic_totals(census.economic_census(t.economic_raw))


@query(
    "inclusion_municipal",
    """SELECT cve_mun, nullif(rezago_social, '*') AS rezago_social, CAST(poblacion_total AS DOUBLE) AS poblacion_total,
      CAST(nullif(sucursales_bm, '*') AS DOUBLE) AS sucursales_bm, CAST(nullif(remesas_mdd, '*') AS DOUBLE) AS remesas_mdd, periodo
    FROM {inclusion_raw} WHERE cve_mun <> '99999'""",
)
def inclusion_municipal(t):
    return census.inclusion_municipal(t.inclusion_raw)


@query(
    "inclusion_state",
    """SELECT lpad(cve_estado_num, 2, '0') AS cve_ent, CAST(poblacion_total AS DOUBLE) AS poblacion_total, CAST(nullif(seg_vida, '*') AS DOUBLE) AS seg_vida,
      nullif(ac_inf_estado, '*') AS ac_inf_estado_label, periodo FROM {inclusion_state_raw} WHERE CAST(cve_estado_num AS INT) BETWEEN 1 AND 32""",
)
def inclusion_state(t):
    return census.inclusion_state(t.inclusion_state_raw)


def wide_sources(t, state=None):
    muni = "municipality"
    totals = finance.finance_totals(finance_rows(t, muni), muni)
    return details.municipality_sources(
        t.census_municipal,
        t.registry,
        t.clinics,
        t.poverty,
        t.lag,
        census.economic_census(t.economic_raw),
        t.morbidity,
        health.licences_by_municipality(flagged(t)),
        traffic.traffic(placed(t), muni),
        totals,
        totals,
        pharmacy_by_prefix("4641"),
        state,
    )


def wide(t, state=None):
    return details.municipality_wide_from(wide_sources(t, state))


WIDE_SQL = (
    f"""WITH d AS (SELECT area_geo AS cve_mun, count(*) AS n, count(*) FILTER (WHERE clase_actividad_id LIKE '4641%') AS f FROM {{registry}} GROUP BY 1),
    c AS (SELECT cve_mun, count(*) AS n FROM {{clinics}} GROUP BY 1),
    s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cve_mun ORDER BY anio DESC) AS rn FROM {{morbidity}}) WHERE rn = 1),
    r AS ({_rows_sql("municipality")}),
    fin AS (SELECT cve_mun, sum(monto) AS monto, {big("sum(acciones)")} AS acciones,
      {ratio("coalesce(sum(acciones) FILTER (WHERE sexo = 2), 0)", "sum(acciones) FILTER (WHERE sexo IS NOT NULL)", 100)} AS fem FROM r GROUP BY 1),
    tr AS (SELECT cve_mun, {big("sum(tdpa)")} AS tdpa FROM ({PLACED_SQL}) WHERE cve_mun IS NOT NULL GROUP BY 1)
    SELECT m.cve_mun, m.nom_mun AS municipio, m.pobtot AS poblacion, m.pea, CAST(m.graproes AS DOUBLE) AS graproes, {ratio("m.pea", "m.p_15ymas", 100)} AS pct_pea,
      {ratio("m.psinder", "m.pobtot", 100)} AS pct_sin_cobertura_salud, coalesce(d.n, 0) AS establecimientos, coalesce(d.f, 0) AS farmacias,
      coalesce(c.n, 0) AS unidades_salud, {dbl("p.pobreza_pct")} AS pobreza_pct, {dbl("p.pobreza_extrema_pct")} AS pobreza_extrema_pct,
      {dbl("p.carencia_acceso_salud_pct")} AS carencia_acceso_salud_pct, {dbl("i.irs_indice")} AS irs_indice, i.irs_grado, ec.ue AS economico_ue,
      ec.personal_ocupado_total AS economico_personal_ocupado, ec.valor_agregado_censal_bruto AS economico_valor_agregado,
      {dbl("s.casos_dm2_promedio")} AS dm2_promedio, {dbl("s.casos_hta_promedio")} AS hta_promedio, {dbl("s.casos_obesidad_promedio")} AS obesidad_promedio,
      li.total_licenciadas, li.con_estupefacientes, tr.tdpa AS tdpa_total, {dbl("fin.monto")} AS credito_monto_total, fin.fem AS credito_pct_femenino,
      {dbl("fin.monto")} AS vivienda_monto_total, fin.acciones AS vivienda_acciones_total
    FROM {{census_municipal}} m LEFT JOIN d ON d.cve_mun = m.cve_mun LEFT JOIN c ON c.cve_mun = m.cve_mun LEFT JOIN {{poverty}} p ON p.cve_mun = m.cve_mun
      LEFT JOIN {{lag}} i ON i.cve_mun = m.cve_mun LEFT JOIN (SELECT * FROM ({ECONOMIC_SQL}) WHERE sector IS NULL AND id_estrato IS NULL) ec ON ec.cve_mun = m.cve_mun
      LEFT JOIN s ON s.cve_mun = m.cve_mun LEFT JOIN ({LICENCES_SQL}) li ON li.cve_mun = m.cve_mun LEFT JOIN tr ON tr.cve_mun = m.cve_mun
      LEFT JOIN fin ON fin.cve_mun = m.cve_mun"""
)


@query("municipality_wide", WIDE_SQL)
def municipality_wide(t):
    return wide(t)


@query("municipality_wide_stored", WIDE_SQL)
def municipality_wide_stored(t):
    """The same rows, from stored one-row-per-municipality sources."""
    root, sources = scratch_folder(t.spark), wide_sources(t)
    build_summaries({n: (lambda df: lambda: df)(df) for n, df in sources.items()}, root, list(sources))
    return details.municipality_wide_from({n: t.spark.read.parquet(f"{root}/{n}") for n in sources})


@query("municipality_wide_joined_stored", WIDE_SQL)
def municipality_wide_joined_stored(t):
    """The joined rows themselves, stored as a summary and read back."""
    root = scratch_folder(t.spark)
    build_summaries({"municipality_wide": lambda: wide(t)}, root, ["municipality_wide"])
    return t.spark.read.parquet(f"{root}/municipality_wide")


def municipality_flat(t):
    muni = "municipality"
    rows = finance_rows(t, muni)
    return details.unit_detail(
        "cve_mun",
        t.census_municipal,
        census.inclusion_municipal(t.inclusion_raw),
        traffic.traffic(placed(t), muni),
        finance.housing_finance(rows, lookup(t.spark, "bodies"), muni),
        finance.commercial_credit(rows, lookup(t.spark, "banks"), muni),
    )


def state_flat(t):
    rows = finance_rows(t, "state")
    states = census.census(t.census_raw, "state").groupBy("cve_ent").agg(F.max("pobtot").alias("pobtot"), F.max("psinder").alias("psinder"))
    return details.unit_detail(
        "cve_ent",
        states,
        census.inclusion_state(t.inclusion_state_raw),
        traffic.traffic(placed(t), "state"),
        finance.housing_finance(rows, lookup(t.spark, "bodies"), "state"),
        finance.commercial_credit(rows, lookup(t.spark, "banks"), "state"),
        census.welfare_latest(census.welfare_panel(t.welfare_raw), [F.asc("periodo_cve")]),
    )


@query(
    "municipality_detail",
    f"""WITH h AS ({_finance_sql("municipality", False)}), cr AS ({_finance_sql("municipality", True)}), tr AS ({_traffic_sql("municipality")})
    SELECT m.cve_mun, m.pobtot, m.psinder, x.sucursales_bm, tr.station_count IS NULL AS no_traffic, tr.pct_autos, tr.routes_top, h.acciones_total IS NULL
      AS no_housing, h.top_organismo_nombre, h.pct_economica IS NULL AS no_tiers, h.pct_media, cr.top_esquema_code, cr.pct_indigena
    FROM {{census_municipal}} m LEFT JOIN (SELECT cve_mun, CAST(nullif(sucursales_bm, '*') AS DOUBLE) AS sucursales_bm FROM {{inclusion_raw}}) x ON x.cve_mun = m.cve_mun
      LEFT JOIN tr ON tr.cve_mun = m.cve_mun LEFT JOIN h ON h.cve_mun = m.cve_mun LEFT JOIN cr ON cr.cve_mun = m.cve_mun""",
)
def municipality_detail(t):
    d = details.nest_detail(municipality_flat(t))
    return d.select(
        "cve_mun",
        F.col("population.pobtot").alias("pobtot"),
        F.col("health_coverage.psinder").alias("psinder"),
        F.col("inclusion_financiera.cp_sucursales_bm").alias("sucursales_bm"),
        F.col("datos_viales").isNull().alias("no_traffic"),
        F.col("datos_viales.sv_composition.sv_pct_autos").alias("pct_autos"),
        F.col("datos_viales.sv_routes_top").alias("routes_top"),
        F.col("vivienda_financiamientos").isNull().alias("no_housing"),
        F.col("vivienda_financiamientos.sf_top_organismo_nombre").alias("top_organismo_nombre"),
        F.col("vivienda_financiamientos.sf_tiers").isNull().alias("no_tiers"),
        F.col("vivienda_financiamientos.sf_tiers.sf_pct_media").alias("pct_media"),
        F.col("vivienda_credito_comercial.cc_top_esquema_code").alias("top_esquema_code"),
        F.col("vivienda_credito_comercial.cc_pct_indigena").alias("pct_indigena"),
    )


@query(
    "state_detail",
    f"""WITH h AS ({_finance_sql("state", False)}), tr AS ({_traffic_sql("state")})
    SELECT m.cve_ent, m.pobtot, x.seg_vida, tr.tdpa_total, h.monto_total, w.periodo_cve, w.fecha
    FROM (SELECT entidad AS cve_ent, max(CAST(pobtot AS BIGINT)) AS pobtot FROM {{census_raw}} WHERE loc = '0000' AND mun = '000' AND entidad <> '00' GROUP BY 1) m
      LEFT JOIN (SELECT lpad(cve_estado_num, 2, '0') AS cve_ent, CAST(nullif(seg_vida, '*') AS DOUBLE) AS seg_vida FROM {{inclusion_state_raw}}
        WHERE CAST(cve_estado_num AS INT) BETWEEN 1 AND 32) x ON x.cve_ent = m.cve_ent
      LEFT JOIN tr ON tr.cve_ent = m.cve_ent LEFT JOIN h ON h.cve_ent = m.cve_ent
      LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cve_ent ORDER BY fecha DESC NULLS LAST, periodo_cve) AS rn FROM ({WELFARE_SQL})) w
        ON w.cve_ent = m.cve_ent AND w.rn = 1""",
)
def state_detail(t):
    d = details.nest_detail(state_flat(t))
    return d.select(
        "cve_ent",
        F.col("population.pobtot").alias("pobtot"),
        F.col("inclusion_financiera.cp_seg_vida").alias("seg_vida"),
        F.col("datos_viales.sv_tdpa_total").alias("tdpa_total"),
        F.col("vivienda_financiamientos.sf_monto_total").alias("monto_total"),
        F.col("bienestar_latest.bl_periodo_cve").alias("periodo_cve"),
        F.col("bienestar_latest.bl_fecha").alias("fecha"),
    )


@query(
    "locality_detail",
    """SELECT entidad || mun || loc AS cve_loc, nom_loc, CAST(pobtot AS BIGINT) AS pobtot, CAST(pcatolica AS BIGINT) AS pcatolica,
      CAST(nullif(vph_inter, 'N/D') AS BIGINT) AS vph_inter FROM {census_raw} WHERE entidad || mun || loc = (SELECT min(entidad || mun || loc)
      FROM {census_raw} WHERE loc <> '0000' AND mun <> '000')""",
)
def locality_detail(t):
    rows = census.census(t.census_raw, "locality")
    first = rows.agg(F.min("cve_loc")).scalar()
    d = details.locality_detail(rows, first)
    return d.select(
        "cve_loc",
        "nom_loc",
        F.col("population.pobtot").alias("pobtot"),
        F.col("religion.pcatolica").alias("pcatolica"),
        F.col("assets.vph_inter").alias("vph_inter"),
    )
