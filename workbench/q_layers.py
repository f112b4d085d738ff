"""Joins, map layers, explorer measures, indices, and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from demarca.functions.measures import ordinal
from demarca.operators import aggregate, filters, joins, layers, ordered
from demarca.plans import finance, health, incidence, indices, traffic
from demarca.plans.establishments import pharmacy_by_prefix
from demarca.sources import delimited, registry, sinks
from demarca.sources.lookups import AIRPORTS, DESTINATIONS, MODALITIES, TIERS, lookup
from workbench.kit import query, ratio
from workbench.q_finance import LICENCES_SQL, PLACED_SQL, TRACT_LICENCES_SQL, _rows_sql, flagged, finance_rows, placed, wide
from workbench.q_incidence import DEATHS_SQL
from workbench.scratch import scratch_folder


@query(
    "units_with_measures",
    """SELECT c.c_custkey, o.n, e.clicks FROM {customer} c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY 1) o ON o.o_custkey = c.c_custkey
    LEFT JOIN (SELECT user_id, count(*) AS clicks FROM {events} WHERE event_type = 'click' GROUP BY 1) e ON e.user_id = c.c_custkey""",
)
def units_with_measures(t):
    spine = t.customer.select("c_custkey")
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    clicks = (
        t.events.filter(F.col("event_type") == "click")
        .groupBy(F.col("user_id").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("clicks"))
    )
    return joins.enrich(spine, [n, clicks], "c_custkey")


@query(
    "joined_on_label",
    """SELECT m.airport_name, x.cve_mun, count(*) AS n FROM {movements} m JOIN {airport_crosswalk} x ON upper(trim(m.airport_name)) = upper(trim(x.airport_name))
    GROUP BY 1, 2""",
)
def joined_on_label(t):
    counts = t.movements.groupBy("airport_name").agg(F.count(F.lit(1)).alias("n"))
    return joins.join_on_label(counts, t.airport_crosswalk, "airport_name").select("airport_name", "cve_mun", "n")


@query(
    "latest_inner_row",
    """SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM {customer} c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey
      ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM {orders}) o ON o.o_custkey = c.c_custkey AND o.rn = 1""",
)
def latest_inner(t):
    inner = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", "o_totalprice")
    out = joins.latest_join(
        t.customer.select("c_custkey"), inner, "c_custkey", [F.desc_nulls_last("o_orderdate"), F.asc("o_orderkey")]
    )
    return out.select("c_custkey", "o_orderkey", "o_totalprice")


@query(
    "one_row_from_two_sides",
    """SELECT 'S1' AS unit, (SELECT count(*) FROM {lineitem} WHERE l_suppkey = 1) AS lines, CAST(NULL AS BIGINT) AS orders
    UNION ALL SELECT 'C1' AS unit, CAST(NULL AS BIGINT) AS lines, nullif((SELECT count(*) FROM {orders} WHERE o_custkey = 1), 0) AS orders""",
)
def one_row(t):
    lines = t.lineitem.groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("unit")).agg(
        F.count(F.lit(1)).alias("lines")
    )
    other = t.orders.groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("unit")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    return joins.one_row("unit", "S1", [lines, other]).unionByName(joins.one_row("unit", "C1", [lines, other]))


@query(
    "parent_value_on_children",
    """SELECT c.cvegeo, m.anio, CAST(m.casos_hta_promedio AS DOUBLE) AS casos_hta_promedio FROM {tract_census} c LEFT JOIN (SELECT *, row_number() OVER (
      PARTITION BY cve_mun ORDER BY anio DESC) AS rn FROM {morbidity}) m ON m.cve_mun = left(c.cvegeo, 5) AND m.rn = 1""",
)
def parent_value(t):
    parent = ordered.latest_per_key(t.morbidity, ["cve_mun"], [F.desc_nulls_last("anio")])
    out = joins.broadcast_parent(t.tract_census.select("cvegeo"), parent, "cvegeo", "cve_mun", "municipality")
    return out.select("cvegeo", "anio", "casos_hta_promedio")


@query(
    "units_without_points",
    """SELECT cve_mun FROM {units} WHERE cve_mun NOT IN (SELECT area_geo FROM {registry} WHERE area_geo IS NOT NULL AND clase_actividad_id LIKE '4641%')""",
)
def units_without(t):
    shops = t.registry.filter(pharmacy_by_prefix("4641")).select(F.col("area_geo").alias("cve_mun"))
    return joins.deserts(t.units.select("cve_mun"), shops, "cve_mun")


@query(
    "stratum_values",
    """SELECT s.clee, s.entidad || CASE WHEN c.c_acctbal >= 2000 THEN '_urbano' ELSE '_rural' END AS estrato, p.prevalencia FROM {shops} s JOIN {customer} c
      ON c.c_custkey = s.num LEFT JOIN (SELECT lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || '_urbano' AS estrato, n_nationkey % 7 AS prevalencia FROM {nation}
      UNION ALL SELECT lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || '_rural', n_nationkey % 5 FROM {nation} WHERE n_nationkey % 3 <> 0) p
      ON p.estrato = s.entidad || CASE WHEN c.c_acctbal >= 2000 THEN '_urbano' ELSE '_rural' END""".replace("n_nationkey % 7", "CAST(n_nationkey % 7 AS BIGINT)").replace("n_nationkey % 5", "CAST(n_nationkey % 5 AS BIGINT)"),
)
def stratum_values(t):
    code = F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0")
    urban = t.nation.select(F.concat(code, F.lit("_urbano")).alias("estrato"), (F.col("n_nationkey") % 7).alias("prevalencia"))
    rural = t.nation.filter(F.col("n_nationkey") % 3 != 0).select(
        F.concat(code, F.lit("_rural")).alias("estrato"), (F.col("n_nationkey") % 5).alias("prevalencia")
    )
    rows = t.shops.join(t.customer.select(F.col("c_custkey").alias("num"), "c_acctbal"), "num")
    out = joins.stratum_join(rows, urban.unionByName(rural), "entidad", F.col("c_acctbal") >= 2000)
    return out.select("clee", "estrato", "prevalencia")


def muni_tables(t):
    rows = finance_rows(t, "municipality")
    return {
        "census_municipal": t.census_municipal,
        "poverty": t.poverty,
        "lag": t.lag,
        "crime_yearly": incidence.crime_yearly(t.crime_long),
        "mortality_yearly": incidence.mortality_yearly(t.deaths),
        "licences_municipal": health.licences_by_municipality(flagged(t)),
        "morbidity": t.morbidity,
        "housing_municipal": finance.housing_finance(rows, lookup(t.spark, "bodies"), "municipality"),
        "credit_municipal": finance.commercial_credit(rows, lookup(t.spark, "banks"), "municipality"),
        "traffic_municipal": traffic.traffic(placed(t), "municipality"),
    }


@query(
    "layers_poverty_crime_licences",
    f"""WITH k AS (SELECT DISTINCT cve_mun AS k FROM {{census_municipal}}), c AS (SELECT cve_mun, avg(n) AS v FROM (SELECT cve_mun, ano, CAST(sum(count) AS DOUBLE) AS n
        FROM {{crime_long}} WHERE length(cve_mun) = 5 AND ano < 2001 AND right(cve_mun, 3) NOT IN ('998', '999') GROUP BY 1, 2) GROUP BY 1)
    SELECT k.k, CAST(p.carencia_acceso_salud_pct AS DOUBLE) AS carencia_acceso_salud_pct, round(c.v, 6) AS total_delitos_year,
      CAST(l.con_estupefacientes + l.con_psicotropicos + l.con_vacunas + l.con_hemoderivados AS DOUBLE) AS farmacias_endorsements_controlados
    FROM k LEFT JOIN {{poverty}} p ON p.cve_mun = k.k LEFT JOIN c ON c.cve_mun = k.k LEFT JOIN ({LICENCES_SQL}) l ON l.cve_mun = k.k
    WHERE coalesce(p.carencia_acceso_salud_pct, c.v, l.total_licenciadas) IS NOT NULL""",
)
def layers_three(t):
    names = ["carencia_acceso_salud_pct", "total_delitos_year", "farmacias_endorsements_controlados"]
    out = layers.layer_values(muni_tables(t), "muni", names, as_of=2001)
    return out.withColumn("total_delitos_year", F.round("total_delitos_year", 6))


@query(
    "layers_of_one_state",
    f"""SELECT k.k, CAST(d.total_defunciones AS DOUBLE) AS defunciones_total, CAST(m.casos_dm2_promedio AS DOUBLE) AS dm2_casos_promedio,
      CAST(k.pobtot AS DOUBLE) AS pobtot_muni FROM (SELECT cve_mun AS k, pobtot FROM {{census_municipal}} WHERE left(cve_mun, 2) = '16') k
    LEFT JOIN (SELECT * FROM ({DEATHS_SQL}) WHERE ano = 1999) d ON d.cve_mun = k.k
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cve_mun ORDER BY anio DESC) AS rn FROM {{morbidity}}) m ON m.cve_mun = k.k AND m.rn = 1
    WHERE coalesce(d.total_defunciones, m.casos_dm2_promedio, k.pobtot) IS NOT NULL""",
)
def layers_state(t):
    names = ["defunciones_total", "dm2_casos_promedio", "pobtot_muni"]
    return layers.layer_values(muni_tables(t), "muni", names, state="16", as_of=1999)


@query(
    "layers_of_tracts",
    f"""SELECT a.cvegeo AS k, CASE WHEN c.pobtot > 0 THEN CAST(c.psinder AS DOUBLE) / c.pobtot * 100 END AS pct_sin_cobertura_salud,
      CAST(CASE l.grado WHEN 'Muy bajo' THEN 1 WHEN 'Bajo' THEN 2 WHEN 'Medio' THEN 3 WHEN 'Alto' THEN 4 WHEN 'Muy alto' THEN 5 END AS DOUBLE)
        AS grado_rezago_ageb_ordinal, CAST(f.total_licenciadas AS DOUBLE) AS farmacias_licenciadas_ageb
    FROM {{tract_boxes}} a LEFT JOIN {{tract_census}} c ON c.cvegeo = a.cvegeo LEFT JOIN {{tract_lag}} l ON l.cvegeo = a.cvegeo
      LEFT JOIN ({TRACT_LICENCES_SQL}) f ON f.cvegeo_ageb = a.cvegeo
    WHERE l.grado IS NOT NULL OR f.total_licenciadas IS NOT NULL OR (c.pobtot > 0 AND c.psinder IS NOT NULL)""",
)
def layers_tracts(t):
    tables = {
        "tract_areas": t.tract_boxes,
        "census_tract": t.tract_census,
        "lag_tract": t.tract_lag,
        "licences_tract": health.licences_by_tract(flagged(t)),
    }
    names = ["pct_sin_cobertura_salud", "grado_rezago_ageb_ordinal", "farmacias_licenciadas_ageb"]
    return layers.layer_values(tables, "ageb", names)


OTHER_LAYERS = [
    "pobreza_pct",
    "pobreza_extrema_pct",
    "irs_indice",
    "homicidio_doloso_year",
    "farmacias_licenciadas",
    "monto_credito_comercial",
    "pct_femenino_credito",
    "monto_subsidiado_vivienda",
    "acciones_vivienda_total",
    "tdpa_total",
]


@query(
    "layers_of_all_other_sources",
    f"""WITH k AS (SELECT DISTINCT cve_mun AS k FROM {{census_municipal}}),
    h AS (SELECT cve_mun, avg(n) AS v FROM (SELECT cve_mun, ano, CAST(coalesce(sum(count) FILTER (WHERE subtipo_delito = 'Homicidio doloso'), 0) AS DOUBLE) AS n
      FROM {{crime_long}} WHERE length(cve_mun) = 5 AND ano < 2001 AND right(cve_mun, 3) NOT IN ('998', '999') GROUP BY 1, 2) GROUP BY 1),
    r AS ({_rows_sql("municipality")}),
    fin AS (SELECT cve_mun, sum(monto) AS monto, sum(acciones) AS acciones,
      {ratio("coalesce(sum(acciones) FILTER (WHERE sexo = 2), 0)", "sum(acciones) FILTER (WHERE sexo IS NOT NULL)", 100)} AS fem FROM r GROUP BY 1),
    tr AS (SELECT cve_mun, sum(tdpa) AS tdpa FROM ({PLACED_SQL}) WHERE cve_mun IS NOT NULL GROUP BY 1),
    x AS (SELECT k.k, CAST(p.pobreza_pct AS DOUBLE) AS pobreza_pct, CAST(p.pobreza_extrema_pct AS DOUBLE) AS pobreza_extrema_pct,
      CAST(i.irs_indice AS DOUBLE) AS irs_indice, round(h.v, 6) AS homicidio_doloso_year, CAST(l.total_licenciadas AS DOUBLE) AS farmacias_licenciadas,
      CAST(fin.monto AS DOUBLE) AS monto_credito_comercial, fin.fem AS pct_femenino_credito, CAST(fin.monto AS DOUBLE) AS monto_subsidiado_vivienda,
      CAST(fin.acciones AS DOUBLE) AS acciones_vivienda_total, CAST(tr.tdpa AS DOUBLE) AS tdpa_total
      FROM k LEFT JOIN {{poverty}} p ON p.cve_mun = k.k LEFT JOIN {{lag}} i ON i.cve_mun = k.k LEFT JOIN h ON h.cve_mun = k.k
        LEFT JOIN ({LICENCES_SQL}) l ON l.cve_mun = k.k LEFT JOIN fin ON fin.cve_mun = k.k LEFT JOIN tr ON tr.cve_mun = k.k)
    SELECT * FROM x WHERE coalesce({", ".join(OTHER_LAYERS)}) IS NOT NULL""",
)
def layers_others(t):
    out = layers.layer_values(muni_tables(t), "muni", OTHER_LAYERS, as_of=2001)
    return out.withColumn("homicidio_doloso_year", F.round("homicidio_doloso_year", 6))


@query("layer_of_tract_population", "SELECT cvegeo AS k, CAST(pobtot AS DOUBLE) AS pobtot_ageb FROM {tract_census} WHERE pobtot IS NOT NULL")
def layer_tract_population(t):
    return layers.layer_values({"tract_areas": t.tract_boxes, "census_tract": t.tract_census}, "ageb", ["pobtot_ageb"])


def _names(table: dict) -> str:
    return "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in table.items()) + ")"


@query(
    "finance_by_named_categories",
    f"""SELECT m.nombre AS modalidad, d.nombre AS destino, v.nombre AS valor, CAST(sum(acciones) AS BIGINT) AS acciones FROM ({_rows_sql("state")}) r
      LEFT JOIN {_names(MODALITIES)} m(code, nombre) ON m.code = r.modalidad LEFT JOIN {_names(DESTINATIONS)} d(code, nombre) ON d.code = r.organismo
      LEFT JOIN {_names(TIERS)} v(code, nombre) ON v.code = r.vivienda_valor GROUP BY ALL""",
)
def named_categories(t):
    rows = finance_rows(t, "state").withColumnRenamed("organismo", "destino")
    rows = rows.groupBy("modalidad", "destino", "vivienda_valor").agg(F.sum("acciones").alias("acciones"))
    for code, table, name in (("modalidad", "modalities", "m"), ("destino", "destinations", "d"), ("vivienda_valor", "tiers", "v")):
        rows = joins.with_label(rows, lookup(t.spark, table), code, "nombre", name)
    named = rows.groupBy(F.col("m").alias("modalidad"), F.col("d").alias("destino"), F.col("v").alias("valor"))
    return named.agg(F.sum("acciones").cast("long").alias("acciones"))


@query(
    "airports_with_registry",
    """SELECT a.airport_name, a.cve_mun, count(r.clee) AS n FROM (VALUES """
    + ", ".join(f"('{k}', '{v}')" for k, v in AIRPORTS.items())
    + """) a(airport_name, cve_mun) LEFT JOIN {registry} r ON r.area_geo = a.cve_mun GROUP BY 1, 2""",
)
def airports_with_registry(t):
    counts = t.registry.groupBy(F.col("area_geo").alias("cve_mun")).agg(F.count(F.lit(1)).alias("n"))
    joined = lookup(t.spark, "airports").join(counts, "cve_mun", "left")
    return joined.select("airport_name", "cve_mun", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "weighted_ratio_by_group",
    f"""SELECT g, {ratio("sum(w) FILTER (WHERE v > 5000)", "sum(w)", 100)} AS pct FROM {{survey_points}} GROUP BY 1""",
)
def weighted_ratio_by_group(t):
    large = F.when(F.col("v") > 5000, F.col("w")).otherwise(0)
    return t.survey_points.groupBy("g").agg(aggregate.weighted_ratio(large, F.col("w")).alias("pct"))


@query(
    "per_thousand_of_counts",
    """SELECT cve_mun, pea * 1000.0::DOUBLE / pobtot AS pea, CAST(pct AS DOUBLE) AS pct, pobtot FROM (SELECT cve_mun, CAST(pea AS DOUBLE) AS pea, graproes AS pct, pobtot
      FROM {census_municipal}) WHERE pobtot > 0 AND pea IS NOT NULL""",
)
def per_thousand(t):
    rows = t.census_municipal.select("cve_mun", "pea", F.col("graproes").alias("pct"), "pobtot")
    kinds = {"pea": "numeric_count", "pct": "numeric_rate", "pobtot": "numeric_count"}
    return layers.per_capita(rows, kinds, "pobtot", "pea")


@query(
    "graded_categories_encoded",
    """SELECT cve_mun, CAST(CASE irs_grado WHEN 'Muy bajo' THEN 1 WHEN 'Bajo' THEN 2 WHEN 'Medio' THEN 3 WHEN 'Alto' THEN 4 WHEN 'Muy alto' THEN 5 END AS BIGINT) AS n,
      coalesce(irs_grado, 'sin_dato') AS grado FROM {lag}""",
)
def encoded(t):
    from demarca.functions.measures import grade_or_missing

    return t.lag.select("cve_mun", ordinal(F.col("irs_grado")).alias("n"), grade_or_missing(F.col("irs_grado")).alias("grado"))


@query(
    "quantile_bins_of_prices",
    """SELECT o_orderkey, CASE WHEN o_totalprice < q[1] THEN 0 WHEN o_totalprice < q[2] THEN 1 WHEN o_totalprice < q[3] THEN 2 WHEN o_totalprice < q[4] THEN 3 ELSE 4 END::BIGINT
      AS bin FROM {orders}, (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM {orders})""",
)
def bins(t):
    return layers.quantile_bins(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 5, "bin").select("o_orderkey", "bin")


@query(
    "layer_domain",
    """SELECT round(quantile_cont(o_totalprice, 1.0::DOUBLE / 3), 6) AS break_1, round(quantile_cont(o_totalprice, 2.0::DOUBLE / 3), 6) AS break_2, min(o_totalprice) AS min,
      max(o_totalprice) AS max, count(*) AS n FROM {orders}""",
)
def domain(t):
    out = layers.layer_domain(t.orders, "o_totalprice")
    return out.withColumns({c: F.round(c, 6) for c in ("break_1", "break_2")})


@query(
    "median_by_supplier",
    "SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, count(*) AS n FROM {lineitem} GROUP BY 1",
)
def median(t):
    out = ordered.quantiles(t.lineitem, ["l_suppkey"], "l_extendedprice", {"median": (1, 2)})
    return out.withColumn("median", F.round("median", 6))


@query(
    "bivariate_class",
    """SELECT cve_mun, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE CASE WHEN a < qa[1] THEN '0' WHEN a < qa[2] THEN '1' ELSE '2' END || '-' ||
      CASE WHEN b < qb[1] THEN '0' WHEN b < qb[2] THEN '1' ELSE '2' END END AS bivariate
    FROM (SELECT cve_mun, CAST(pobtot AS DOUBLE) AS a, CAST(psinder AS DOUBLE) AS b FROM {census_municipal}),
      (SELECT quantile_cont(CAST(pobtot AS DOUBLE), [1.0::DOUBLE / 3, 2.0::DOUBLE / 3]) AS qa, quantile_cont(CAST(psinder AS DOUBLE), [1.0::DOUBLE / 3, 2.0::DOUBLE / 3]) AS qb
        FROM {census_municipal})""",
)
def bivariate(t):
    return layers.bivariate_class(t.census_municipal.select("cve_mun", "pobtot", "psinder"), "pobtot", "psinder").select(
        "cve_mun", "bivariate"
    )


@query(
    "range_position",
    """SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 9) AS position FROM {customer}, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM {customer})""",
)
def position(t):
    out = layers.range_position(t.customer, "c_acctbal")
    return out.select("c_custkey", F.round("position", 9).alias("position"))


@query(
    "drill_to_state_and_sector",
    """SELECT 'state' AS kind, left(area_geo, 2) AS code, count(*) AS n FROM {registry} WHERE area_geo IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'rama', left(clase_actividad_id, 4), count(*) FROM {registry} GROUP BY 2""",
)
def drilled(t):
    by_mun = t.registry.groupBy(F.col("area_geo").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    by_class = t.registry.groupBy(F.col("clase_actividad_id").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    up = layers.drill(by_mun, "code", "state", ["n"]).select(F.lit("state").alias("kind"), "code", "n")
    branch = layers.next_level(layers.ACTIVITY_LEVELS, 5, down=False)
    return up.unionByName(layers.drill(by_class, "code", branch, ["n"]).select(F.lit("rama").alias("kind"), "code", "n"))


@query(
    "explorer_rates_by_grade",
    """SELECT m.nom_mun AS x, CAST(d.n AS DOUBLE) * 1000 / m.pobtot AS y, CAST(CASE i.irs_grado WHEN 'Muy bajo' THEN 0 WHEN 'Bajo' THEN 1 WHEN 'Medio' THEN 2
      WHEN 'Alto' THEN 3 WHEN 'Muy alto' THEN 4 END AS DOUBLE) AS z FROM {census_municipal} m JOIN (SELECT area_geo, count(*) AS n FROM {registry} GROUP BY 1) d
      ON d.area_geo = m.cve_mun LEFT JOIN {lag} i ON i.cve_mun = m.cve_mun WHERE m.pobtot > 0""",
)
def explorer(t):
    return layers.explorer_rows(
        {"municipality_wide": wide(t)}, "registro.municipio_nombre", "registro.total_establecimientos", "coneval.irs_grado", per_1000=True
    )


def _frac(num: str, den: str) -> str:
    return f"coalesce({ratio(num, den, 1, 8)}, 0)"


def _units8(num: str, den: str) -> str:
    """A fraction in units of 1e-8, exact."""
    return f"CAST(round({_frac(num, den)} * 100000000) AS HUGEINT)"


NSE = f"({_units8('vph_autom', 'pobtot')} + {_units8('vph_inter', 'pobtot')} + {_units8('pocupada', 'pobtot')}) * 3000000 + CAST(graproes * 100 AS HUGEINT) * 250000000000"


@query(
    "socioeconomic_score_of_shops",
    f"""SELECT s.clee, c.pobtot, c.nse AS nse_sintetico, CAST(p.pobreza_pct AS DOUBLE) AS pobreza_pct FROM (SELECT *, area_geo || '0001000' || CAST(1 + num % 4 AS VARCHAR) AS ageb
      FROM {{shops}}) s LEFT JOIN (SELECT cvegeo, pobtot, {ratio(NSE, "120000000000")} AS nse FROM {{tract_census}}) c ON c.cvegeo = s.ageb
      LEFT JOIN {{poverty}} p ON p.cve_mun = s.area_geo""",
)
def socioeconomic(t):
    tract = F.concat("area_geo", F.lit("0001000"), (1 + F.col("num") % 4).cast("string"))
    out = indices.socioeconomic_score(t.shops.withColumn("ageb", tract), t.tract_census, t.poverty)
    return out.select("clee", "pobtot", "nse_sintetico", "pobreza_pct")


@query(
    "market_potential",
    f"""SELECT m.cve_mun, pobtot, psinder, p_60ymas, CAST(p.pobreza_pct AS DOUBLE) AS pobreza_pct, CAST(p.carencia_acceso_salud_pct AS DOUBLE) AS carencia_acceso_salud_pct,
      {ratio("psinder", "pobtot", 100)} AS pct_psinder, {ratio("p_60ymas", "pobtot", 100)} AS pct_adultos_mayores,
      round(round({_frac("psinder", "pobtot")} * 40 + {_frac("p_60ymas", "pobtot")} * 30 + coalesce(CAST(p.carencia_acceso_salud_pct AS DOUBLE) / 100, 0) * 30, 2) * 100) AS imp_score
    FROM {{census_municipal}} m LEFT JOIN {{poverty}} p ON p.cve_mun = m.cve_mun""",
)
def market(t):
    return indices.market_potential(t.census_municipal, t.poverty)


@query(
    "health_vulnerability",
    f"""SELECT cvegeo, pobtot, round({_frac("p_60ymas", "pobtot")} * 35 + (1 - least(CAST(graproes AS DOUBLE) / 15, 1)) * 25
      + (1 - {_frac("vph_autom", "tvivparhab")}) * 20 + {_frac("pcon_disc", "pobtot")} * 20, 2) AS ivs_salud FROM {{tract_census}}""",
)
def vulnerability(t):
    return indices.health_vulnerability(t.tract_census)


SCORE_SQL = """SELECT *, round((base_score * 40 + least(ingresos / 1000000, 100) * 20 + least(unidades * 5, 100) * 15 + greatest(100 - robo_promedio / 10, 0) * 25) / 100, 2)
    AS score_fase2 FROM (SELECT o_custkey AS unit, CAST(o_custkey % 100 AS BIGINT) AS base_score, CAST(sum(CAST(o_totalprice AS BIGINT)) AS DOUBLE) AS ingresos,
      count(*) AS unidades, CAST(sum(o_orderkey % 300) AS BIGINT) AS robo_promedio FROM {orders} GROUP BY 1)"""


def scored(t):
    units = t.orders.groupBy(F.col("o_custkey").alias("unit")).agg(
        F.sum(F.round("o_totalprice").cast("long")).alias("ingresos"),
        F.count(F.lit(1)).alias("unidades"),
        F.sum(F.col("o_orderkey") % 300).alias("robo_promedio"),
    )
    return indices.location_score(units.withColumn("base_score", F.col("unit") % 100))


@query("location_score", f"SELECT unit, unidades, score_fase2 FROM ({SCORE_SQL})")
def location(t):
    return scored(t).select("unit", "unidades", "score_fase2")


@query(
    "extended_location_score",
    f"""SELECT unit, score_fase2, {ratio("CAST(round(score_fase2 * 100) AS HUGEINT) * 6500 + least(coalesce(egresos, 0), 10000) * 2500 + least(gasto * 2000, 10000000)", "1000000")}
      AS score_fase3 FROM (SELECT *, CASE WHEN unit % 4 = 0 THEN NULL ELSE unidades * 700 END AS egresos, unit * 9 AS gasto FROM ({SCORE_SQL}))""",
)
def extended(t):
    rows = scored(t).withColumns(
        {
            "egresos_cronicos": F.when(F.col("unit") % 4 != 0, F.col("unidades") * 700),
            "gasto_turista": F.col("unit") * 9,
        }
    )
    return indices.extended_location_score(rows).select("unit", "score_fase2", "score_fase3")


@query(
    "critical_deserts",
    f"""SELECT * FROM (SELECT cvegeo, pobtot, psinder, {ratio("psinder", "pobtot", 100)} AS pct_psinder FROM {{tract_census}} WHERE cvegeo NOT IN (SELECT ageb FROM {{registry}}
      WHERE ageb IS NOT NULL AND clase_actividad_id LIKE '464%')) WHERE pct_psinder > 3""",
)
def critical(t):
    shops = t.registry.filter(pharmacy_by_prefix("464")).select(F.col("ageb").alias("cvegeo"))
    return indices.critical_deserts(t.tract_census, shops, "cvegeo", floor_pct=3)


@query(
    "cases_per_pharmacy",
    f"""SELECT d.cve_mun, d.casos, d.sin_cobertura, coalesce(f.n, 0) AS farmacias, {ratio("d.casos", "f.n", 1, 1)} AS casos_por_farmacia FROM (SELECT cve_mun,
      pea AS casos, psinder AS sin_cobertura FROM {{census_municipal}} WHERE psinder > 500) d LEFT JOIN (SELECT area_geo, count(*) AS n FROM {{registry}}
      WHERE clase_actividad_id LIKE '4641%' GROUP BY 1) f ON f.area_geo = d.cve_mun""",
)
def per_pharmacy(t):
    demand = t.census_municipal.select("cve_mun", F.col("pea").alias("casos"), F.col("psinder").alias("sin_cobertura"))
    shops = t.registry.filter(pharmacy_by_prefix("4641")).select(F.col("area_geo").alias("cve_mun"))
    return indices.demand_per_supplier(demand, shops, "cve_mun", 500)


def modelled(t):
    sample = t.lineitem.select(
        (F.col("l_returnflag") == "R").cast("double").alias("sick"),
        (F.col("l_quantity") / 50).alias("older"),
        (F.col("l_discount") * 10).alias("schooling"),
    )
    areas = t.tract_census.select(
        "cvegeo",
        F.try_divide(F.col("p_60ymas"), F.col("pobtot")).alias("older"),
        (F.col("graproes").cast("double") / 20).alias("schooling"),
    )
    return sample, areas, ["older", "schooling"]


@query("prevalence_model_by_tract")
def prevalence(t):
    sample, areas, covariates = modelled(t)
    return indices.prevalence_model(sample, "sick", covariates, areas)


@query(
    "prevalence_model_checked",
    """SELECT count(*) AS areas, count(*) FILTER (pobtot IS NULL OR pobtot = 0) AS without, CAST(0 AS BIGINT) AS outside,
      (SELECT count(*) FROM {lineitem} WHERE l_returnflag = 'R') AS labelled,
      true AS predicted_equals_labelled FROM {tract_census}""",
)
def prevalence_checked(t):
    """All areas are there, those without a covariate without a value, and the sample's total is met."""
    sample, areas, covariates = modelled(t)
    found = indices.prevalence_model(sample, "sick", covariates, areas).agg(
        F.count(F.lit(1)).alias("areas"),
        F.count_if(F.col("prevalence").isNull()).alias("without"),
        F.count_if(~F.col("prevalence").between(0, 1)).alias("outside"),
    )
    again = indices.prevalence_model(sample, "sick", covariates, sample)
    met = again.agg(F.sum("sick").cast("long").alias("labelled"), F.sum("prevalence").alias("predicted"))
    near = F.abs(F.col("predicted") - F.col("labelled")) <= F.col("labelled") / 1000
    return joins.with_single(found, met.select("labelled", near.alias("predicted_equals_labelled")))


FITTED = (-1.25, {"older": 0.75, "schooling": -0.5})


@query(
    "prevalence_of_given_model",
    """SELECT cvegeo, CASE WHEN older IS NOT NULL AND schooling IS NOT NULL THEN round(1 / (1 + exp(-(-1.25 + older * 0.75 + schooling * -0.5))), 9) END AS prevalence
    FROM (SELECT cvegeo, CAST(p_60ymas AS DOUBLE) / nullif(pobtot, 0) AS older, CAST(graproes AS DOUBLE) / 20 AS schooling FROM {tract_census})""",
)
def prevalence_given(t):
    """The areas' expectation from coefficients that are given, so that every area's value can be compared."""
    found = indices.prevalence_by(modelled(t)[1], *FITTED)
    return found.select("cvegeo", F.round("prevalence", 9).alias("prevalence"))


ORDERS_TEXT = "o_orderkey o_custkey o_orderstatus o_orderpriority".split()
ROUND_TRIP_SQL = "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority FROM {orders}"


def _orders_csv(t, encoding="UTF-8", names=None) -> str:
    path = f"{scratch_folder(t.spark)}/orders"
    rows = t.orders.select(*[F.col(c).cast("string").alias(n) for c, n in zip(ORDERS_TEXT, names or ORDERS_TEXT)])
    rows.write.option("header", True).option("encoding", encoding).csv(path)
    return path


@query("contract_csv_round_trip", ROUND_TRIP_SQL)
def contract_csv(t):
    return delimited.read_contract_csv(t.spark, _orders_csv(t), ORDERS_TEXT)


@query("header_csv_renamed", "SELECT o_orderkey AS clave, o_custkey AS cliente, o_orderstatus AS estatus, o_orderpriority AS prioridad FROM (" + ROUND_TRIP_SQL + ")")
def header_csv(t):
    path = _orders_csv(t, "ISO-8859-1", ["Año clave", "Cliente", "Estatus", "Prioridad"])
    renames = {"año_clave": "clave", "cliente": "cliente", "estatus": "estatus", "prioridad": "prioridad"}
    return delimited.read_header_csv(t.spark, path, "ISO-8859-1", renames=renames)


@query(
    "state_files_read",
    """SELECT CASE WHEN o_orderstatus = 'F' THEN '01' ELSE '02' END AS estado, CAST(o_orderkey AS VARCHAR) AS clave,
      'a, "b"' || chr(10) || o_orderpriority AS nota, 'csv' AS formato FROM {orders}""",
)
def state_files(t):
    """Two folders of files, the columns in different orders, quoted cells with line breaks, a tag from the files' names."""
    root = scratch_folder(t.spark)
    note = F.concat(F.lit('a, "b"\n'), "o_orderpriority").alias("nota")
    key = F.col("o_orderkey").cast("string").alias("clave")
    for state, keep, columns in (("01", F.lit(True), [key, note]), ("02", F.lit(False), [note, key])):
        part = t.orders.filter((F.col("o_orderstatus") == "F") == keep).select(*columns)
        part.write.options(header=True, escape='"').csv(f"{root}/{state}")
    found = delimited.read_header_csv(t.spark, [f"{root}/01", f"{root}/02"], multi_line=True, tag={"formato": r"\.(\w+)$"})
    paid = t.orders.filter(F.col("o_orderstatus") == "F").select(key).withColumn("estado", F.lit("01"))
    state = F.coalesce("estado", F.lit("02")).alias("estado")
    return found.join(paid, "clave", "left").select(state, "clave", "nota", "formato")


@query(
    "registry_json_read",
    """SELECT CLEE AS clee, Id AS registro_id, RAMA_ACTIVIDAD_ID AS rama, Latitud AS latitud FROM {registry_export}""",
)
def registry_json(t):
    path = f"{scratch_folder(t.spark)}/registry"
    t.registry_export.write.json(path)
    rows = registry.read_registry(t.spark, path, lines=True)
    return rows.select(F.col("CLEE").alias("clee"), F.col("Id").alias("registro_id"), F.col("RAMA_ACTIVIDAD_ID").alias("rama"), F.col("Latitud").alias("latitud"))


@query(
    "registry_array_read",
    """SELECT CLEE AS clee, Id AS registro_id, RAMA_ACTIVIDAD_ID AS rama, Latitud AS latitud FROM {registry_export}""",
)
def registry_array(t):
    """The export as one file that holds one JSON array; a last, empty record closes it."""
    path = f"{scratch_folder(t.spark)}/registry"
    record = F.to_json(F.struct(*t.registry_export.columns), {"ignoreNullFields": "false"})
    lines = t.registry_export.select(F.lit(1).alias("at"), F.concat(record, F.lit(",")).alias("line"))
    ends = t.spark.createDataFrame([(0, "["), (2, "{}"), (3, "]")], "at int, line string")
    lines.unionByName(ends).coalesce(1).sortWithinPartitions("at").select("line").write.text(path)
    rows = registry.read_registry(t.spark, path).filter(F.col("CLEE").isNotNull())
    return rows.select(F.col("CLEE").alias("clee"), F.col("Id").alias("registro_id"), F.col("RAMA_ACTIVIDAD_ID").alias("rama"), F.col("Latitud").alias("latitud"))


@query("positional_csv", "SELECT CAST(o_orderpriority AS VARCHAR) AS p, CAST(o_orderkey AS VARCHAR) AS k FROM {orders}")
def positional_csv(t):
    return delimited.select_by_position(t.spark, _orders_csv(t), {"p": 4, "k": 1})


@query(
    "partition_replaced",
    """SELECT o_orderstatus, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN -o_orderkey ELSE o_orderkey END) AS BIGINT) AS s FROM {orders} GROUP BY 1""",
)
def partition_replaced(t):
    path = f"{scratch_folder(t.spark)}/by_status"
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    sinks.overwrite(rows, path, ["o_orderstatus"])
    again = rows.filter(F.col("o_orderstatus") == "F").withColumn("o_orderkey", -F.col("o_orderkey"))
    sinks.replace_partition(again, path, ["o_orderstatus"])
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"))


@query(
    "fixed_lookup_join",
    """SELECT entidad, count(*) AS n FROM {registry} WHERE entidad IN ('16', '21') GROUP BY 1""",
)
def fixed_lookup(t):
    wanted = filters.pin_filter(F.col("nombre"), ["Michoacán", "Puebla"])
    named = joins.with_label(
        t.registry.groupBy("entidad").agg(F.count(F.lit(1)).alias("n")), lookup(t.spark, "states"), "entidad", "nombre", "nombre"
    )
    return named.filter(wanted).drop("nombre")


