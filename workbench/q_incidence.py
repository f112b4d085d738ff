"""Crime, mortality, airports, surveys."""

from __future__ import annotations

from pyspark.sql import functions as F

from demarca.functions.keys import at_grain
from demarca.operators.joins import compare_periods
from demarca.plans import airports, incidence, surveys
from demarca.sources import increments
from demarca.sources.sinks import replace_partition
from demarca.sources.summaries import build_summaries, summary_or_live
from workbench.kit import big, dbl, query, ratio
from workbench.scratch import scratch_folder

CATS = incidence.CRIME_CATEGORIES
STATE, NOW, BASE = "16", 2000, 1998


def _crime_sums(kinds=("subtipo_delito", "bien_juridico")) -> str:
    return ", ".join(
        f"{big(f'coalesce(sum(count) FILTER (WHERE {c} = {v!r}), 0)')} AS {name}"
        for name, (c, v) in CATS.items()
        if c in kinds
    )


CRIME_SUMMARY_SQL = f"""WITH cur AS (SELECT cve_mun, {_crime_sums()}, {big("sum(count)")} AS total_delitos FROM {{crime_long}}
    WHERE cve_mun LIKE '{STATE}%' AND length(cve_mun) = 5 AND ano = {NOW} AND right(cve_mun, 3) NOT IN ('998', '999') GROUP BY 1),
  b AS (SELECT cve_mun, {big("sum(count)")} AS total_baseline FROM {{crime_long}} WHERE ano = {BASE} AND length(cve_mun) = 5 GROUP BY 1)
  SELECT cur.*, m.nom_mun AS municipio, m.pobtot AS poblacion, total_baseline, {ratio("total_delitos", "m.pobtot", 1000)} AS delitos_per_1k_pop,
    {ratio("total_delitos - total_baseline", "total_baseline", 100, 1)} AS delitos_change_pct
  FROM cur LEFT JOIN b ON b.cve_mun = cur.cve_mun LEFT JOIN {{census_municipal}} m ON m.cve_mun = cur.cve_mun"""


YEARLY_CRIME_SQL = f"""SELECT cve_mun, ano, {_crime_sums()}, {big("sum(count)")} AS total_delitos FROM {{crime_long}} WHERE length(cve_mun) = 5 GROUP BY 1, 2"""


@query("crime_yearly", YEARLY_CRIME_SQL)
def crime_yearly(t):
    return incidence.crime_yearly(t.crime_long)


@query("crime_summary_live", CRIME_SUMMARY_SQL)
def crime_live(t):
    return incidence.crime_summary_live(t.crime_long, t.census_municipal, STATE, NOW, BASE, CATS)


@query("crime_summary_stored", CRIME_SUMMARY_SQL)
def crime_stored(t):
    """Builds the roll-up as a stored summary, then reads it in preference to the live form."""
    root = scratch_folder(t.spark)
    build_summaries({"crime_yearly": lambda: incidence.crime_yearly(t.crime_long)}, root, ["crime_yearly"])
    yearly = summary_or_live(t.spark, f"{root}/crime_yearly", lambda: incidence.crime_yearly(t.crime_long))
    return incidence.crime_summary(yearly, t.census_municipal, STATE, NOW, BASE, CATS)


@query("crime_yearly_refreshed", YEARLY_CRIME_SQL)
def crime_refreshed(t):
    """A first refresh over wrong rows of one state; the state is replaced, and a second refresh computes it alone."""
    root = scratch_folder(t.spark)
    source = f"{root}/monthly"
    rows = t.crime_long.withColumn("estado", at_grain(F.col("cve_mun"), "state"))
    wrong = F.when(F.col("estado") == STATE, F.col("count") + 7).otherwise(F.col("count"))
    replace_partition(rows.withColumn("count", wrong), source, ["estado"])
    increments.refresh(t.spark, incidence.CRIME_YEARLY, source, root)
    replace_partition(rows.filter(F.col("estado") == STATE), source, ["estado"])
    done = increments.refresh(t.spark, incidence.CRIME_YEARLY, source, root)
    if done.computed != [f"estado={STATE}"]:
        raise ValueError(f"one state was replaced, but {done.computed} were computed")
    return increments.stored(t.spark, incidence.CRIME_YEARLY, source, root)


@query("crime_summary_fallback", CRIME_SUMMARY_SQL)
def crime_fallback(t):
    """No stored summary exists at the path, so the live form answers."""
    absent = f"{scratch_folder(t.spark)}/absent"
    yearly = summary_or_live(t.spark, absent, lambda: incidence.crime_yearly(t.crime_long))
    return incidence.crime_summary(yearly, t.census_municipal, STATE, NOW, BASE, CATS)


@query(
    "crime_monthly_series",
    f"""SELECT ano, mes, {_crime_sums(("subtipo_delito",))}, {big("sum(count)")} AS total FROM {{crime_long}} WHERE cve_mun = '16000' GROUP BY 1, 2""",
)
def crime_series(t):
    return incidence.crime_series(t.crime_long, "16000", CATS)


DEATHS_SQL = """SELECT ent_resid || mun_resid AS cve_mun, CAST(anio_ocur AS INT) AS ano, count(*) AS total_defunciones,
    count(*) FILTER (WHERE left(edad, 1) IN ('1', '2', '3')) AS def_menores_1ano,
    count(*) FILTER (WHERE capitulo = '9') AS def_circulatorio, count(*) FILTER (WHERE capitulo = '2') AS def_neoplasias,
    count(*) FILTER (WHERE capitulo = '4') AS def_endocrinas, count(*) FILTER (WHERE capitulo = '20') AS def_externas
  FROM {deaths} WHERE regexp_full_match(ent_resid, '0[1-9]|[12][0-9]|3[0-2]') AND mun_resid IS NOT NULL AND mun_resid <> '999'
    AND regexp_full_match(anio_ocur, '[0-9]{4}') GROUP BY 1, 2""".replace("{4}", "<4>")


@query("mortality_yearly", f"SELECT * REPLACE (CAST(ano AS BIGINT) AS ano) FROM ({DEATHS_SQL})")
def mortality_yearly(t):
    return incidence.mortality_yearly(t.deaths)


MORTALITY_SQL = f"""SELECT d.* EXCLUDE (ano), m.nom_mun AS municipio, m.pobtot AS poblacion,
    {ratio("total_defunciones", "m.pobtot", 1000)} AS tasa_mortalidad_per_1k, {ratio("def_menores_1ano", "m.pobtot", 1000)} AS tasa_infantil_per_1k
  FROM ({DEATHS_SQL}) d LEFT JOIN {{census_municipal}} m ON m.cve_mun = d.cve_mun WHERE d.cve_mun LIKE '16%' AND ano = 1999"""


@query("mortality_summary", MORTALITY_SQL)
def mortality_summary(t):
    return incidence.mortality_summary(incidence.mortality_yearly(t.deaths), t.census_municipal, "16", 1999)


@query("mortality_summary_live", MORTALITY_SQL)
def mortality_live(t):
    return incidence.mortality_summary_live(t.deaths, t.census_municipal, "16", 1999)


@query(
    "mortality_series",
    f"SELECT * EXCLUDE (cve_mun) REPLACE (CAST(ano AS BIGINT) AS ano) FROM ({DEATHS_SQL}) WHERE cve_mun = '16021' AND ano BETWEEN 1990 AND 2039",
)
def mortality_series(t):
    return incidence.mortality_series(incidence.mortality_yearly(t.deaths), "16021", first=1990)


@query(
    "primary_mortality_year",
    f"SELECT CAST(max(ano) AS BIGINT) AS ano FROM (SELECT ano FROM ({DEATHS_SQL}) GROUP BY 1 HAVING sum(total_defunciones) >= 1000) WHERE ano <= 2026",
)
def primary_year(t):
    return incidence.primary_mortality_year(t.deaths, 2026, floor=1000)


@query(
    "periods_compared",
    """SELECT c.cve_mun, c.n, b.n AS n_base FROM (SELECT cve_mun, CAST(sum(count) AS BIGINT) AS n FROM {crime_long} WHERE ano = 2000 GROUP BY 1) c
    LEFT JOIN (SELECT cve_mun, CAST(sum(count) AS BIGINT) AS n FROM {crime_long} WHERE ano = 1996 GROUP BY 1) b ON b.cve_mun = c.cve_mun""",
)
def compared(t):
    yearly = t.crime_long.groupBy("cve_mun", "ano").agg(F.sum("count").alias("n"))
    return compare_periods(yearly, ["cve_mun"], "ano", 2000, 1996, "n", "n_base").drop("ano")


YEARLY_SQL = """SELECT m.airport_name, x.cve_mun, m.ano, CAST(sum(m.mar_flights) AS BIGINT) AS mar_flights FROM {movements} m
  JOIN {airport_crosswalk} x ON upper(trim(x.airport_name)) = upper(trim(m.airport_name)) GROUP BY 1, 2, 3"""


@query("airport_movements_yearly", YEARLY_SQL)
def movements(t):
    return airports.movements_yearly(t.movements, t.airport_crosswalk)


def _mean(years: str, col: str) -> str:
    return big(f"CAST(({ratio(f'sum({col}) FILTER (WHERE ano IN ({years}))', f'count({col}) FILTER (WHERE ano IN ({years}))', 1, 0)}) AS DOUBLE)")


def _at(year: int, col: str = "mar_flights") -> str:
    return f"max({col}) FILTER (WHERE ano = {year})"


@query(
    "airports_by_municipality",
    f"""SELECT cve_mun, airport_name, {big(f"coalesce({_at(2001)}, 0)")} AS flights_latest, coalesce({_mean("1999, 2000, 2001", "mar_flights")}, 0)
      AS flights_recent_avg, {_at(1996)} AS flights_base, {ratio(f"{_at(2001)} - {_at(1996)}", _at(1996), 100, 1)} AS pct_change_vs_base
    FROM ({YEARLY_SQL}) GROUP BY 1, 2""",
)
def airports_municipal(t):
    yearly = airports.movements_yearly(t.movements, t.airport_crosswalk)
    return airports.airports_of_municipality(yearly, None, 2001, [1999, 2000, 2001], 1996)


@query(
    "municipality_movements",
    f"""SELECT cve_mun, {_at(2001, "airports")} AS num_airports_latest, {_mean("1999, 2000, 2001", "flights")} AS flights_recent_avg,
      {_at(1996, "flights")} AS flights_base, {_at(2001, "flights")} AS flights_latest,
      {ratio(f'{_at(2001, "flights")} - {_at(1996, "flights")}', _at(1996, "flights"), 100, 1)} AS pct_change_vs_base
    FROM (SELECT cve_mun, ano, {big("sum(mar_flights)")} AS flights, count(DISTINCT airport_name) AS airports FROM ({YEARLY_SQL}) GROUP BY 1, 2) GROUP BY 1""",
)
def municipal_movements(t):
    yearly = airports.movements_yearly(t.movements, t.airport_crosswalk)
    return airports.municipality_movements(yearly, 2001, [1999, 2000, 2001], 1996)


def _cents(c: str) -> str:
    return f"CAST(TRY_CAST(nullif({c}, '') AS DECIMAL(20,2)) * 100 AS HUGEINT)"


def _spend(c: str) -> str:
    return ratio(f"sum(w * {c})", "sum(w * gasto)", 100)


def income_sql(year: int = 2024) -> str:
    return f"""WITH p AS (SELECT left(ubica_geo, 2) AS entidad, CAST(factor AS BIGINT) AS w, CAST(tot_integ AS BIGINT) AS integ,
        {_cents("ing_cor")} AS ing, {_cents("gasto_mon")} AS gasto, {_cents("alimentos")} AS ali, {_cents("vivienda")} AS viv,
        {_cents("salud")} AS sal, {_cents("transporte")} AS tra, {_cents("educacion")} AS edu FROM {{income_raw}}
      WHERE regexp_full_match(ubica_geo, '(0[1-9]|[12][0-9]|3[0-2])[0-9]<3>') AND CAST(factor AS BIGINT) > 0),
    r AS (SELECT entidad, ing, sum(w) OVER (PARTITION BY entidad ORDER BY ing ROWS UNBOUNDED PRECEDING) AS cumw,
        sum(w) OVER (PARTITION BY entidad) AS totw FROM p WHERE ing IS NOT NULL),
    q AS (SELECT entidad, min(ing) FILTER (WHERE cumw * 2 >= totw) AS m, min(ing) FILTER (WHERE cumw * 10 >= totw) AS d1,
        min(ing) FILTER (WHERE cumw * 10 >= totw * 9) AS d9 FROM r GROUP BY 1)
    SELECT p.entidad, {year}::BIGINT AS ano_levantamiento, {big("sum(w)")} AS hogares_estimados, {big("sum(w * integ)")} AS poblacion_estimada,
      {ratio("sum(w * ing)", "sum(w) * 100")} AS ingreso_corriente_promedio,
      {ratio("sum(w * gasto)", "sum(CASE WHEN gasto IS NOT NULL THEN w END) * 100")} AS gasto_corriente_promedio,
      {_spend("ali")} AS pct_gasto_alimentos, {_spend("viv")} AS pct_gasto_vivienda, {_spend("sal")} AS pct_gasto_salud,
      {_spend("tra")} AS pct_gasto_transporte, {_spend("edu")} AS pct_gasto_educacion,
      {dbl("max(m)")} / 100 AS ingreso_corriente_mediana, {dbl("max(d1)")} / 100 AS decil_1_ingreso, {dbl("max(d9)")} / 100 AS decil_9_ingreso
    FROM p LEFT JOIN q ON q.entidad = p.entidad GROUP BY 1"""


def labour_sql(year: int = 2025) -> str:
    def level(cond: str) -> str:
        return big(ratio(f"sum(w) FILTER (WHERE {cond})", "count(DISTINCT trimestre)", 1, 0))

    def rate(num: str, den: str) -> str:
        return ratio(f"sum(w) FILTER (WHERE {num})", f"sum(w) FILTER (WHERE {den})", 100)

    paid = "clase2 = '1' AND ingreso > 0"
    return f"""SELECT entidad, {year}::BIGINT AS ano_levantamiento, {level("edad >= 15")} AS poblacion_15_mas, {level("clase1 = '1'")} AS pea,
      {level("clase2 = '1'")} AS ocupada, {level("clase2 = '2'")} AS desocupada, {level("emp_ppal = '1'")} AS informal,
      {rate("clase1 = '1'", "edad >= 15")} AS tasa_participacion, {rate("clase2 = '2'", "clase1 = '1'")} AS tasa_desocupacion,
      {rate("emp_ppal = '1'", "clase2 = '1'")} AS tasa_informalidad,
      {ratio(f"sum(w * ingreso) FILTER (WHERE {paid})", f"sum(w) FILTER (WHERE {paid})")} AS ingreso_promedio_mensual,
      count(DISTINCT trimestre) AS trimestres_cargados
    FROM (SELECT lpad(trim(ent), 2, '0') AS entidad, TRY_CAST(nullif(trim(fac_tri), '') AS BIGINT) AS w,
        TRY_CAST(nullif(trim(eda), '') AS BIGINT) AS edad, clase1, clase2, emp_ppal, TRY_CAST(nullif(trim(ingocup), '') AS BIGINT) AS ingreso,
        trimestre FROM {{labour_raw}}) WHERE regexp_full_match(entidad, '0[1-9]|[12][0-9]|3[0-2]') AND w > 0 GROUP BY 1"""


@query("income_survey_by_state", income_sql())
def income_survey(t):
    return surveys.income_survey(t.income_raw, 2024)


@query("labour_survey_by_state", labour_sql())
def labour_survey(t):
    return surveys.labour_survey(t.labour_raw, 2025)


@query(
    "state_calibrators",
    f"""SELECT i.* EXCLUDE (ano_levantamiento), i.ano_levantamiento AS enigh_ano, l.* EXCLUDE (entidad, ano_levantamiento, trimestres_cargados,
      ingreso_promedio_mensual), l.ano_levantamiento AS enoe_ano, l.trimestres_cargados AS enoe_trimestres_cargados,
      l.ingreso_promedio_mensual AS ingreso_promedio_mensual_ocupado
    FROM (SELECT * FROM ({income_sql()})) i LEFT JOIN (SELECT * FROM ({labour_sql()})) l ON l.entidad = i.entidad WHERE i.entidad = '09'""",
)
def calibrators(t):
    return surveys.state_calibrators(surveys.income_survey(t.income_raw, 2024), surveys.labour_survey(t.labour_raw, 2025), "09")


@query(
    "state_wide_surveys",
    f"""SELECT s.cve_ent, s.nom_ent, l.tasa_informalidad, l.tasa_desocupacion, i.ingreso_corriente_mediana, i.pct_gasto_alimentos
    FROM (SELECT lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS cve_ent, n_name AS nom_ent FROM {{nation}}) s
    LEFT JOIN (SELECT * FROM ({income_sql()})) i ON i.entidad = s.cve_ent LEFT JOIN (SELECT * FROM ({labour_sql()})) l ON l.entidad = s.cve_ent""",
)
def state_wide(t):
    code = F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0")
    states = t.nation.select(code.alias("entidad"), F.col("n_name").alias("nom_ent"))
    return surveys.state_wide(states, surveys.income_survey(t.income_raw, 2024), surveys.labour_survey(t.labour_raw, 2025))
