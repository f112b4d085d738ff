"""Registry counts, rankings, coverage and opportunity."""

from __future__ import annotations

from pyspark.sql import functions as F

from demarca.operators import filters, quality
from demarca.operators.aggregate import count_by
from demarca.operators.joins import with_single
from demarca.operators.search import search
from demarca.plans import establishments as est
from demarca.sources import increments, trigrams
from demarca.sources.lookups import OFFICIAL_TOTALS, SECTORS, STATES, lookup
from demarca.sources.sinks import replace_partition, to_geojson_lines, without_geometry
from workbench.kit import big, query, ratio
from workbench.scratch import scratch_folder

PHARMACY = "4641"
STATE = "16"
TOTALS_SQL = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in OFFICIAL_TOTALS.items()) + ") off(entidad, official_total)"
STATES_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in STATES.items()) + ") st(entidad, nombre)"
SECTORS_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SECTORS.items()) + ") sec(scian, name)"


def totals(t):
    return lookup(t.spark, "official_totals")


@query(
    "treemap_by_state",
    f"""WITH c AS (SELECT entidad, count(*) AS establecimientos FROM {{registry}} WHERE entidad IS NOT NULL GROUP BY 1),
    g AS (SELECT substr(cve_mun, 1, 2) AS entidad, irs_grado,
        row_number() OVER (PARTITION BY substr(cve_mun, 1, 2) ORDER BY count(*) DESC, irs_grado) AS rn
      FROM {{lag}} WHERE irs_grado IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT substr(cve_mun, 1, 2) AS entidad,
        {ratio("sum(CAST(pobreza_pct * 10000 AS BIGINT) * coalesce(poblacion, 0))", "sum(coalesce(poblacion, 0)) * 10000")}
          AS pobreza_pct_promedio FROM {{poverty}} GROUP BY 1)
    SELECT c.entidad, establecimientos, g.irs_grado AS modal_irs_grado, pobreza_pct_promedio
    FROM c LEFT JOIN g ON g.entidad = c.entidad AND g.rn = 1 LEFT JOIN p ON p.entidad = c.entidad""",
)
def treemap(t):
    return est.national_treemap(t.registry, t.lag, t.poverty)


@query(
    "sector_grade_matrix",
    """SELECT r.sector_actividad_id AS scian, coalesce(i.irs_grado, 'sin_dato') AS irs_grado, count(*) AS count
    FROM {registry} r LEFT JOIN {lag} i ON i.cve_mun = r.area_geo WHERE r.sector_actividad_id IS NOT NULL GROUP BY 1, 2""",
)
def matrix(t):
    return est.sector_grade_matrix(t.registry, t.lag)


@query(
    "state_classes_refreshed",
    """SELECT entidad, CAST(sum(n) AS BIGINT) AS establecimientos, count(clase_actividad_id) AS clases,
      arg_max(clase_actividad_id, n * 10000000 - CAST(clase_actividad_id AS BIGINT)) FILTER (WHERE clase_actividad_id IS NOT NULL) AS clase_modal,
      CAST(max(n) FILTER (WHERE clase_actividad_id IS NOT NULL) AS BIGINT) AS en_clase_modal
    FROM (SELECT entidad, clase_actividad_id, count(*) AS n FROM {registry} WHERE entidad IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
)
def state_classes(t):
    """Counts per class are kept by state; states come in two loads; one has its rows twice and is replaced."""
    root = scratch_folder(t.spark)
    source = f"{root}/registry"
    rows = t.registry.select("clee", "entidad", "clase_actividad_id").withColumn("carga", F.col("entidad"))
    first = F.col("entidad") < STATE
    replace_partition(rows.filter(first), source, ["carga"])
    increments.refresh(t.spark, est.STATE_CLASSES, source, root)
    twice = rows.filter(F.col("entidad") == STATE)
    replace_partition(rows.filter(~first).unionByName(twice), source, ["carga"])
    increments.refresh(t.spark, est.STATE_CLASSES, source, root)
    replace_partition(twice, source, ["carga"])
    increments.refresh(t.spark, est.STATE_CLASSES, source, root)
    return increments.stored_or_live(t.spark, est.STATE_CLASSES, source, root)


PANEL_SQL = f"""WITH e AS (SELECT area_geo AS cve_mun, count(*) AS establecimientos,
      count(*) FILTER (WHERE clase_actividad_id LIKE '{PHARMACY}%') AS farmacias
    FROM {{registry}} WHERE entidad = '{STATE}' AND area_geo IS NOT NULL GROUP BY 1),
  c AS (SELECT cve_mun, count(*) AS n FROM {{clinics}} WHERE substr(cve_mun, 1, 2) = '{STATE}' GROUP BY 1)
  SELECT e.cve_mun, e.establecimientos, e.farmacias, m.nom_mun AS municipio, m.pobtot AS poblacion,
    coalesce(c.n, 0) AS unidades_clues, CAST(p.pobreza_pct AS DOUBLE) AS pobreza_pct, i.irs_grado,
    CAST(i.irs_indice AS DOUBLE) AS irs_indice
  FROM e LEFT JOIN {{census_municipal}} m ON m.cve_mun = e.cve_mun LEFT JOIN c ON c.cve_mun = e.cve_mun
    LEFT JOIN {{poverty}} p ON p.cve_mun = e.cve_mun LEFT JOIN {{lag}} i ON i.cve_mun = e.cve_mun"""


def panel(t):
    return est.municipality_panel(
        t.registry, t.census_municipal, t.clinics, t.poverty, t.lag, STATE, est.pharmacy_by_prefix(PHARMACY)
    )


@query("municipality_panel", PANEL_SQL)
def municipality_panel(t):
    return panel(t)


@query(
    "health_cover_top",
    f"""SELECT cve_mun, poblacion, {ratio("unidades_clues", "poblacion", 100000)} AS clues_per_100k,
      {ratio("farmacias", "poblacion", 100000)} AS farmacias_per_100k
    FROM ({PANEL_SQL}) x WHERE poblacion > 10000 ORDER BY poblacion DESC, cve_mun LIMIT 10""",
)
def health_cover(t):
    return est.health_cover_top(panel(t), floor=10_000, limit=10)


@query(
    "density_against_poverty",
    f"""SELECT cve_mun, coalesce(irs_grado, 'sin_dato') AS irs_grado, {ratio("establecimientos", "poblacion", 1000)} AS densidad,
      pobreza_pct, round(least(36.0, greatest(4.0, sqrt(CAST(poblacion AS DOUBLE) / 1000))), 6) AS marker_size
    FROM ({PANEL_SQL}) x WHERE poblacion > 0 AND pobreza_pct IS NOT NULL""",
)
def density(t):
    return est.density_against_poverty(panel(t))


@query(
    "top_sectors_of_state",
    f"""SELECT c.scian, c.count, coalesce(sec.name, '(SCIAN ' || c.scian || ' — sin etiqueta)') AS name FROM (
      SELECT sector_actividad_id AS scian, count(*) AS count FROM {{registry}} WHERE entidad = '{STATE}'
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) c LEFT JOIN {SECTORS_SQL} ON sec.scian = c.scian""",
)
def top_sectors(t):
    return est.top_sectors(t.registry, lookup(t.spark, "sectors"), STATE, limit=10)


@query(
    "sector_list",
    f"""SELECT c.scian, c.national_count, coalesce(sec.name, '(SCIAN ' || c.scian || ' — sin etiqueta)') AS name FROM (
      SELECT sector_actividad_id AS scian, count(*) AS national_count FROM {{registry}} GROUP BY 1) c
      LEFT JOIN {SECTORS_SQL} ON sec.scian = c.scian""",
)
def sector_list(t):
    return est.sector_list(t.registry, lookup(t.spark, "sectors"))


@query(
    "sector_national_summary",
    """SELECT entidad, count(*) AS count,
      CAST((SELECT count(*) FROM {registry} WHERE sector_actividad_id = '46') AS BIGINT) AS national_total
    FROM {registry} WHERE sector_actividad_id = '46' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def sector_national(t):
    return est.sector_national(t.registry, "46", limit=10)


@query(
    "top_classes_national",
    """SELECT clase_actividad_id, count(*) AS total FROM {registry} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def top_classes(t):
    return est.top_classes(t.registry, limit=10)


@query(
    "top_municipalities",
    """SELECT area_geo, count(*) AS total FROM {registry} WHERE area_geo IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def top_municipalities(t):
    return est.top_municipalities(t.registry, limit=20)


@query(
    "class_summary_by_state",
    "SELECT entidad, clase_actividad_id, count(*) AS total FROM {registry} GROUP BY 1, 2",
)
def class_summary(t):
    return est.class_summary(t.registry)


@query(
    "size_distribution_by_state",
    "SELECT entidad, estrato, count(*) AS total FROM {registry} WHERE estrato IS NOT NULL GROUP BY 1, 2",
)
def sizes(t):
    return est.size_distribution(t.registry)


def band(loaded: str, total: str) -> str:
    return (
        f"CASE WHEN {total} IS NULL THEN 'unverified' WHEN {loaded} * 100 >= {total} * 99 THEN 'green' "
        f"WHEN {loaded} * 100 >= {total} * 90 THEN 'yellow' ELSE 'red' END"
    )


@query(
    "coverage_report",
    f"""SELECT c.*, official_total, {ratio("loaded", "official_total", 100)} AS coverage_pct, {band("loaded", "official_total")} AS status
    FROM (SELECT entidad, count(*) AS loaded, min(created_at) AS first_loaded_at, max(updated_at) AS last_updated_at,
      count(*) FILTER (WHERE longitud IS NOT NULL AND latitud IS NOT NULL) AS with_geom,
      count(*) FILTER (WHERE telefono <> '') AS with_telefono, count(*) FILTER (WHERE correo_e <> '') AS with_correo_e
      FROM {{registry}} WHERE regexp_matches(entidad, '^(0[1-9]|[12][0-9]|3[0-2])$') GROUP BY 1) c
    LEFT JOIN (SELECT entidad AS e2, official_total FROM {TOTALS_SQL}) o ON o.e2 = c.entidad""",
)
def coverage_report(t):
    return est.coverage_report(t.registry, totals(t))


@query(
    "state_list",
    f"""SELECT st.entidad, st.nombre, coalesce(c.n, 0) AS loaded, official_total, {band("coalesce(c.n, 0)", "official_total")} AS status
    FROM {STATES_SQL} LEFT JOIN (SELECT entidad, count(*) AS n FROM {{registry}} GROUP BY 1) c ON c.entidad = st.entidad
    LEFT JOIN (SELECT entidad AS e2, official_total FROM {TOTALS_SQL}) o ON o.e2 = st.entidad""",
)
def state_list(t):
    return est.state_list(t.registry, lookup(t.spark, "states"), totals(t))


@query(
    "state_summary",
    f"""SELECT '{STATE}' AS entidad, n AS loaded, {OFFICIAL_TOTALS[STATE]}::BIGINT AS official_total,
      {ratio("n", str(OFFICIAL_TOTALS[STATE]), 100)} AS coverage_pct, {band("n", str(OFFICIAL_TOTALS[STATE]))} AS status,
      (SELECT string_agg(c || ':' || k, '|' ORDER BY k DESC, c) FROM (SELECT clase_actividad_id AS c, count(*) AS k FROM {{registry}}
        WHERE entidad = '{STATE}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)) AS top_classes,
      (SELECT string_agg(e || ':' || k, '|' ORDER BY k DESC, e) FROM (SELECT estrato AS e, count(*) AS k FROM {{registry}}
        WHERE entidad = '{STATE}' AND estrato IS NOT NULL GROUP BY 1)) AS sizes
    FROM (SELECT count(*) AS n FROM {{registry}} WHERE entidad = '{STATE}')""",
)
def state_summary(t):
    parts = est.state_summary(t.registry, totals(t), STATE, top=10)

    def flat(df, label, name):
        rows = F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("n"), F.col(label).alias("l"))))
        text = F.transform(rows, lambda x: F.concat_ws(":", x["l"], (-x["n"]).cast("string")))
        return df.agg(F.array_join(text, "|").alias(name))

    out = with_single(parts["coverage"], flat(parts["top_classes"], "clase_actividad_id", "top_classes"))
    return with_single(out, flat(parts["sizes"], "estrato", "sizes"))


LABELLED = "colonia IS NOT NULL AND trim(colonia) <> ''"


@query(
    "neighbourhoods_of_municipality",
    f"""SELECT upper(trim(colonia)) AS colonia, count(*) AS num_establecimientos FROM {{registry}}
    WHERE area_geo = '16000' AND {LABELLED} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
)
def neighbourhoods(t):
    return est.neighbourhoods(t.registry, "16000", limit=50)


@query(
    "neighbourhoods_of_tract",
    f"""SELECT upper(trim(colonia)) AS colonia, count(*) AS num_establecimientos FROM {{registry}}
    WHERE ageb = '1600000010002' AND {LABELLED} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
)
def neighbourhoods_tract(t):
    return est.neighbourhoods_of_tract(t.registry, "1600000010002", limit=50)


@query(
    "neighbourhood_opportunity",
    f"""SELECT *, {ratio("total_estab", "target_count")} AS score FROM (
      SELECT upper(trim(colonia)) AS colonia, count(*) FILTER (WHERE sector_actividad_id IN ('46', '62')) AS target_count,
        count(*) AS total_estab FROM {{registry}} WHERE area_geo = '16000' AND {LABELLED} GROUP BY 1)
    ORDER BY CAST(total_estab AS DOUBLE) / nullif(target_count, 0) DESC NULLS LAST, colonia LIMIT 20""",
)
def neighbourhood_opportunity(t):
    return est.neighbourhood_opportunity(t.registry, "16000", ["46", "62"], limit=20)


@query(
    "taxonomy_mixed_levels",
    """SELECT entidad, count(*) AS n FROM {registry} WHERE sector_actividad_id IN ('11', '23') OR rama_actividad_id IN ('4641', '6211')
      OR clase_actividad_id IN ('541111') GROUP BY 1""",
)
def taxonomy(t):
    cond = filters.taxonomy_filter(["11", "4641", "6211", "541111", "23"], est.LEVEL_COLUMNS, mixed=True)
    return count_by(t.registry.filter(cond), ["entidad"], "n")


@query(
    "bundle_counts",
    "SELECT b AS bundle, n FROM (" + " UNION ALL ".join(
        f"SELECT '{name}' AS b, count(*) AS n FROM {{registry}} WHERE "
        + " OR ".join(f"clase_actividad_id LIKE '{c}%'" for c in codes)
        for name, codes in filters.BUNDLES.items()
    ) + ")",
)
def bundles(t):
    measures = [F.count_if(filters.bundle_filter(b, est.LEVEL_COLUMNS)).alias(b) for b in filters.BUNDLES]
    return t.registry.agg(*measures).unpivot([], list(filters.BUNDLES), "bundle", "n")


@query(
    "class_prefix_by_state",
    f"SELECT entidad, count(*) AS n FROM {{registry}} WHERE starts_with(clase_actividad_id, '{PHARMACY}') GROUP BY 1",
)
def class_prefix(t):
    return count_by(t.registry.filter(est.pharmacy_by_prefix(PHARMACY)), ["entidad"], "n")


@query(
    "search_by_name_page",
    """SELECT clee, nombre, entidad, latitud, longitud FROM {shops} WHERE nombre ILIKE '%omer#0000001%' ORDER BY clee LIMIT 20 OFFSET 20""",
)
def search_name(t):
    found = search(t.shops, "clee", "nombre", text="OMER#0000001", number=2, size=20)
    return found.select("clee", "nombre", "entidad", "latitud", "longitud")


@query(
    "search_by_trigrams",
    """SELECT clee, nombre, entidad, latitud, longitud FROM {shops} WHERE nombre ILIKE '%omer#0000001%'""",
)
def search_by_trigrams(t):
    """The same search through a stored index of the names' trigrams."""
    path = f"{scratch_folder(t.spark)}/shops"
    trigrams.write_index(t.shops.select("clee", "nombre", "entidad", "latitud", "longitud"), path, "nombre", ["clee"])
    return trigrams.containing(t.spark, path, "nombre", "OMER#0000001")


@query(
    "keyset_page",
    """SELECT clee, nombre FROM {shops} WHERE clee > 'E000000070' AND entidad <> '05' ORDER BY clee LIMIT 25""",
)
def keyset_page(t):
    return search(t.shops.filter(F.col("entidad") != "05"), "clee", "nombre", after="E000000070", size=25).select("clee", "nombre")


HAVERSINE = (
    "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(latitud - 19.4) / 2), 2) + cos(radians(19.4)) * cos(radians(latitud))"
    " * pow(sin(radians(longitud + 98.9) / 2), 2))))"
)


@query(
    "search_radius_in_state",
    f"""SELECT clee, nombre FROM {{shops}} WHERE entidad = '05' AND longitud IS NOT NULL AND {HAVERSINE} <= 150 ORDER BY clee LIMIT 50""",
)
def search_radius(t):
    found = search(t.shops, "clee", "nombre", state="05", around=(19.4, -98.9, 150.0), size=50)
    return found.select("clee", "nombre")


@query(
    "establishment_by_id",
    """SELECT clee, nombre, entidad, area_geo, clase_actividad_id FROM {shops} WHERE clee = 'E000000077'""",
)
def by_id(t):
    return filters.lookup_row(t.shops, "clee", "E000000077").select(
        "clee", "nombre", "entidad", "area_geo", "clase_actividad_id"
    )


GEOJSON_SQL = (
    """SELECT '<"type":"Feature","geometry":' || CASE WHEN longitud IS NULL THEN 'null' ELSE '<"type":"Point","coordinates":['
    || longitud || ',' || latitud || ']>' END || ',"properties":<"clee":"' || clee || '","nombre":"' || nombre || '","entidad":"'
    || entidad || '">>' AS value FROM shop_rows"""
)


@query("geojson_lines", f"SELECT replace(replace(value, '<', chr(123)), '>', chr(125)) AS value FROM ({GEOJSON_SQL.replace('shop_rows', '{shops}')})")
def geojson(t):
    return to_geojson_lines(t.shops, "longitud", "latitud", ["clee", "nombre", "entidad"], geometry_only=False)


@query(
    "geojson_missing_geometry",
    """SELECT count(*) AS total, count(*) FILTER (WHERE longitud IS NULL OR latitud IS NULL) AS without_geometry FROM {registry}""",
)
def geojson_missing(t):
    return without_geometry(t.registry, "longitud", "latitud")


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS rows FROM {lineitem} GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicates(t):
    return quality.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "required_nulls",
    "SELECT field, missing, (SELECT count(*) FROM {registry}) AS rows FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) FILTER (WHERE {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS missing FROM {{registry}}"
        for c in ("clee", "entidad", "area_geo", "ageb", "telefono", "longitud")
    ) + ")",
)
def required(t):
    return quality.required_nulls(t.registry, ["clee", "entidad", "area_geo", "ageb", "telefono", "longitud"])


@query(
    "registry_match_rate",
    f"""SELECT rows, matched, {ratio("matched", "rows", 100)} AS match_pct, {ratio("matched", "rows", 100)} >= 85 AS passed FROM (
      SELECT count(*) AS rows, {big("count(*) FILTER (WHERE area_geo IN (SELECT cve_mun FROM {lag}))")} AS matched FROM {{registry}})""",
)
def match_rate(t):
    return quality.match_rate(t.registry, t.lag.select(F.col("cve_mun").alias("area_geo")), "area_geo", 85)


PROFILE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "table_profile",
    " UNION ALL ".join(
        f"""SELECT count(*) AS row_count, '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
        round(CAST(sum(CAST({c} AS DECIMAL(28,4))) AS DOUBLE) / count({c}), 4) AS mean FROM {{lineitem}}"""
        for c in PROFILE
    ),
)
def profile(t):
    return quality.profile(t.lineitem).withColumn("mean", F.round("mean", 4))
