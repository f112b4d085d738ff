"""Tracts, places, distances, tiles, clusters, geocoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from demarca.operators import geocode, quality, spatial
from demarca.operators.joins import with_single
from demarca.plans import tracts
from demarca.plans.establishments import pharmacy_by_class
from demarca.sources import place_layout
from workbench.kit import big, dbl, query, ratio
from workbench.roles import CELL, rings
from workbench.scratch import scratch_folder

PHARMACY = ["464111", "464112"]
UNIT = "16000"


def areas(t):
    return rings(t.tract_boxes).select("cvegeo", "cve_mun", "ambito", "ring")


def clinic_points(t):
    return tracts.positioned_units(t.clinics.withColumnRenamed("clues", "clues"))


POINTS_SQL = """SELECT clues, CAST(longitud AS DOUBLE) AS lon, CAST(latitud AS DOUBLE) AS lat FROM {clinics}
  WHERE regexp_full_match(longitud, '-?[0-9]+[.]?[0-9]*') AND regexp_full_match(latitud, '-?[0-9]+[.]?[0-9]*')"""
# Area of a latitude-longitude box on the sphere, by the trapezoid sum the ring formula uses.
AREA_SQL = """round(abs(2 * radians(x1 - x0) * (sin(radians(y1)) - sin(radians(y0)))) * 6371.0088 * 6371.0088 / 2, 4)"""
SHAPE_SQL = f"""SELECT cvegeo, cve_mun, nullif(trim(ambito), '') AS ambito, round((x0 + x1) / 2, 6) AS centroid_lon, round((y0 + y1) / 2, 6) AS centroid_lat,
    {AREA_SQL} AS area_km2 FROM {{tract_boxes}}"""


def _inside(lon: str, lat: str, b: str = "b") -> str:
    return f"{lon} >= {b}.x0 AND {lon} < {b}.x1 AND {lat} >= {b}.y0 AND {lat} < {b}.y1"


CLUES_SQL = f"SELECT b.cvegeo, count(*) AS n FROM {{tract_boxes}} b JOIN ({POINTS_SQL}) p ON {_inside('p.lon', 'p.lat')} GROUP BY 1"
COUNTS_SQL = """SELECT ageb AS cvegeo, count(*) AS n, count(*) FILTER (WHERE clase_actividad_id IN ('464111', '464112')) AS f,
    count(*) FILTER (WHERE rama_actividad_id IN ('4641', '4611')) AS c FROM {registry} WHERE ageb <> '' GROUP BY 1"""
TRACTS_SQL = f"""SELECT a.cvegeo, ambito, centroid_lat, centroid_lon, area_km2, coalesce(e.n, 0) AS establecimientos, coalesce(e.f, 0) AS farmacias,
    coalesce(s.n, 0) AS clues, a.cve_mun FROM ({SHAPE_SQL}) a LEFT JOIN ({COUNTS_SQL}) e ON e.cvegeo = a.cvegeo LEFT JOIN ({CLUES_SQL}) s ON s.cvegeo = a.cvegeo"""


@query("area_shapes", SHAPE_SQL.replace("cve_mun, ", "").replace("FROM", ", x0 AS min_lon, y0 AS min_lat, x1 AS max_lon, y1 AS max_lat FROM"))
def area_shapes(t):
    a = areas(t).withColumn("ambito", F.nullif(F.trim("ambito"), F.lit("")))
    return spatial.area_geometry(a).drop("ring", "cve_mun")


@query("tracts_with_counts", f"SELECT * EXCLUDE (cve_mun) FROM ({TRACTS_SQL})")
def tracts_all(t):
    return tracts.tracts_of_municipality(
        areas(t), t.registry, clinic_points(t), None, pharmacy_by_class(), CELL, limit=None
    )


def _one_unit_counts(sql: str) -> str:
    return sql.replace("WHERE ageb <> ''", f"WHERE ageb <> '' AND area_geo = '{UNIT}'")


@query(
    "tracts_of_municipality",
    f"SELECT * EXCLUDE (cve_mun) FROM ({_one_unit_counts(TRACTS_SQL)}) WHERE cve_mun = '{UNIT}' ORDER BY area_km2 DESC, cvegeo LIMIT 3",
)
def tracts_one(t):
    return tracts.tracts_of_municipality(
        areas(t), t.registry, clinic_points(t), UNIT, pharmacy_by_class(), CELL, order="area", limit=3
    )


@query(
    "tract_pharmacy_opportunity",
    f"""SELECT x.cvegeo, ambito, centroid_lat, centroid_lon, area_km2, establecimientos AS num_establecimientos, farmacias AS num_farmacias,
      clues AS num_clues, c.pobtot AS population, CAST(clues * 5 + establecimientos * 3 - farmacias * 10 AS DOUBLE) / 10 AS score,
      {ratio("clues * 5 + establecimientos * 3 - farmacias * 10", "c.pobtot * 10", 1000, 3)} AS score_per_1k
    FROM ({TRACTS_SQL}) x LEFT JOIN {{tract_census}} c ON c.cvegeo = x.cvegeo""",
)
def pharmacy_opportunity(t):
    return tracts.pharmacy_opportunity(
        areas(t), t.registry, clinic_points(t), t.tract_census, None, pharmacy_by_class(), CELL, limit=None
    )


@query(
    "tract_activity_opportunity",
    f"""SELECT a.cvegeo, ambito, centroid_lat, centroid_lon, area_km2, coalesce(e.c, 0) AS target_count, coalesce(e.n, 0) AS total_estab, c.pobtot,
      l.grado AS rezago_grado, {ratio("nullif(c.pobtot, 0)", "coalesce(e.c, 0)")} AS score, {ratio("c.psinder", "c.pobtot", 100, 1)} AS pct_sin_cobertura_salud,
      {dbl("m.casos_dm2_promedio")} AS casos_dm2_muni, {dbl("m.casos_hta_promedio")} AS casos_hta_muni, {dbl("m.casos_obesidad_promedio")} AS casos_obesidad_muni
    FROM ({SHAPE_SQL}) a LEFT JOIN ({COUNTS_SQL}) e ON e.cvegeo = a.cvegeo LEFT JOIN {{tract_census}} c ON c.cvegeo = a.cvegeo
      LEFT JOIN {{tract_lag}} l ON l.cvegeo = a.cvegeo LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cve_mun ORDER BY anio DESC) AS rn FROM {{morbidity}}) m
        ON m.cve_mun = a.cve_mun AND m.rn = 1
    WHERE l.grado IN ('Alto', 'Muy alto')""",
)
def activity_opportunity(t):
    return tracts.activity_opportunity(
        areas(t), t.registry, t.tract_census, t.tract_lag, t.morbidity, None, ["4641", "4611"], ["Alto", "Muy alto"], limit=None
    )


@query(
    "tract_wide",
    """SELECT c.cvegeo, c.ageb AS cve_ageb, c.pobtot AS pobtot_ageb, l.grado AS grado_rezago_ageb FROM {tract_census} c
    LEFT JOIN {tract_lag} l ON l.cvegeo = c.cvegeo""",
)
def tract_wide(t):
    return tracts.tract_wide(t.tract_census, t.tract_lag)


TRACT = UNIT + "00010002"


@query(
    "tract_detail",
    f"""SELECT x.cvegeo, x.ambito, x.area_km2, c.pobtot, l.grado, x.establecimientos AS total_establecimientos, x.farmacias AS total_farmacias,
      x.clues AS total_clues, (SELECT string_agg(s || ':' || n, '|' ORDER BY n DESC, s) FROM (SELECT sector_actividad_id AS s, count(*) AS n FROM {{registry}}
        WHERE ageb = '{TRACT}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)) AS top_sectors,
      (SELECT count(*) FROM (SELECT 1 FROM {{tract_boxes}} b JOIN ({POINTS_SQL}) p ON {_inside('p.lon', 'p.lat')} WHERE b.cvegeo = '{TRACT}' LIMIT 30)) AS clinics_listed
    FROM ({TRACTS_SQL}) x LEFT JOIN {{tract_census}} c ON c.cvegeo = x.cvegeo LEFT JOIN {{tract_lag}} l ON l.cvegeo = x.cvegeo WHERE x.cvegeo = '{TRACT}'""",
)
def tract_detail(t):
    localities = t.census_raw.select(
        F.concat("entidad", "mun", "loc").alias("cve_loc"), F.col("pobtot").cast("long").alias("pobtot"), "nom_loc"
    )
    parts = tracts.tract_detail(
        areas(t), t.registry, clinic_points(t), t.tract_census, t.tract_lag, localities, TRACT, pharmacy_by_class(), CELL,
        top=10, sample=30,
    )

    sectors = parts["top_sectors"].agg(
        F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col("sector_actividad_id").alias("s")))).alias("_s")
    )
    text = F.transform("_s", lambda x: F.concat_ws(":", x["s"], (-x["n"]).cast("string")))
    clinics = parts["clinics"].agg(
        F.count(F.lit(1)).alias("clinics_listed"), F.coalesce(F.max("total_clues"), F.lit(0)).alias("total_clues")
    )
    out = parts["identity"].select("cvegeo", "ambito", "area_km2")
    for one in (parts["census"].select("pobtot"), parts["lag"].select("grado"), parts["totals"], clinics):
        out = with_single(out, one)
    return with_single(out, sectors.select(F.array_join(text, "|").alias("top_sectors")))


@query(
    "blocks_of_tract",
    """SELECT entidad || mun || loc || ageb || mza AS cvegeo_mza, mza, CAST(nullif(pobtot, '*') AS BIGINT) AS pobtot, CAST(nullif(pobfem, '*') AS BIGINT) AS pobfem,
      CAST(pobmas AS BIGINT) AS pobmas, CAST(tvivpar AS BIGINT) AS tvivpar, CAST(vph_inter AS BIGINT) AS vph_inter, CAST(vph_autom AS BIGINT) AS vph_autom
    FROM {tract_raw} WHERE entidad || mun || loc || ageb = (SELECT min(entidad || mun || loc || ageb) FROM {tract_raw} WHERE mza NOT IN ('000', '*'))
      AND mza NOT IN ('000', '*') ORDER BY CAST(nullif(pobtot, '*') AS BIGINT) DESC NULLS LAST, mza LIMIT 100""",
)
def blocks(t):
    from demarca.plans.census import block_census

    rows = block_census(t.tract_raw)
    return tracts.blocks_of_tract(rows, rows.agg(F.min("cvegeo_ageb")).scalar(), limit=100)


@query(
    "localities_of_municipality",
    """WITH l AS (SELECT entidad || mun || loc AS cve_loc, entidad || mun AS cve_mun, nom_loc, CAST(nullif(tamloc, '') AS BIGINT) AS tamloc,
        CASE WHEN altitud LIKE '00-%' THEN NULL ELSE CAST(altitud AS DOUBLE) END AS altitud_m, CAST(pobtot AS BIGINT) AS pobtot,
        CAST(tvivpar AS BIGINT) AS tvivpar, CAST(nullif(vph_inter, 'N/D') AS BIGINT) AS vph_inter FROM {census_raw} WHERE loc <> '0000' AND mun <> '000')
    SELECT cve_loc, nom_loc, tamloc, altitud_m, pobtot, tvivpar, vph_inter, (SELECT count(*) FROM l WHERE cve_mun = (SELECT min(cve_mun) FROM l)) AS total_localities
    FROM l WHERE cve_mun = (SELECT min(cve_mun) FROM l) ORDER BY vph_inter DESC NULLS LAST, cve_loc LIMIT 100""",
)
def localities(t):
    from demarca.plans.census import census

    rows = census(t.census_raw, "locality")
    return tracts.localities_of_municipality(rows, rows.agg(F.min("cve_mun")).scalar(), "vph_inter", limit=100)


@query(
    "blocks_of_largest_tract",
    """WITH b AS (SELECT entidad || mun || loc || ageb AS tract, mza, * FROM {tract_raw} WHERE mza NOT IN ('000', '*'))
    SELECT tract || mza AS cvegeo_mza, CAST(vph_inter AS BIGINT) AS vph_inter, row_number() OVER (ORDER BY CAST(vph_inter AS BIGINT) DESC NULLS LAST, mza) AS place
    FROM b WHERE tract = (SELECT tract FROM b GROUP BY 1 ORDER BY count(*) DESC, tract LIMIT 1) ORDER BY place LIMIT 3""",
)
def blocks_of_largest(t):
    """The first three blocks, by another order, of the tract that has most of them; their places show the order."""
    from demarca.plans.census import block_census

    rows = block_census(t.tract_raw)
    counts = rows.groupBy("cvegeo_ageb").agg((-F.count(F.lit(1))).alias("n"))
    largest = counts.agg(F.min(F.struct("n", "cvegeo_ageb"))["cvegeo_ageb"]).scalar()
    found = tracts.blocks_of_tract(rows, largest, "vph_inter", limit=3)
    return in_their_order(found).select("cvegeo_mza", "vph_inter", "place")


@query(
    "localities_of_largest_municipality",
    """WITH l AS (SELECT entidad || mun || loc AS cve_loc, entidad || mun AS cve_mun, CAST(pobtot AS BIGINT) AS pobtot FROM {census_raw} WHERE loc <> '0000' AND mun <> '000')
    SELECT cve_loc, pobtot, row_number() OVER (ORDER BY pobtot DESC NULLS LAST, cve_loc) AS place
    FROM l WHERE cve_mun = (SELECT cve_mun FROM l GROUP BY 1 ORDER BY count(*) DESC, cve_mun LIMIT 1) ORDER BY place LIMIT 4""",
)
def localities_of_largest(t):
    from demarca.plans.census import census

    rows = census(t.census_raw, "locality")
    counts = rows.groupBy("cve_mun").agg((-F.count(F.lit(1))).alias("n"))
    largest = counts.agg(F.min(F.struct("n", "cve_mun"))["cve_mun"]).scalar()
    found = tracts.localities_of_municipality(rows, largest, "pobtot", limit=4)
    return in_their_order(found).select("cve_loc", "pobtot", "place")


def in_their_order(limited):
    """A few ordered rows with their places; the rows of a sorted and limited result come in one partition."""
    return limited.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)


NOTCHED = "longitud >= x0 AND longitud < x1 AND latitud >= y0 AND latitud < y1 AND NOT (notched AND longitud >= xm AND latitud >= ym)"


@query(
    "points_to_areas",
    f"SELECT s.clee, b.cve_mun FROM {{shops}} s LEFT JOIN {{boxes}} b ON {NOTCHED}",
)
def points_to_areas(t):
    polys = rings(t.boxes, notched=True).select(F.col("cve_mun"), "ring")
    return spatial.point_in_polygon(t.shops, polys, ["cve_mun"], "longitud", "latitud", CELL, "left").select("clee", "cve_mun")


@query(
    "area_filled_where_missing",
    f"""SELECT s.clee, CASE WHEN s.num % 3 = 0 THEN b.cve_mun ELSE s.area_geo END AS area FROM {{shops}} s LEFT JOIN {{boxes}} b ON {NOTCHED}""",
)
def area_filled(t):
    polys = rings(t.boxes, notched=True).select("cve_mun", "ring")
    points = t.shops.withColumn("area", F.when(F.col("num") % 3 != 0, F.col("area_geo")))
    return spatial.assign_area(points, polys, "cve_mun", "longitud", "latitud", CELL, "area").select("clee", "area")


@query(
    "registry_points_per_area",
    """SELECT b.cve_mun, CAST(sum(n) AS BIGINT) AS points FROM (SELECT longitud, latitud, count(*) AS n FROM {registry} WHERE longitud IS NOT NULL
      GROUP BY 1, 2) s JOIN {boxes} b ON """ + NOTCHED + " GROUP BY 1",
)
def registry_per_area(t):
    polys = rings(t.boxes, notched=True).select("cve_mun", "ring")
    return spatial.points_per_area(t.registry, polys, "cve_mun", "longitud", "latitud", CELL)


def _haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (
        f"2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


@query(
    "within_radius",
    f"SELECT clee, round({_haversine('-98.0', '20.0', 'longitud', 'latitud')}, 6) AS distance_km FROM {{registry}} WHERE longitud IS NOT NULL AND {_haversine('-98.0', '20.0', 'longitud', 'latitud')} <= 25",
)
def within_radius(t):
    return spatial.within_radius(t.registry, "latitud", "longitud", 20.0, -98.0, 25.0).select(
        "clee", F.round("distance_km", 6).alias("distance_km")
    )


def laid_out(t, table: str):
    """A role written by place and read back."""
    path = f"{scratch_folder(t.spark)}/{table}"
    place_layout.lay_out(getattr(t, table), path, "longitud", "latitud")
    return t.spark.read.parquet(path)


@query(
    "within_radius_laid_out",
    f"SELECT clee, round({_haversine('-98.0', '20.0', 'longitud', 'latitud')}, 6) AS distance_km FROM {{registry}} WHERE longitud IS NOT NULL AND {_haversine('-98.0', '20.0', 'longitud', 'latitud')} <= 25",
)
def within_radius_laid_out(t):
    found = place_layout.within_radius(laid_out(t, "registry"), "latitud", "longitud", 20.0, -98.0, 25.0)
    return found.select("clee", F.round("distance_km", 6).alias("distance_km"))


@query(
    "within_box_laid_out",
    "SELECT clee, place_key IS NOT NULL AS keyed FROM (SELECT clee, longitud, latitud, 1 AS place_key FROM {shops}) WHERE longitud BETWEEN -99.5 AND -98.25 AND latitud BETWEEN 18.125 AND 21.75",
)
def within_box_laid_out(t):
    found = place_layout.within_box(laid_out(t, "shops"), "longitud", "latitud", -99.5, 18.125, -98.25, 21.75)
    return found.select("clee", F.col(place_layout.PLACE).isNotNull().alias("keyed"))


@query(
    "points_near_anchors",
    f"""SELECT p.clee FROM {{shops}} p WHERE p.longitud IS NOT NULL AND EXISTS (SELECT 1 FROM (SELECT DISTINCT longitud, latitud FROM {{shops}}
      WHERE segment = 'BUILDING' AND longitud IS NOT NULL) a WHERE {_haversine('p.longitud', 'p.latitud', 'a.longitud', 'a.latitud')} <= 9)""",
)
def near(t):
    anchors = t.shops.filter(F.col("segment") == "BUILDING")
    return spatial.near(t.shops, anchors, "longitud", "latitud", 9.0).select("clee")


_S = "sin(radians(latitud))"
TILE_SQL = f"""SELECT clee, 9 AS z, CAST(floor(fx) AS BIGINT) AS x, CAST(floor(fy) AS BIGINT) AS y, CAST(floor((fx - floor(fx)) * 4096) AS BIGINT) AS px,
    CAST(floor((fy - floor(fy)) * 4096) AS BIGINT) AS py FROM (SELECT clee, (longitud + 180) / 360 * 512 AS fx,
      (0.5 - ln((1 + {_S}) / (1 - {_S})) / (4 * pi())) * 512 AS fy FROM {{shops}} WHERE longitud IS NOT NULL)"""


@query("tile_rows", TILE_SQL.replace("9 AS z", "CAST(9 AS BIGINT) AS z"))
def tile_rows(t):
    return spatial.tile_points(t.shops, "clee", "longitud", "latitud", 9).select("clee", "z", "x", "y", "px", "py")


@query(
    "tile_rows_capped",
    f"""SELECT x, y, count(*) AS n, min(clee) AS first_clee, max(clee) AS last_clee FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY clee) AS rn
    FROM ({TILE_SQL})) WHERE rn <= 7 GROUP BY 1, 2""",
)
def tile_capped(t):
    rows = spatial.tile_points(t.shops, "clee", "longitud", "latitud", 9, cap=7)
    return rows.groupBy("x", "y").agg(
        F.count(F.lit(1)).alias("n"), F.min("clee").alias("first_clee"), F.max("clee").alias("last_clee")
    )


@query(
    "one_tile_of_a_state",
    f"""SELECT t.clee, px, py FROM ({TILE_SQL}) t JOIN {{shops}} s ON s.clee = t.clee WHERE s.entidad IN ('03', '21', '09') AND x = 115 AND y = 227""",
)
def one_tile(t):
    keep = F.col("entidad").isin("03", "21", "09")
    return spatial.one_tile(t.shops, "clee", "longitud", "latitud", 9, 115, 227, keep).select("clee", "px", "py")


@query(
    "one_tile_laid_out",
    f"""SELECT t.clee, px, py FROM ({TILE_SQL}) t JOIN {{shops}} s ON s.clee = t.clee WHERE s.entidad IN ('03', '21', '09') AND x = 115 AND y = 227""",
)
def one_tile_laid_out(t):
    keep = F.col("entidad").isin("03", "21", "09")
    laid = laid_out(t, "shops")
    return place_layout.one_tile(laid, "clee", "longitud", "latitud", 9, 115, 227, keep).select("clee", "px", "py")


@query("kmeans_cluster_summary")
def clusters(t):
    return spatial.cluster_summary(spatial.cluster_points(t.shops, "longitud", "latitud", 8), "longitud", "latitud")


@query("kmeans_cluster_members")
def cluster_members(t):
    return spatial.cluster_points(t.shops, "longitud", "latitud", 8).select("cluster_id", "clee")


CENTRES = [(-99.5, 18.5), (-98.0, 19.0), (-97.0, 21.5), (-99.0, 21.0), (-96.5, 18.25), (-98.0, 20.5)]
_AWAY = [f"(longitud - ({x})) * (longitud - ({x})) + (latitud - ({y})) * (latitud - ({y}))" for x, y in CENTRES]
ASSIGNED_SQL = f"""SELECT clee, longitud, latitud, CAST(CASE {" ".join(f"WHEN {a} <= least({', '.join(_AWAY)}) THEN {k}" for k, a in enumerate(_AWAY))} END AS BIGINT)
    AS cluster_id FROM {{shops}} WHERE longitud IS NOT NULL AND latitud IS NOT NULL"""


@query("clusters_of_given_centres", f"SELECT clee, cluster_id FROM ({ASSIGNED_SQL})")
def clusters_of_given_centres(t):
    return spatial.assign_to_centres(t.shops, "longitud", "latitud", CENTRES).select("clee", "cluster_id")


@query(
    "clusters_of_given_centres_summary",
    f"""SELECT cluster_id, round(avg(latitud), 6) AS centroid_lat, round(avg(longitud), 6) AS centroid_lon, count(*) AS member_count
      FROM ({ASSIGNED_SQL}) GROUP BY 1""",
)
def clusters_of_given_centres_summary(t):
    return spatial.cluster_summary(spatial.assign_to_centres(t.shops, "longitud", "latitud", CENTRES), "longitud", "latitud")


@query(
    "kmeans_checked",
    """SELECT count(*) AS points, CAST(8 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS not_at_nearest
      FROM {shops} WHERE longitud IS NOT NULL AND latitud IS NOT NULL""",
)
def kmeans_checked(t):
    """Every point is counted once and lies in the cluster of the centre nearest to it."""
    placed, centres = spatial.fit_clusters(t.shops, "longitud", "latitud", 8)
    away = [F.pow(F.col("longitud") - x, 2) + F.pow(F.col("latitud") - y, 2) for x, y in centres]
    own = F.element_at(F.array(*away), F.col("cluster_id") + 1)
    return placed.agg(
        F.count(F.lit(1)).alias("points"),
        F.count_distinct("cluster_id").alias("clusters"),
        F.count_if(own > F.least(*away) + 1e-9).alias("not_at_nearest"),
    )


def _square(x, y, side, back=False):
    ends = [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]
    points = [F.struct(F.lit(a).alias("lon"), F.lit(b).alias("lat")) for a, b in (ends[::-1] if back else ends)]
    return F.array(*points)


@query(
    "points_in_multipart_areas",
    """SELECT area, count(*) AS n, min(clee) AS first FROM (SELECT clee, CASE
        WHEN longitud >= -99.5 AND longitud < -98.0 AND latitud >= 18.5 AND latitud < 20.0
          AND NOT (longitud >= -99.0 AND longitud < -98.5 AND latitud >= 19.0 AND latitud < 19.5) THEN 'ring and island'
        WHEN longitud >= -97.5 AND longitud < -97.25 AND latitud >= 18.5 AND latitud < 18.75 THEN 'ring and island'
        WHEN longitud >= -99.0 AND longitud < -98.5 AND latitud >= 19.0 AND latitud < 19.5 THEN 'hole' END AS area FROM {shops})
      WHERE area IS NOT NULL GROUP BY 1""",
)
def points_in_multipart_areas(t):
    """One area with a hole and an island, and another one in the hole."""
    one = t.shops.limit(1)
    rings = F.array(_square(-99.5, 18.5, 1.5), _square(-99.0, 19.0, 0.5, back=True), _square(-97.5, 18.5, 0.25))
    areas = one.select(F.lit("ring and island").alias("area"), rings.alias("ring"))
    areas = areas.unionByName(one.select(F.lit("hole").alias("area"), F.array(_square(-99.0, 19.0, 0.5)).alias("ring")))
    found = spatial.point_in_polygon(t.shops, areas, ["area"], "longitud", "latitud", 0.1)
    return found.groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.min("clee").alias("first"))


RADIUS_POINTS = """SELECT l_orderkey AS k, l_linenumber AS line, CAST((l_partkey * 7919) % 720 AS DOUBLE) / 100 - 3.6 AS turn,
    CAST((l_orderkey * 6007) % 400 AS DOUBLE) / 100 - 2 AS lat FROM {lineitem}"""
_DATE_LINE = f"""SELECT k, line, lat, CASE WHEN turn < 0 THEN 180 + turn ELSE turn - 180 END AS lon FROM ({RADIUS_POINTS})"""


@query(
    "radius_across_date_line",
    f"""SELECT k, line, CAST(count(*) AS BIGINT) AS n FROM (SELECT k, line, 2 * 6371.0088 * asin(sqrt(least(1.0,
        pow(sin(radians(lat - 0.1) / 2), 2) + cos(radians(0.1)) * cos(radians(lat)) * pow(sin(radians(lon - 179.9) / 2), 2)))) AS d
      FROM ({_DATE_LINE})) WHERE d <= 90 GROUP BY 1, 2""",
)
def radius_across_date_line(t):
    k, part = F.col("l_orderkey"), F.col("l_partkey")
    turn = (part * 7919 % 720).cast("double") / 100 - 3.6
    points = t.lineitem.select(
        k.alias("k"),
        F.col("l_linenumber").alias("line"),
        ((k * 6007 % 400).cast("double") / 100 - 2).alias("lat"),
        F.when(turn < 0, 180 + turn).otherwise(turn - 180).alias("lon"),
    )
    return spatial.within_radius(points, "lat", "lon", 0.1, 179.9, 90.0).groupBy("k", "line").agg(F.count(F.lit(1)).alias("n"))


FOLD = "trim(regexp_replace(regexp_replace(upper(strip_accents(coalesce(colonia, ''))), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
GEO_SQL = f"""WITH r AS (SELECT state, postcode, mun, tract, CASE WHEN f = '' THEN [] ELSE string_split(f, ' ') END AS w FROM (SELECT *, {FOLD} AS f FROM {{geo_registry}}
      WHERE postcode <> '' AND state <> '')),
    t AS (SELECT num, state, postcode, CASE WHEN f = '' THEN [] ELSE string_split(f, ' ') END AS w FROM (SELECT *, {FOLD} AS f FROM {{geo_targets}})),
    hit AS (SELECT t.num, min(ROW(r.mun, r.tract)) AS p FROM t JOIN r ON r.state = t.state AND r.postcode = t.postcode WHERE len(t.w) > 0 AND len(r.w) > 0
      AND CASE WHEN len(t.w) <= len(r.w) THEN list_has_all(r.w, t.w) ELSE list_has_all(t.w, r.w) END GROUP BY 1),
    m AS (SELECT state, postcode, mun FROM (SELECT state, postcode, mun, row_number() OVER (PARTITION BY state, postcode ORDER BY count(*) DESC, mun) AS rn
      FROM r GROUP BY 1, 2, 3) WHERE rn = 1),
    mt AS (SELECT state, postcode, mun, tract FROM (SELECT r.state, r.postcode, r.mun, r.tract, row_number() OVER (PARTITION BY r.state, r.postcode
      ORDER BY count(*) DESC, r.tract) AS rn FROM r JOIN m ON m.state = r.state AND m.postcode = r.postcode AND m.mun = r.mun GROUP BY 1, 2, 3, 4) WHERE rn = 1)
    SELECT t.num, coalesce(p[1], mt.mun) AS cve_mun, coalesce(p[2], mt.tract) AS cvegeo,
      CASE WHEN p IS NOT NULL THEN 'cp_colonia' WHEN mt.mun IS NOT NULL THEN 'cp_modal' ELSE 'none' END AS geocode_method
    FROM t LEFT JOIN hit ON hit.num = t.num LEFT JOIN mt ON mt.state = t.state AND mt.postcode = t.postcode"""


def geocoded(t):
    return geocode.geocode_by_neighbors(t.geo_targets, t.geo_registry, "colonia", "colonia", "mun", "tract")


@query("licence_geocoding", GEO_SQL)
def licence_geocoding(t):
    return geocoded(t).select("num", "cve_mun", "cvegeo", "geocode_method")


@query(
    "geocoding_match_rate",
    f"""WITH g AS ({GEO_SQL}) SELECT rows, matched, {ratio("matched", "rows", 100)} AS match_pct, {ratio("matched", "rows", 100)} >= 50 AS passed
    FROM (SELECT count(*) AS rows, {big("count(*) FILTER (WHERE cve_mun IN (SELECT mun FROM r2))")} AS matched FROM g)""".replace(
        "WITH g AS (", "WITH r2 AS (SELECT DISTINCT mun FROM {geo_registry}), g AS (", 1
    ),
)
def geocoding_rate(t):
    known = t.geo_registry.select(F.col("mun").alias("cve_mun"))
    return quality.match_rate(geocoded(t), known, "cve_mun", 50)
