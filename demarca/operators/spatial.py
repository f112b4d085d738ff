"""Spatial operators on plain columns.

Joins by place go through a grid: both sides get integer cells, an equi-join on
the cell finds candidates and an exact test decides. Choose ``cell`` (degrees)
near the usual size of an area, so that few areas share a cell and few cells
cover an area.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from demarca.functions import geo
from demarca.operators.ordered import smallest_per_group

MAX_ZOOM = 22


def with_point(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Flag rows that carry both coordinates."""
    return df.withColumn("has_point", geo.has_point(F.col(lon), F.col(lat)))


def _rings(polygons: DataFrame, ring: str) -> Column:
    """The rings of an area: a column of one ring, or of several."""
    several = isinstance(polygons.schema[ring].dataType.elementType, ArrayType)
    return F.col(ring) if several else F.array(F.col(ring))


def area_geometry(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """Centroid and bounds to 6 digits, area in square kilometres to 4.

    Of several rings, those that run against the first one's direction are holes.
    """
    if isinstance(polygons.schema[ring].dataType.elementType, ArrayType):
        return _several_geometry(polygons, ring)
    x, y = geo.ring_centroid(F.col(ring))
    bounds = {k: F.round(c, 6) for k, c in geo.ring_bbox(F.col(ring)).items()}
    return polygons.withColumns(
        {
            "centroid_lon": F.round(x, 6),
            "centroid_lat": F.round(y, 6),
            "area_km2": F.round(geo.ring_area_km2(F.col(ring)), 4),
            **bounds,
        }
    )


def _several_geometry(polygons: DataFrame, ring: str) -> DataFrame:
    """``area_geometry`` of areas with several rings: signed sums of the rings' areas and moments."""
    rings, points = F.col(ring), F.flatten(F.col(ring))

    def summed(term) -> Column:
        return F.aggregate(F.transform(rings, term), F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))

    twice = summed(geo.ring_twice_area)
    x = summed(lambda r: geo.ring_centroid(r)[0] * geo.ring_twice_area(r)) / F.nullif(twice, F.lit(0.0))
    y = summed(lambda r: geo.ring_centroid(r)[1] * geo.ring_twice_area(r)) / F.nullif(twice, F.lit(0.0))
    size = F.abs(summed(lambda r: geo.ring_area_km2(r) * F.sign(geo.ring_twice_area(r))))
    bounds = {k: F.round(c, 6) for k, c in geo.ring_bbox(points).items()}
    return polygons.withColumns(
        {"centroid_lon": F.round(x, 6), "centroid_lat": F.round(y, 6), "area_km2": F.round(size, 4), **bounds}
    )


def area_cells(polygons: DataFrame, area: list[str], cell: float, ring: str = "ring") -> DataFrame:
    """One row per area and grid cell its bounds touch, with bounds and edges for the exact test.

    ``ring`` holds one ring, or an array of rings: parts and holes, told apart by counting
    crossings. A cell carries only the edges that a ray to the east from inside it can
    cross; a cell without any lies outside and is dropped.
    """
    rings = _rings(polygons, ring)
    box = geo.ring_bbox(F.flatten(rings))

    def span(lo: Column, hi: Column) -> Column:
        return F.sequence(F.floor(lo / F.lit(cell)).cast("long"), F.floor(hi / F.lit(cell)).cast("long"))

    def reachable(e: Column) -> Column:
        slack = cell * 1e-6
        south, west = F.col("_cy") * F.lit(cell) - slack, F.col("_cx") * F.lit(cell) - slack
        across = (F.least(e["y1"], e["y2"]) <= south + cell + 2 * slack) & (F.greatest(e["y1"], e["y2"]) >= south)
        return across & (F.greatest(e["x1"], e["x2"]) >= west)

    return (
        polygons.select(
            *area,
            *[c.alias(f"_{k}") for k, c in box.items()],
            F.flatten(F.transform(rings, geo.ring_edges)).alias("_edges"),
        )
        .withColumn("_cx", F.explode(span(F.col("_min_lon"), F.col("_max_lon"))))
        .withColumn("_cy", F.explode(span(F.col("_min_lat"), F.col("_max_lat"))))
        .withColumn("_edges", F.filter("_edges", reachable))
        .filter(F.size("_edges") > 0)
    )


def _inside(lon: Column, lat: Column) -> Column:
    within_box = lon.between(F.col("_min_lon"), F.col("_max_lon")) & lat.between(F.col("_min_lat"), F.col("_max_lat"))
    return within_box & geo.point_in_ring(lon, lat, F.col("_edges"))


def _place_join(points: DataFrame, cells: DataFrame, lon: str, lat: str, cell: float, how: str) -> DataFrame:
    px, py = geo.cell_of(F.col(lon), F.col(lat), cell)
    p = points.withColumns({"_px": px, "_py": py})
    on = (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")) & _inside(F.col(lon), F.col(lat))
    helper = ["_px", "_py", "_cx", "_cy", "_edges", "_min_lon", "_min_lat", "_max_lon", "_max_lat"]
    known = geo.has_point(F.col(lon), F.col(lat))
    found = p.filter(known).join(cells, on, how).drop(*helper)
    if how != "left":
        return found
    # Rows without a position match nothing; they stay out of the join, where they would share one key.
    return found.unionByName(points.filter(~known), allowMissingColumns=True)


def point_in_polygon(
    points: DataFrame, polygons: DataFrame, area: list[str], lon: str, lat: str, cell: float, how: str = "inner"
) -> DataFrame:
    """Points with the columns of the area that holds them; ``how="left"`` keeps the rest.

    Areas must not overlap, or a point is returned once per area.
    """
    return _place_join(points, area_cells(polygons, area, cell), lon, lat, cell, how)


def assign_area(
    points: DataFrame, polygons: DataFrame, area: str, lon: str, lat: str, cell: float, into: str
) -> DataFrame:
    """Fill a missing area code from the position; codes already present stay."""
    code = "_found"
    poly = polygons.withColumnRenamed(area, code)
    found = point_in_polygon(points.filter(F.col(into).isNull()), poly, [code], lon, lat, cell, "left")
    found = found.withColumn(into, F.col(code)).drop(code)
    return found.unionByName(points.filter(F.col(into).isNotNull()))


def points_per_area(
    points: DataFrame, polygons: DataFrame, area: str, lon: str, lat: str, cell: float, name: str = "points"
) -> DataFrame:
    """Points inside each area that has any; equal positions are counted before the join."""
    spots = points.filter(geo.has_point(F.col(lon), F.col(lat))).groupBy(lon, lat).agg(F.count(F.lit(1)).alias("_n"))
    hits = point_in_polygon(spots, polygons, [area], lon, lat, cell)
    return hits.groupBy(area).agg(F.sum("_n").alias(name))


def within_radius(df: DataFrame, lat: str, lon: str, at_lat: float, at_lon: float, km: float) -> DataFrame:
    """Rows within a distance of a position, with the distance; a box on plain columns goes first.

    A box across the date line is two ranges of longitudes.
    """
    if km <= 0:
        raise ValueError("radius must be above 0")
    dlon, dlat = geo.degrees_around(at_lat, km)
    box = F.col(lat).between(at_lat - dlat, at_lat + dlat)
    if dlon < 180.0:
        ranges = [(at_lon - dlon, at_lon + dlon)]
        ranges += [(lo + turn, hi + turn) for lo, hi in ranges for turn in (-360.0, 360.0) if abs(at_lon) + dlon > 180.0]
        box = box & reduce(or_, [F.col(lon).between(lo, hi) for lo, hi in ranges])
    away = geo.haversine_km(F.lit(at_lon), F.lit(at_lat), F.col(lon), F.col(lat))
    return df.filter(box).withColumn("distance_km", away).filter(F.col("distance_km") <= km)


#: Parts of a cell's side in ``near``, on each of two levels.
PARTS = 8


def near(points: DataFrame, anchors: DataFrame, lon: str, lat: str, km: float) -> DataFrame:
    """Points with at least one anchor within ``km``; both sides use the same column names.

    Two points of one grid cell are never further apart than ``km``, so cells that
    hold an anchor settle all their points. Other cells and the anchors' cells around
    them are cut into parts, and parts into parts again: a pair of parts that is surely
    within reach settles the points of one, a pair out of reach is dropped. What pairs
    there can be depends on the number of parts, not of points, so dense neighbouring
    cells don't meet row by row. Only pairs of parts that stay open are tested, and the
    test stops at the first anchor found. An anchor near the date line also stands a turn
    further on the other side.
    """
    side = geo.degrees_around(0.0, km)[1] / 1.4143
    sizes = [side, side / PARTS, side / PARTS**2]
    known = geo.has_point(F.col(lon), F.col(lat))

    def cells(df: DataFrame, x: str, y: str, mark: str) -> DataFrame:
        places = [geo.cell_of(F.col(x), F.col(y), s) for s in sizes]
        return df.withColumns({f"_{mark}{k}{axis}": c for k, at in enumerate(places) for axis, c in zip("xy", at)})

    def names(mark: str, *levels: int) -> list[str]:
        return [f"_{mark}{k}{axis}" for k in levels for axis in "xy"]

    p = cells(points.filter(known), lon, lat, "p")
    a = anchors.filter(known).select(F.col(lon).alias("_ax"), F.col(lat).alias("_ay")).distinct()
    home = cells(a, "_ax", "_ay", "p").select(*names("p", 0)).distinct()
    dlat = F.lit(geo.degrees_around(0.0, km)[1] * (1 + 1e-9))
    dlon = dlat / F.cos(F.radians(F.least(F.lit(89.0), F.abs(F.col("_ay")) + dlat)))
    turns = F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0))
    within = F.filter(turns, lambda turn: F.abs(F.col("_ax") + turn) <= 180.0 + dlon)
    a = a.withColumn("_turn", F.explode(within)).withColumn("_ax", F.col("_ax") + F.col("_turn")).drop("_turn")
    a = cells(a, "_ax", "_ay", "a")

    def span(cell: str, reach: Column) -> Column:
        low = F.floor((F.col(cell) * sizes[1] - reach) / F.lit(side)).cast("long")
        high = F.floor(((F.col(cell) + 1) * sizes[1] + reach) / F.lit(side)).cast("long")
        return F.sequence(low, high)

    edge = F.greatest(F.abs(F.col("_a1y")), F.abs(F.col("_a1y") + 1)) * sizes[1] + dlat
    wide = dlat / F.cos(F.radians(F.least(F.lit(89.0), edge)))
    around = a.select(*names("a", 1)).distinct()
    around = around.withColumn("_p0x", F.explode(span("_a1x", wide))).withColumn("_p0y", F.explode(span("_a1y", dlat)))
    parts = p.select(*names("p", 0, 1, 2)).distinct()
    rest = parts.join(home, names("p", 0), "left_anti")

    def judged(pairs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """Parts that are settled, and the pairs of other parts that are neither in nor out of reach."""
        low, high = _reach(*[F.col(n) for n in [*names("p", k), *names("a", k)]], sizes[k])
        pairs = pairs.withColumns({"_low": low, "_high": high}).filter(F.col("_low") <= km * (1 + 1e-9))
        settled = pairs.filter(F.col("_high") <= km * (1 - 1e-9)).select(*names("p", k)).distinct()
        return settled, pairs.drop("_low", "_high").join(settled, names("p", k), "left_anti")

    first, open_ = judged(rest.select(*names("p", 0, 1)).distinct().join(around, names("p", 0)).drop(*names("p", 0)), 1)
    finer = open_.join(rest.select(*names("p", 1, 2)), names("p", 1)).join(a.select(*names("a", 1, 2)).distinct(), names("a", 1))
    second, open_ = judged(finer, 2)
    settled = parts.join(home, names("p", 0), "left_semi").select(*names("p", 2))
    settled = settled.unionByName(rest.join(first, names("p", 1), "left_semi").select(*names("p", 2))).unionByName(second)
    tested = open_.select(*names("p", 2), *names("a", 2)).join(a.select(*names("a", 2), "_ax", "_ay"), names("a", 2))
    tested = tested.withColumnsRenamed({n: f"_t{n}" for n in names("p", 2)})
    on = [F.col(n) == F.col(f"_t{n}") for n in names("p", 2)]
    on = on[0] & on[1] & (geo.haversine_km(F.col(lon), F.col(lat), F.col("_ax"), F.col("_ay")) <= km)
    found = p.join(settled, names("p", 2), "left_semi").unionByName(p.join(tested, on, "left_semi"))
    return found.drop(*names("p", 0, 1, 2))


def _reach(px: Column, py: Column, ax: Column, ay: Column, side: float) -> tuple[Column, Column]:
    """Bounds of the distances between the positions of two cells of one grid, in kilometres."""

    def cosines(row: Column) -> tuple[Column, Column]:
        ends = [F.cos(F.radians(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), (row + k) * side)))) for k in (0, 1)]
        return F.least(*ends), F.when((row == 0) | (row == -1), F.lit(1.0)).otherwise(F.greatest(*ends))

    def apart(x: Column, y: Column, cos: Column) -> Column:
        half = F.sin(F.radians(F.least(F.lit(180.0), x)) / 2)
        across = F.sin(F.radians(F.least(F.lit(180.0), y)) / 2)
        return F.lit(2 * geo.EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), across * across + cos * half * half)))

    (p_low, p_high), (a_low, a_high) = cosines(py), cosines(ay)
    x, y = F.abs(px - ax), F.abs(py - ay)
    nearest = apart(F.greatest(F.lit(0), x - 1) * side, F.greatest(F.lit(0), y - 1) * side, F.greatest(F.lit(0.0), p_low * a_low))
    furthest = apart((x + 1) * side, (y + 1) * side, p_high * a_high)
    return nearest, furthest


def cluster_points(df: DataFrame, lon: str, lat: str, k: int, seed: int = 7) -> DataFrame:
    """Every point with a k-means cluster number (``cluster_id``).

    Fitting runs Spark jobs when this function is called.
    """
    return fit_clusters(df, lon, lat, k, seed)[0]


def fit_clusters(
    df: DataFrame, lon: str, lat: str, k: int, seed: int = 7
) -> tuple[DataFrame, list[tuple[float, float]]]:
    """Every point with its cluster number, and the clusters' centres (lon, lat) in the order of their numbers."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    known = df.filter(geo.has_point(F.col(lon), F.col(lat)))
    points = VectorAssembler(inputCols=[lon, lat], outputCol="_at").transform(known)
    model = KMeans(k=k, seed=seed, featuresCol="_at", predictionCol="cluster_id").fit(points.select("_at"))
    return model.transform(points).drop("_at"), [(float(x), float(y)) for x, y in model.clusterCenters()]


def assign_to_centres(df: DataFrame, lon: str, lat: str, centres: list[tuple[float, float]]) -> DataFrame:
    """Every point with the number of the given centre (lon, lat) nearest to it, in degrees; the smaller one of equals.

    With the centres of an earlier fit, new points join its clusters without fitting again.
    """
    if not centres:
        raise ValueError("no centres")
    away = F.array(*[(F.col(lon) - x) * (F.col(lon) - x) + (F.col(lat) - y) * (F.col(lat) - y) for x, y in centres])
    known = df.filter(geo.has_point(F.col(lon), F.col(lat)))
    return known.withColumn("cluster_id", (F.array_position(away, F.array_min(away)) - 1).cast("int"))


def cluster_summary(clustered: DataFrame, lon: str, lat: str) -> DataFrame:
    """Centroid to 6 digits and size of each cluster."""
    return clustered.groupBy("cluster_id").agg(
        F.round(F.avg(lat), 6).alias("centroid_lat"),
        F.round(F.avg(lon), 6).alias("centroid_lon"),
        F.count(F.lit(1)).alias("member_count"),
    )


def tile_points(
    df: DataFrame, ident: str, lon: str, lat: str, z: int, keep: Column | None = None, cap: int | None = None
) -> DataFrame:
    """Points as rows of map tiles: tile x and y, and the position inside the tile.

    All points, or at most ``cap`` per tile, those with the smallest ids; ``beyond_cap``
    counts what a cap leaves out.
    """
    if not 0 <= z <= MAX_ZOOM:
        raise ValueError(f"zoom must be between 0 and {MAX_ZOOM}")
    rows = df.filter(geo.has_point(F.col(lon), F.col(lat)))
    if keep is not None:
        rows = rows.filter(keep)
    ux, uy = geo.mercator_unit(F.col(lon), F.col(lat))
    tiles = float(2**z)
    top = F.lit(2**z - 1).cast("long")
    rows = rows.withColumns({"_fx": ux * tiles, "_fy": uy * tiles})
    rows = rows.withColumns(
        {
            "z": F.lit(z),
            "x": F.least(top, F.greatest(F.lit(0).cast("long"), F.floor("_fx").cast("long"))),
            "y": F.least(top, F.greatest(F.lit(0).cast("long"), F.floor("_fy").cast("long"))),
        }
    )
    rows = rows.withColumns(
        {
            "px": F.floor((F.col("_fx") - F.col("x")) * geo.TILE_EXTENT).cast("long"),
            "py": F.floor((F.col("_fy") - F.col("y")) * geo.TILE_EXTENT).cast("long"),
        }
    ).drop("_fx", "_fy")
    if cap is None:
        return rows
    return smallest_per_group(rows, ["z", "x", "y"], ident, cap)


def beyond_cap(tiled: DataFrame, cap: int) -> DataFrame:
    """Tiles with more than ``cap`` points, and how many points a cap leaves out (``left_out``)."""
    counts = tiled.groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > cap)
    return counts.select("z", "x", "y", (F.col("_n") - cap).alias("left_out"))


def tile_bounds(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """(min_lon, min_lat, max_lon, max_lat) of one tile, as constants for a scan filter."""
    import math

    n = 2**z

    def lat_at(row: float) -> float:
        return math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * row / n))))

    return x / n * 360.0 - 180.0, lat_at(y + 1), (x + 1) / n * 360.0 - 180.0, lat_at(y)


def one_tile(
    df: DataFrame, ident: str, lon: str, lat: str, z: int, x: int, y: int, keep: Column | None = None,
    cap: int | None = None,
) -> DataFrame:
    """The rows of one tile; its bounds become a plain range filter that the scan can use."""
    west, south, east, north = tile_bounds(z, x, y)
    slack = 1e-9
    box = F.col(lon).between(west - slack, east + slack) & F.col(lat).between(south - slack, north + slack)
    rows = tile_points(df.filter(box), ident, lon, lat, z, keep, cap)
    return rows.filter((F.col("x") == x) & (F.col("y") == y))
