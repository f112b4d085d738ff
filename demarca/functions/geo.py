"""Geometry on plain columns: points are two doubles, a polygon is one ring or several.

A ring is ``array<struct<lon:double,lat:double>>`` whose last point repeats the
first. Containment uses a half-open edge rule, so a point on an edge shared by
two polygons belongs to exactly one of them. Distances and areas are spherical.
Searches by distance wrap around the date line.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088  # mean radius
TILE_EXTENT = 4096


def has_point(lon: Column, lat: Column) -> Column:
    return lon.isNotNull() & lat.isNotNull()


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in kilometres."""
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def degrees_around(lat: float, km: float) -> tuple[float, float]:
    """Half-widths (lon, lat) in degrees of a box that holds the circle."""
    dlat = math.degrees(km / EARTH_KM)
    reach = min(89.999, abs(lat) + dlat)
    dlon = 360.0 if reach >= 89.99 else math.degrees(km / (EARTH_KM * math.cos(math.radians(reach))))
    return dlon, dlat


def cell_of(lon: Column, lat: Column, size: float) -> tuple[Column, Column]:
    """Grid cell of a point, as two integers."""
    return F.floor(lon / F.lit(size)).cast("long"), F.floor(lat / F.lit(size)).cast("long")


def ring_edges(ring: Column) -> Column:
    """Consecutive point pairs as ``array<struct<x1,y1,x2,y2>>``."""
    heads = F.slice(ring, F.lit(1), F.size(ring) - 1)
    tails = F.slice(ring, F.lit(2), F.size(ring) - 1)
    return F.zip_with(
        heads,
        tails,
        lambda a, b: F.struct(
            a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")
        ),
    )


def point_in_ring(lon: Column, lat: Column, edges: Column) -> Column:
    """Ray casting over precomputed edges."""

    def crossing(e: Column) -> Column:
        at = (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        straddles = (e["y1"] > lat) != (e["y2"] > lat)
        return F.when(straddles, F.when(lon < at, 1).otherwise(0)).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda n, e: n + crossing(e)) % 2 == 1


def ring_bbox(ring: Column) -> dict[str, Column]:
    lons = F.transform(ring, lambda p: p["lon"])
    lats = F.transform(ring, lambda p: p["lat"])
    return {
        "min_lon": F.array_min(lons),
        "min_lat": F.array_min(lats),
        "max_lon": F.array_max(lons),
        "max_lat": F.array_max(lats),
    }


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Area-weighted centroid (lon, lat) by the shoelace sums, taken about the first point."""
    edges = ring_edges(ring)
    ox, oy = ring[0]["lon"], ring[0]["lat"]

    def summed(term) -> Column:
        return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + term(e))

    def cross(e: Column) -> Column:
        return (e["x1"] - ox) * (e["y2"] - oy) - (e["x2"] - ox) * (e["y1"] - oy)

    twice_area = F.nullif(summed(cross), F.lit(0.0))
    x = summed(lambda e: (e["x1"] + e["x2"] - 2 * ox) * cross(e)) / (3 * twice_area) + ox
    y = summed(lambda e: (e["y1"] + e["y2"] - 2 * oy) * cross(e)) / (3 * twice_area) + oy
    return x, y


def ring_twice_area(ring: Column) -> Column:
    """Twice the signed planar area of a ring, positive if it runs against the clock."""
    ox, oy = ring[0]["lon"], ring[0]["lat"]
    return F.aggregate(
        ring_edges(ring),
        F.lit(0.0),
        lambda acc, e: acc + (e["x1"] - ox) * (e["y2"] - oy) - (e["x2"] - ox) * (e["y1"] - oy),
    )


def ring_area_km2(ring: Column) -> Column:
    """Area on the sphere in square kilometres."""
    total = F.aggregate(
        ring_edges(ring),
        F.lit(0.0),
        lambda acc, e: acc
        + F.radians(e["x2"] - e["x1"]) * (2 + F.sin(F.radians(e["y1"])) + F.sin(F.radians(e["y2"]))),
    )
    return F.abs(total) * F.lit(EARTH_KM * EARTH_KM / 2)


def mercator_unit(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web-mercator position in 0..1, origin at the north-west corner."""
    bounded = F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat))
    s = F.sin(F.radians(bounded))
    x = (lon + 180.0) / 360.0
    y = F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * math.pi)
    return x, y
