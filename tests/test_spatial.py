import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from demarca.operators import spatial

CONCAVE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]
RIGHT = [(4.0, 0.0), (6.0, 0.0), (6.0, 4.0), (4.0, 4.0), (4.0, 0.0)]
FILL = [(0.0, 4.0), (2.0, 1.0), (4.0, 4.0), (0.0, 4.0)]
SCHEMA = "area string, ring array<struct<lon:double,lat:double>>"


@pytest.fixture(scope="module")
def polygons(spark):
    return spark.createDataFrame([("concave", CONCAVE), ("right", RIGHT), ("fill", FILL)], SCHEMA)


def inside(x, y, ring):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


@pytest.mark.parametrize("cell", [0.5, 1.7, 100.0])
def test_point_in_polygon_equals_brute_force(spark, polygons, cell):
    r = random.Random(3)
    pts = [(i, r.uniform(-1, 7), r.uniform(-1, 5)) for i in range(400)]
    pts += [(1000 + i, float(x), float(y)) for i, (x, y) in enumerate([(4, 2), (0, 0), (2, 1), (6, 4), (4, 4), (3, 2.5)])]
    df = spark.createDataFrame(pts, "id long, lon double, lat double")
    got = rows(spatial.point_in_polygon(df, polygons, ["area"], "lon", "lat", cell, "left").select("id", "area"))
    rings = {"concave": CONCAVE, "right": RIGHT, "fill": FILL}
    want = []
    for i, x, y in pts:
        found = [a for a, ring in rings.items() if inside(x, y, ring)]
        assert len(found) <= 1  # a shared edge belongs to one side only
        want.append((i, found[0] if found else None))
    assert got == sorted(want, key=repr)


def test_shared_edge_belongs_to_one_area(spark, polygons):
    df = spark.createDataFrame([(1, 4.0, 2.0)], "id long, lon double, lat double")
    assert rows(spatial.point_in_polygon(df, polygons, ["area"], "lon", "lat", 1.0).select("area")) == [("right",)]


def test_geometry(spark, polygons):
    g = {r.area: r for r in spatial.area_geometry(polygons).collect()}
    assert (g["right"].centroid_lon, g["right"].centroid_lat) == (5.0, 2.0)
    assert (g["concave"].min_lon, g["concave"].max_lat) == (0.0, 4.0)
    want = math.radians(2) * (math.sin(math.radians(4)) - math.sin(0)) * 6371.0088**2
    assert abs(g["right"].area_km2 - want) / want < 1e-6


def test_counts_and_fill(spark, polygons):
    pts = spark.createDataFrame(
        [(1, 5.0, 1.0, None), (2, 5.0, 1.0, "kept"), (3, 5.5, 3.0, None), (4, 50.0, 50.0, None), (5, None, None, None)],
        "id long, lon double, lat double, area string",
    )
    assert rows(spatial.points_per_area(pts.drop("area"), polygons, "area", "lon", "lat", 1.0)) == [("right", 3)]
    got = rows(spatial.assign_area(pts, polygons, "area", "lon", "lat", 1.0, "area").select("id", "area"))
    assert got == [(1, "right"), (2, "kept"), (3, "right"), (4, None), (5, None)]


def haversine(a, b):
    (x1, y1), (x2, y2) = a, b
    dy, dx = math.radians(y2 - y1) / 2, math.radians(x2 - x1) / 2
    h = math.sin(dy) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(dx) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("lat0,km", [(0.0, 2.0), (19.4, 2.0), (60.0, 5.0), (-33.0, 40.0)])
def test_near_equals_brute_force(spark, lat0, km):
    r = random.Random(11)
    spread = km / 111 * 6
    pts = [(i, r.uniform(-spread, spread), lat0 + r.uniform(-spread, spread)) for i in range(300)]
    pts += [(400 + i, 0.0, lat0) for i in range(150)]  # a third of the points at one place
    anchors = [(r.uniform(-spread, spread), lat0 + r.uniform(-spread, spread)) for _ in range(12)] + [(0.0, lat0)] * 50
    p = spark.createDataFrame(pts, "id long, lon double, lat double")
    a = spark.createDataFrame(anchors, "lon double, lat double")
    got = {x.id for x in spatial.near(p, a, "lon", "lat", km).collect()}
    assert got == {i for i, x, y in pts if any(haversine((x, y), c) <= km for c in set(anchors))}


def test_near_of_dense_neighbouring_cells(spark):
    """Two crowds, apart by less than, about and more than the distance; no join of the plan makes pairs of their rows."""
    import numpy as np

    r, km, n = np.random.default_rng(5), 9.0, 6000
    step = math.degrees(km / 6371.0088)
    crowd = lambda x: np.stack([x + r.uniform(0, step / 3, n), 20 + r.uniform(0, step / 3, n)], axis=1)
    left, right = crowd(0.0), np.concatenate([crowd(step * 0.75), crowd(step * 1.2), crowd(step * 3)])
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(right)], "id long, lon double, lat double")
    a = spark.createDataFrame([tuple(map(float, x)) for x in left], "lon double, lat double")
    df = spatial.near(p, a, "lon", "lat", km)
    got = {x.id for x in df.collect()}
    x1, y1, x2, y2 = (np.radians(v) for v in (right[:, :1], right[:, 1:], left[:, 0], left[:, 1]))
    h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
    want = set(np.flatnonzero((2 * 6371.0088 * np.arcsin(np.sqrt(h)) <= km).any(axis=1)).tolist())
    assert got == want and n < len(want) < 2 * n
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("km", [30.0, 400.0])
def test_near_across_the_date_line_and_far_north(spark, km):
    r = random.Random(8)
    pts = [(i, r.choice([180.0, -180.0]) * r.uniform(0.99, 1.0), r.uniform(70, 78)) for i in range(150)]
    anchors = [(r.choice([180.0, -180.0]) * r.uniform(0.99, 1.0), r.uniform(70, 78)) for _ in range(6)]
    got = spatial.near(spark.createDataFrame(pts, "id long, lon double, lat double"), spark.createDataFrame(anchors, "lon double, lat double"), "lon", "lat", km)
    assert {x.id for x in got.collect()} == {i for i, x, y in pts if any(haversine((x, y), c) <= km for c in anchors)}


def test_radius_limits_and_pushdown(spark, small):
    df = spark.createDataFrame([(1, 19.40, -99.1), (2, 19.41, -99.1), (3, 20.4, -99.1)], "id long, lat double, lon double")
    assert [r.id for r in spatial.within_radius(df, "lat", "lon", 19.40, -99.1, 2.0).collect()] == [1, 2]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            spatial.within_radius(df, "lat", "lon", 0, 0, bad)


def test_tiles(spark):
    pts = [(i, -99.0 + i * 1e-5, 19.0) for i in range(100)] + [(200, 0.0, 0.0), (201, 180.0, 89.0)]
    df = spark.createDataFrame(pts, "id long, lon double, lat double")
    capped = spatial.tile_points(df, "id", "lon", "lat", 4, cap=10)
    assert sorted(r.id for r in capped.collect()) == [*range(10), 200, 201]
    assert all(0 <= r.x < 16 and 0 <= r.y < 16 for r in capped.collect())
    one = spatial.one_tile(df, "id", "lon", "lat", 1, 1, 1).collect()
    assert [(r.id, r.px, r.py) for r in one] == [(200, 0, 0)]


def test_kmeans_invariants(spark):
    pts = [(i, cx + i % 5 * 0.01, cy) for i in range(60) for cx, cy in [((i % 3) * 10.0, (i % 3) * 10.0)]]
    df = spark.createDataFrame(pts, "id long, lon double, lat double")
    c = spatial.cluster_points(df, "lon", "lat", 3)
    s = spatial.cluster_summary(c, "lon", "lat").collect()
    assert sorted(r.member_count for r in s) == [20, 20, 20] and c.count() == 60
    for bad in (0, -1):
        with pytest.raises(ValueError):
            spatial.cluster_points(df, "lon", "lat", bad)


def test_flags(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0)], "lon double, lat double")
    assert [r.has_point for r in spatial.with_point(df, "lon", "lat").collect()] == [False, True]
    assert spatial.with_point(df, "lon", "lat").filter(F.col("has_point")).count() == 1


def test_rows_that_need_no_place_stay_out_of_the_join(spark):
    """Filled rows and rows without a position are not joined, so they can't share a NULL key."""
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    areas = spark.createDataFrame([("A", square)], "area string, ring array<struct<lon:double,lat:double>>")
    rows = [(i, 0.5 if i % 2 else None, 0.5, "B" if i % 10 else None) for i in range(100)]
    points = spark.createDataFrame(rows, "id long, lon double, lat double, code string")
    out = spatial.assign_area(points, areas, "area", "lon", "lat", 0.5, "code")
    got = {r.id: r.code for r in out.collect()}
    assert len(got) == 100 and got[1] == "B" and got[10] is None
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(code" in plan and "isnotnull(lon" in plan


def test_distance_searches_cross_the_date_line(spark):
    points = spark.createDataFrame([(1, 0.0, 179.95), (2, 0.0, -179.95), (3, 0.0, 170.0)], "id long, lat double, lon double")
    assert {r.id for r in spatial.within_radius(points, "lat", "lon", 0.0, 179.99, 50.0).collect()} == {1, 2}
    anchors = spark.createDataFrame([(9, 0.0, -179.99)], "id long, lat double, lon double")
    assert {r.id for r in spatial.near(points, anchors, "lon", "lat", 20.0).collect()} == {1, 2}


def test_geometry_of_a_ring_with_a_hole(spark):
    outer = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    hole = [(0.5, 0.5), (0.5, 1.5), (1.5, 1.5), (1.5, 0.5), (0.5, 0.5)]
    kind = "area string, ring array<array<struct<lon:double,lat:double>>>"
    both = spatial.area_geometry(spark.createDataFrame([("A", [outer, hole])], kind)).first()
    one = spatial.area_geometry(spark.createDataFrame([("A", [outer])], kind)).first()
    less = spatial.area_geometry(spark.createDataFrame([("A", [hole])], kind)).first()
    assert (both.centroid_lon, both.centroid_lat) == (1.0, 1.0)
    assert abs(both.area_km2 - (one.area_km2 - less.area_km2)) < 0.01
