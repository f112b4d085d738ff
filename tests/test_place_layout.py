"""Tables laid out by place: covers hold all positions, searches give the plain rows and read fewer of them."""

import random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from demarca.operators import spatial
from demarca.operators.search import search
from demarca.sources import place_layout

SIDE = 1 << place_layout.BITS


def brute_key(lon, lat):
    x, y = (min(SIDE - 1, max(0, int(u * SIDE // 1))) for u in place_layout._unit(lon, lat))
    return sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(place_layout.BITS))


LONS, LATS = st.floats(-180, 180), st.floats(-90, 90)


@settings(max_examples=300, deadline=None)
@given(a=LONS, b=LONS, c=LATS, d=LATS, u=st.floats(0, 1), v=st.floats(0, 1), most=st.integers(4, 80))
def test_a_cover_holds_every_position_of_its_box(a, b, c, d, u, v, most):
    west, east, south, north = min(a, b), max(a, b), min(c, d), max(c, d)
    ranges = place_layout.box_ranges(west, south, east, north, most)
    assert 0 < len(ranges) <= most
    assert all(p[1] + 1 < q[0] for p, q in zip(ranges, ranges[1:], strict=False))
    lon, lat = min(east, west + u * (east - west)), min(north, south + v * (north - south))
    assert any(lo <= brute_key(lon, lat) <= hi for lo, hi in ranges)


def test_a_cover_is_close(spark):
    ranges = place_layout.box_ranges(-99.3, 19.2, -99.0, 19.6)
    (x0, y0), (x1, y1) = place_layout._unit(-99.3, 19.6), place_layout._unit(-99.0, 19.2)
    assert sum(hi - lo + 1 for lo, hi in ranges) < 2 * (x1 - x0) * (y1 - y0) * SIDE * SIDE


def test_tiles_are_one_range():
    first, last = place_layout.tile_range(3, 5, 2)
    inside = [place_layout.tile_range(4, 10 + dx, 4 + dy) for dx in (0, 1) for dy in (0, 1)]
    assert min(r[0] for r in inside) == first and max(r[1] for r in inside) == last
    assert sum(r[1] - r[0] + 1 for r in inside) == last - first + 1 == 1 << 2 * (place_layout.BITS - 3)


@pytest.fixture(scope="module")
def points(spark):
    """Half of the rows at one place, some without a position, some at the map's edges."""
    rng = random.Random(4)
    made = [(n, rng.uniform(-180, 180), rng.uniform(-84, 84), "a") for n in range(4000)]
    made += [(10_000 + n, -99.1, 19.4, "b") for n in range(4000)]
    made += [(20_000 + n, None if n % 2 else 1.0, None, "c") for n in range(100)]
    made += [(30_000, 180.0, 0.0, "d"), (30_001, -180.0, 0.0, "d"), (30_002, 0.0, 89.9, "d"), (30_003, 0.0, -90.0, "d")]
    return spark.createDataFrame(made, "id long, lon double, lat double, s string").repartition(5).cache()


@pytest.fixture(scope="module")
def laid(spark, points, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("laid") / "points")
    place_layout.lay_out(points, path, "lon", "lat", files=32)
    return spark.read.parquet(path)


def scanned(df):
    """Rows that the scan of a finished query gave out."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_keys_of_columns(points):
    found = points.where("lon is not null and lat is not null").select("lon", "lat", place_layout.place_key(F.col("lon"), F.col("lat")).alias("k"))
    near = [abs(r.k - brute_key(r.lon, r.lat)) for r in found.collect()]
    assert sum(n > 0 for n in near) <= len(near) // 1000  # the two logarithms may differ in the last place
    assert points.select(place_layout.place_key(F.col("lon"), F.col("lat")).alias("k")).where("k is null").count() == 100


def test_no_file_holds_a_crowded_place_alone(laid, points):
    assert rows(laid.drop(place_layout.PLACE)) == rows(points)
    sizes = [r[1] for r in laid.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 24 and max(sizes) < 3 * points.count() / 32


@pytest.mark.parametrize(("lat", "lon", "km"), [(19.4, -99.1, 30.0), (10.0, 20.0, 900.0), (0.0, 179.95, 300.0), (89.0, 0.0, 400.0), (-80.0, -179.0, 2000.0)])
def test_radius(points, laid, lat, lon, km):
    found = place_layout.within_radius(laid, "lat", "lon", lat, lon, km)
    assert rows(found.drop(place_layout.PLACE)) == rows(spatial.within_radius(points, "lat", "lon", lat, lon, km))
    with pytest.raises(ValueError):
        place_layout.within_radius(laid, "lat", "lon", lat, lon, 0)


def test_box_and_tile(points, laid):
    box = (-99.5, 10.0, -60.0, 33.5)
    want = points.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    assert rows(place_layout.within_box(laid, "lon", "lat", *box).drop(place_layout.PLACE)) == rows(want)
    for z, x, y in ((0, 0, 0), (3, 1, 3), (12, 920, 1823), (3, 7, 4), (4, 8, 0), (4, 8, 15)):
        got = place_layout.one_tile(laid, "id", "lon", "lat", z, x, y).drop(place_layout.PLACE)
        assert rows(got) == rows(spatial.one_tile(points, "id", "lon", "lat", z, x, y))


def test_searches_read_few_rows(points, laid):
    total = points.count()
    assert scanned(laid.select("id", "lon", "lat", place_layout.PLACE)) == total
    far = place_layout.within_radius(laid, "lat", "lon", -40.0, 60.0, 300.0)
    assert scanned(far) < total / 8 and f"Or(And(GreaterThanOrEqual({place_layout.PLACE}" in far._jdf.queryExecution().toString()
    assert scanned(place_layout.one_tile(laid, "id", "lon", "lat", 5, 20, 20)) < total / 8


def test_search_uses_the_key(points, laid):
    plain = search(points, "id", "s", around=(-40.0, 60.0, 900.0), lat="lat", lon="lon")
    fast = search(laid, "id", "s", around=(-40.0, 60.0, 900.0), lat="lat", lon="lon")
    assert rows(fast.drop(place_layout.PLACE)) == rows(plain) and scanned(fast) < points.count() / 4


def test_an_empty_table(spark, points, tmp_path):
    place_layout.lay_out(points.limit(0), str(tmp_path / "none"), "lon", "lat")
    none = spark.read.schema(points.withColumn(place_layout.PLACE, F.lit(1).cast("long")).schema).parquet(str(tmp_path / "none"))
    assert place_layout.within_radius(none, "lat", "lon", 0.0, 0.0, 10.0).count() == 0


def test_a_key_names_its_position_once():
    """A number that every step names twice makes an expression of dozens of logarithms a row."""
    key = str(place_layout.place_key(F.col("lon"), F.col("lat")))
    assert key.upper().count("LOG(") + key.upper().count("LN(") == 1
