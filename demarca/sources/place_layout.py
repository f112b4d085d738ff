"""A table laid out by place, so that a search by box, radius or tile opens few files.

The position in the web-mercator square is cut to 26 bits a side and the bits are
interleaved (Morton order). Rows are range partitioned and sorted by that key, so each
file and row group holds a compact patch of the map and Parquet's own minimum and maximum
tell readers what to skip. A box is covered by a few ranges of keys, a tile is one range.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.functions import geo
from demarca.operators import spatial

#: The column that a laid out table has besides its own.
PLACE = "place_key"

#: Bits of a side; a key has twice as many.
BITS = 26

#: Key ranges that a box is covered with, at most; more of them cover it more closely.
RANGES = 48

Range = tuple[int, int]


def _spread(v: Column) -> Column:
    """A zero bit before every bit of a number below 2^26: its binary digits, read in base four.

    The number is named once; an expression that names it again in every step evaluates it as often as it is named.
    """
    return F.conv(F.bin(v), 4, 10).cast("long")


def _cells(unit: Column) -> Column:
    side = 1 << BITS
    return F.least(F.lit(side - 1).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor(unit * float(side)).cast("long")))


def place_key(lon: Column, lat: Column) -> Column:
    """The Morton key of a position; null where there is none. Positions outside the map count at its edge."""
    x, y = geo.mercator_unit(lon, lat)
    key = F.shiftleft(_spread(_cells(y)), 1).bitwiseOR(_spread(_cells(x)))
    return F.when(geo.has_point(lon, lat), key)


def lay_out(df: DataFrame, path: str, lon: str, lat: str, files: int | None = None) -> None:
    """Write a table by place, with its key as ``place_key``.

    Files are cut by sampled key ranges; rows of one position, and those without any, are
    told apart by a hash of the row, so that no file holds more because a place is crowded.
    """
    rows = df.withColumn(PLACE, place_key(F.col(lon), F.col(lat)))
    order = [F.col(PLACE), F.xxhash64(*df.columns)]
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(PLACE).write.mode("overwrite").parquet(path)


def _unit(lon: float, lat: float) -> tuple[float, float]:
    bounded = max(-85.05112878, min(85.05112878, lat))
    s = math.sin(math.radians(bounded))
    y = 0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)
    return (lon + 180.0) / 360.0, max(0.0, min(1.0, y))


def tile_range(z: int, x: int, y: int) -> Range:
    """The keys of a map tile, first and last."""
    key = 0
    for bit in range(z):
        key |= (x >> bit & 1) << 2 * bit | (y >> bit & 1) << (2 * bit + 1)
    width = 2 * (BITS - z)
    return key << width, (key + 1 << width) - 1


def box_ranges(west: float, south: float, east: float, north: float, most: int = RANGES) -> list[Range]:
    """Key ranges, in order and apart, that hold every position of a box; at most ``most``.

    Tiles are split from the whole map downwards, the largest that the box cuts first,
    while there is room; tiles outside go, tiles inside stay whole. Bounds are widened by
    a hair, since keys and bounds are rounded apart.
    """
    hair = 1e-9
    x0, y0 = _unit(max(-180.0, west - hair), north + hair)
    x1, y1 = _unit(min(180.0, east + hair), south - hair)
    waiting, done = [(0, 0, 0)], []
    while waiting:
        z, x, y = waiting.pop(0)
        side = 1 / (1 << z)
        if x * side > x1 or (x + 1) * side < x0 or y * side > y1 or (y + 1) * side < y0:
            continue
        inside = x * side >= x0 and (x + 1) * side <= x1 and y * side >= y0 and (y + 1) * side <= y1
        if inside or z == BITS or len(waiting) + len(done) + 4 > most:
            done.append(tile_range(z, x, y))
        else:
            waiting += [(z + 1, 2 * x + dx, 2 * y + dy) for dy in (0, 1) for dx in (0, 1)]
    merged: list[Range] = []
    for first, last in sorted(done):
        if merged and first == merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], last)
        else:
            merged.append((first, last))
    return merged


def radius_ranges(lat: float, lon: float, km: float, most: int = RANGES) -> list[Range]:
    """Key ranges that hold every position within a distance; a circle over the date line has two boxes."""
    dlon, dlat = geo.degrees_around(lat, km)
    south, north = max(-90.0, lat - dlat), min(90.0, lat + dlat)
    if dlon >= 180.0:
        return box_ranges(-180.0, south, 180.0, north, most)
    west, east = lon - dlon, lon + dlon
    boxes = [(max(-180.0, west), min(180.0, east))]
    boxes += [(west + 360.0, 180.0)] if west < -180.0 else []
    boxes += [(-180.0, east - 360.0)] if east > 180.0 else []
    found = [r for a, b in boxes for r in box_ranges(a, south, b, north, most // len(boxes))]
    return sorted(set(found))


def in_ranges(ranges: list[Range]) -> Column:
    """Rows in some key ranges: a filter that the scan can use on files and row groups."""
    if not ranges:
        return F.lit(False)
    return reduce(or_, [F.col(PLACE).between(a, b) for a, b in ranges])


def within_box(laid: DataFrame, lon: str, lat: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows of a laid out table inside a box, its edges included."""
    exact = F.col(lon).between(west, east) & F.col(lat).between(south, north)
    return laid.filter(in_ranges(box_ranges(west, south, east, north))).filter(exact)


def within_radius(laid: DataFrame, lat: str, lon: str, at_lat: float, at_lon: float, km: float) -> DataFrame:
    """``spatial.within_radius`` on a laid out table."""
    if km <= 0:
        raise ValueError("radius must be above 0")
    return spatial.within_radius(laid.filter(in_ranges(radius_ranges(at_lat, at_lon, km))), lat, lon, at_lat, at_lon, km)


def one_tile(
    laid: DataFrame, ident: str, lon: str, lat: str, z: int, x: int, y: int, keep: Column | None = None,
    cap: int | None = None,
) -> DataFrame:
    """``spatial.one_tile`` on a laid out table: one key range, since tiles and keys cut the same square by halves."""
    return spatial.one_tile(laid.filter(in_ranges([tile_range(z, x, y)])), ident, lon, lat, z, x, y, keep, cap)
