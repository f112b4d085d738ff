"""Registry search: by name, state and distance, in pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demarca.operators.filters import name_contains
from demarca.operators.ordered import page, page_after
from demarca.operators.spatial import within_radius
from demarca.sources import place_layout


def search(
    df: DataFrame,
    key: str,
    name: str,
    text: str | None = None,
    state_column: str = "entidad",
    state: str | None = None,
    around: tuple[float, float, float] | None = None,
    lat: str = "latitud",
    lon: str = "longitud",
    number: int = 1,
    size: int | None = None,
    after: str | None = None,
) -> DataFrame:
    """The matching rows, or one page of them in key order; ``around`` is (lat, lon, km).

    ``size`` is the page's, as large as the caller wants. ``after`` starts behind a key,
    which costs the same at any depth; ``number`` counts pages from the first row on. A table
    from ``place_layout.lay_out`` is searched around a place by its key.
    """
    rows = df
    if state is not None:
        rows = rows.filter(F.col(state_column) == state)
    if text is not None:
        rows = rows.filter(name_contains(F.col(name), text))
    if around is not None:
        find = place_layout.within_radius if place_layout.PLACE in df.columns else within_radius
        rows = find(rows, lat, lon, *around).drop("distance_km")
    if size is None:
        return rows if after is None else rows.filter(F.col(key) > after)
    return page(rows, [F.asc(key)], number, size) if after is None else page_after(rows, key, after, size)
