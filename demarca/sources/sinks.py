"""Writers: upsert, replace by key, full replace, GeoJSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.functions.geo import has_point
from demarca.operators.ordered import SALTS, latest_per_key


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Existing rows overlaid by incoming ones; the first incoming row in ``order`` wins per key.

    Rows with an empty key are skipped. Write the result to a new path: a plain
    Parquet folder cannot be read and replaced at once.
    """
    fresh = incoming.filter(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    fresh = latest_per_key(fresh, [key], order)
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def replace_partition(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Write a partitioned table, replacing only the partitions the rows belong to.

    Rows are dealt by the keys and a salt first, so a task opens few files and a large
    partition is written by several tasks.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
    df = df.repartition(*keys, salt)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def overwrite(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the whole table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


# Properties of an exported feature.
FEATURE_PROPERTIES = [
    "clee",
    "registro_id",
    "nombre",
    "razon_social",
    "clase_actividad_id",
    "clase_actividad",
    "estrato",
    "tipo_unidad",
    "calle",
    "num_exterior",
    "num_interior",
    "colonia",
    "cp",
    "municipio",
    "entidad",
    "ubicacion",
    "telefono",
    "correo_e",
    "sitio_internet",
    "fecha_alta",
]


def to_geojson_lines(
    df: DataFrame,
    lon: str,
    lat: str,
    properties: Sequence[str],
    geometry_only: bool = True,
    order: list[Column] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One GeoJSON feature per row in ``value``; rows without a point get a null geometry.

    A limit is applied in the given order.
    """
    known = has_point(F.col(lon), F.col(lat))
    rows = df.filter(known) if geometry_only else df
    if limit is not None:
        if not order:
            raise ValueError("a limit needs an order")
        rows = rows.orderBy(*order).limit(limit)
    point = F.when(known, F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))
    return rows.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def export_geojson(df: DataFrame, path: str, lon: str, lat: str, properties: Sequence[str], **options) -> None:
    """Write features as text files, one feature per line."""
    to_geojson_lines(df, lon, lat, properties, **options).write.mode("overwrite").text(path)


def without_geometry(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Feature count and how many lack a point."""
    missing = ~has_point(F.col(lon), F.col(lat))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(missing).alias("without_geometry"))
