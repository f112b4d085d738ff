"""The establishment registry: JSON export and its normal form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demarca.functions.keys import derive_code
from demarca.functions.text import clean_text, first_part, parse_coord, parse_date
from demarca.sources.contracts import REGISTRY
from demarca.sources.delimited import Paths, text_schema
from demarca.sources.json_arrays import read_json_arrays

# Normal column and the export field it is cleaned from.
PLAIN_FIELDS = {
    "registro_id": "Id",
    "nombre": "Nombre",
    "razon_social": "Razon_social",
    "clase_actividad": "Clase_actividad",
    "estrato": "Estrato",
    "tipo_unidad": "Tipo",
    "tipo_vialidad": "Tipo_vialidad",
    "calle": "Calle",
    "num_exterior": "Num_Exterior",
    "num_interior": "Num_Interior",
    "colonia": "Colonia",
    "tipo_asentamiento": "Tipo_Asentamiento",
    "cp": "CP",
    "ubicacion": "Ubicacion",
    "edificio": "EDIFICIO",
    "edificio_piso": "EDIFICIO_PISO",
    "numero_local": "numero_local",
    "manzana": "Manzana",
    "corredor_industrial": "tipo_corredor_industrial",
    "nom_corredor_industrial": "nom_corredor_industrial",
    "telefono": "Telefono",
    "correo_e": "Correo_e",
    "sitio_internet": "Sitio_internet",
}
# Activity column, its explicit field, and its digits inside the identifier.
ACTIVITY_FIELDS = {
    "clase_actividad_id": ("CLASE_ACTIVIDAD_ID", 6),
    "sector_actividad_id": ("SECTOR_ACTIVIDAD_ID", 2),
    "subsector_actividad_id": ("SUBSECTOR_ACTIVIDAD_ID", 3),
    "rama_actividad_id": ("RAMA_ACTIVIDAD_ID", 4),
    "subrama_actividad_id": ("SUBRAMA_ACTIVIDAD_ID", 5),
}
ACTIVITY_START = 6


def read_registry(spark: SparkSession, paths: Paths, lines: bool = False) -> DataFrame:
    """Export files, all fields text: each a JSON array of records, or JSON lines. Both are split over tasks."""
    files = [paths] if isinstance(paths, str) else list(paths)
    schema = text_schema(REGISTRY)
    return spark.read.schema(schema).json(files) if lines else read_json_arrays(spark, files, schema)


def normalize_registry(df: DataFrame) -> DataFrame:
    """One typed row per record, in one projection.

    Explicit codes win over digits taken from the identifier. The tract stays NULL
    until it is assigned from the position, since the export's own value is not
    unique nationally. The whole record stays beside the row as JSON.
    """
    ident = F.col("CLEE")
    plain = {name: clean_text(F.col(src)) for name, src in PLAIN_FIELDS.items()}
    activity = {
        name: F.coalesce(clean_text(F.col(src)), derive_code(ident, ACTIVITY_START, digits))
        for name, (src, digits) in ACTIVITY_FIELDS.items()
    }
    return df.select(
        ident.alias("clee"),
        *[c.alias(n) for n, c in plain.items()],
        *[c.alias(n) for n, c in activity.items()],
        first_part(clean_text(F.col("Ubicacion"))).alias("municipio"),
        F.when(F.length(ident) >= 2, F.left(ident, F.lit(2))).alias("entidad"),
        F.lit(None).cast("string").alias("ageb"),
        F.coalesce(clean_text(F.col("AreaGeo")), derive_code(ident, 1, 5)).alias("area_geo"),
        parse_coord(F.col("Latitud")).alias("latitud"),
        parse_coord(F.col("Longitud")).alias("longitud"),
        parse_date(F.col("Fecha_Alta")).alias("fecha_alta"),
        F.to_json(F.struct(*df.columns)).alias("raw_json"),
    )
