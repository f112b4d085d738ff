"""Tables stored in order, with a directory of ranks, so that a page far down opens one or two files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, DIRECTORY = "rows", "directory"


def write_ranked(df: DataFrame, path: str, keys: Sequence[str], files: int | None = None) -> None:
    """Write a table in ascending order of its keys (NULLs first), and each file's first key and number of rows.

    The keys together must be unique, or rows that are equal in them have no set order.
    """
    order = [F.col(k) for k in keys]
    dealt = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/{ROWS}")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{ROWS}")
    own = stored.groupBy(F.col("_metadata.file_name").alias("file"))
    parts = own.agg(F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys)).alias("last"), F.count("*").alias("n"))
    parts.repartition(1).write.mode("overwrite").parquet(f"{path}/{DIRECTORY}")


def _files(spark: SparkSession, path: str) -> list:
    """The directory in order: one row per file."""
    return spark.read.parquet(f"{path}/{DIRECTORY}").orderBy("first", "last", "file").collect()


def _read(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    whole = spark.read.parquet(f"{path}/{ROWS}")
    return spark.read.schema(whole.schema).parquet(*[f"{path}/{ROWS}/{n}" for n in names]) if names else whole.limit(0)


def total(spark: SparkSession, path: str) -> int:
    """Rows of the table, from the directory alone."""
    return sum(f.n for f in _files(spark, path))


def page(spark: SparkSession, path: str, number: int, size: int) -> DataFrame:
    """One page of a ranked table; pages count from 1. Only the files that the page touches are opened."""
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    files, offset, before = _files(spark, path), (number - 1) * size, 0
    names, skip = [], 0
    for f in files:
        if before < offset + size and before + f.n > offset:
            skip = skip if names else offset - before
            names.append(f.file)
        before += f.n
    rows = _read(spark, path, names)
    return rows.orderBy(*_keys(spark, path)).offset(skip).limit(size)


def rank_of(spark: SparkSession, path: str, key: Sequence) -> int:
    """How many rows come before a key: what the directory knows, and a count in one file."""
    keys = _keys(spark, path)
    files, key = _files(spark, path), tuple(key)
    before = [f for f in files if _order(tuple(f["last"])) < _order(key)]
    open_ = [f for f in files if _order(tuple(f["first"])) < _order(key) <= _order(tuple(f["last"]))]
    rows = _read(spark, path, [f.file for f in open_])
    schema = rows.select(*keys).schema
    wanted = spark.createDataFrame([key], schema).select(F.struct(*keys)).scalar()
    return sum(f.n for f in before) + rows.filter(F.struct(*keys) < wanted).count()


def _order(key: tuple) -> tuple:
    """Keys as Spark orders them: NULL first, text by its bytes."""
    return tuple((v is not None, v.encode() if isinstance(v, str) else v) for v in key)


def _keys(spark: SparkSession, path: str) -> list[str]:
    return spark.read.parquet(f"{path}/{DIRECTORY}").schema["first"].dataType.names
