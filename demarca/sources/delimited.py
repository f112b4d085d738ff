"""Delimited files in which every column is text.

Types are never inferred: inference would drop the leading zeros of codes. Files
are checked against their header lines, which one job reads while the plan is built;
rows are read by the executors, in splits.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

IDENTIFIER = re.compile(r"[a-z][a-z0-9_]*")
BOM = "\ufeff"
#: Every file counts as a full task, and a task hands over one line at a time.
FIRST_LINES = {
    "spark.sql.files.maxPartitionBytes": str(1 << 40),
    "spark.sql.files.openCostInBytes": str(1 << 40),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1",
}
Paths = str | Sequence[str]


def _paths(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def files_of(spark: SparkSession, paths: Paths) -> list[str]:
    """The files that paths, folders or globs stand for, in name order."""
    found = sorted(unquote(f) for f in spark.read.text(_paths(paths)).inputFiles())
    if not found:
        raise ValueError(f"no files in {paths}")
    return found


def text_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def headers_of(spark: SparkSession, paths: Paths, encoding: str = "UTF-8", sep: str = ",") -> dict[str, list[str]]:
    """Column names of every file that paths stand for, in name order, without byte-order mark or carriage return.

    One job reads them all: each file is one task, which stops after the first line. An
    empty file raises.
    """
    reading = spark.newSession()  # settings of its own: no file shares a task or is cut, lines come one by one
    for name, value in FIRST_LINES.items():
        reading.conf.set(name, value)
    # A line is read as one unsplit column.
    lines = reading.read.options(encoding=encoding, sep="\x01", quote="").csv(_paths(paths), schema="line string")
    lines = lines.select(F.col("_metadata.file_path").alias("file"), "line")
    files = {_plain(f): f for f in files_of(spark, paths)}
    found = {_plain(unquote(r.file)): r.line for r in lines.mapInArrow(_first_row, "file string, line string").collect()}
    headers = {}
    for name, file in files.items():
        if found.get(name) is None:
            raise ValueError(f"{file} is empty")
        line = found[name].removeprefix(BOM).rstrip("\r")
        headers[file] = [c.strip() for c in next(csv.reader([line], delimiter=sep))]
    return headers


def _first_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield batch.slice(0, 1)
            return


def _plain(path: str) -> str:
    """A file's path with one slash behind its scheme, however it was written."""
    return re.sub(r"^([A-Za-z0-9+.-]+):/*", r"\1:/", path)


def _rows(
    spark: SparkSession,
    paths: list[str],
    columns: Sequence[str],
    encoding: str,
    sep: str,
    strict: bool = False,
    multi_line: bool = False,
    tag: dict[str, str] | None = None,
) -> DataFrame:
    """Text rows; ``strict`` makes the reader compare the header of every file it opens.

    ``multi_line`` allows line breaks in quoted cells; such files can't be split. ``tag``
    maps a new column to a pattern whose first group is taken from the file's name.
    """
    df = (
        spark.read.schema(text_schema(columns))
        .option("header", True)
        .option("enforceSchema", not strict)
        .option("encoding", encoding)
        .option("sep", sep)
        .option("mode", "FAILFAST")
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(paths)
    )
    cells = {c: F.coalesce(F.col(c), F.lit("")) for c in columns}
    cells[columns[-1]] = F.regexp_replace(cells[columns[-1]], "\r$", "")
    name = F.col("_metadata.file_name")
    tags = [F.regexp_extract(name, pattern, 1).alias(c) for c, pattern in (tag or {}).items()]
    return df.select(*[c.alias(n) for n, c in cells.items()], *tags)


def read_contract_csv(
    spark: SparkSession,
    paths: Paths,
    columns: Sequence[str],
    encoding: str = "UTF-8",
    sep: str = ",",
    multi_line: bool = False,
    tag: dict[str, str] | None = None,
) -> DataFrame:
    """Text columns of files whose header must list exactly these columns, in order.

    Every file is checked at once, in one job, and again when it is read.
    Blank cells stay empty strings, as in the file.
    """
    files = _paths(paths)
    for f, found in headers_of(spark, files, encoding, sep).items():
        if [c.lower() for c in found] != [c.lower() for c in columns]:
            raise ValueError(f"{f}: header {found} does not match {list(columns)}")
    return _rows(spark, files, columns, encoding, sep, strict=True, multi_line=multi_line, tag=tag)


def read_header_csv(
    spark: SparkSession,
    paths: Paths,
    encoding: str = "UTF-8",
    required: Sequence[str] = (),
    renames: dict[str, str] | None = None,
    sep: str = ",",
    multi_line: bool = False,
    tag: dict[str, str] | None = None,
) -> DataFrame:
    """Text columns named by the files' own headers, in lower case.

    Paths may be files, folders or globs. Every file's header is read: files may order
    their columns differently, but must have the same ones. ``renames`` maps header names
    (blanks as ``_``) to canonical ones and is then complete: an unlisted name is an
    error. Names must be plain identifiers.
    """
    alike: dict[tuple[str, ...], list[str]] = {}
    for path, header in headers_of(spark, paths, encoding, sep).items():
        names = [re.sub(r"\s+", "_", c.lower()) for c in header]
        if renames is not None:
            unknown = [c for c in names if c not in renames]
            if unknown:
                raise ValueError(f"{path}: unknown columns {unknown}")
            names = [renames[c] for c in names]
        bad = [c for c in names if not IDENTIFIER.fullmatch(c)]
        missing = [c for c in required if c not in names]
        if bad or missing:
            raise ValueError(f"{path}: bad column names {bad}, missing columns {missing}")
        first = next(iter(alike), tuple(names))
        if sorted(first) != sorted(names):
            raise ValueError(f"{path}: columns {names} differ from {list(first)}")
        alike.setdefault(tuple(names), []).append(path)
    parts = [_rows(spark, files, names, encoding, sep, multi_line=multi_line, tag=tag) for names, files in alike.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def rename_columns(df: DataFrame, mapping: dict[str, str], strict: bool = True) -> DataFrame:
    """Canonical column names; with ``strict`` every column must be in the mapping."""
    unknown = [c for c in df.columns if c not in mapping]
    if strict and unknown:
        raise ValueError(f"unknown columns {unknown}")
    return df.withColumnsRenamed(mapping)


def select_by_position(
    spark: SparkSession,
    paths: Paths,
    positions: dict[str, int],
    encoding: str = "UTF-8",
    sep: str = ",",
    tag: dict[str, str] | None = None,
) -> DataFrame:
    """Columns picked by 1-based position, for files whose names change but whose order does not.

    Files of different widths are read apart.
    """
    alike: dict[int, list[str]] = {}
    for path, header in headers_of(spark, paths, encoding, sep).items():
        width = len(header)
        if max(positions.values()) > width:
            raise ValueError(f"{path} has only {width} columns")
        alike.setdefault(width, []).append(path)
    picked = [
        _rows(spark, files, [f"c{i}" for i in range(1, width + 1)], encoding, sep, tag=tag).select(
            *[F.col(f"c{i}").alias(name) for name, i in positions.items()], *(tag or {})
        )
        for width, files in alike.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), picked)


def select_positions(df: DataFrame, positions: dict[str, int]) -> DataFrame:
    """Columns of a DataFrame picked by 1-based position."""
    return df.select(*[F.col(df.columns[i - 1]).alias(name) for name, i in positions.items()])


def union_tagged(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """Rows of several files with the same columns, marked by where they come from."""
    tagged = [df.withColumn(tag, F.lit(value)) for value, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def skip_national(paths: Sequence[str], marker: str = "_nac_") -> list[str]:
    """State files in name order, without the national roll-up file."""
    return sorted(p for p in paths if marker not in p)


def undecodable_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count of rows that hold the replacement character, the mark of a wrong charset."""
    cols = [F.col(c) for c in (columns or df.columns)]
    broken: Column = reduce(lambda a, b: a | b, [F.coalesce(F.contains(c, F.lit("\ufffd")), F.lit(False)) for c in cols])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(broken).alias("undecodable"))
