"""Substring search over a stored table by an inverted index of trigrams.

Rows are numbered and cut into chunks of 65,536. For every run of three characters of the
folded name the index has, per chunk, the sorted row numbers that hold it, as differences
in one or two bytes each. A text is in a name only if all its trigrams are, so a search
reads the lists of those few trigrams, intersects them chunk by chunk and opens only the
ranges of rows that are left; an exact test decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demarca.operators.filters import name_contains

ROW = "row_number"
ROWS, LISTS = "rows", "lists"

#: Rows of a chunk, as a power of two.
CHUNK = 16

#: Ranges of row numbers that a search asks the scan for, at most.
RANGES = 256


def grams(text: Column) -> Column:
    """The different runs of three characters of a text, letters in lower case."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - 2))
    runs = F.transform(places, lambda i: F.substring(low, i, F.lit(3)))
    return F.when(F.length(low) >= 3, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def coded(offsets: np.ndarray) -> bytes:
    """Ascending numbers below 65,536 as differences: a byte each if all fit, else two."""
    steps = np.diff(offsets, prepend=0)
    return steps.astype("<u1").tobytes() + b"\1" if steps.max(initial=0) < 256 else steps.astype("<u2").tobytes() + b"\2"


def decoded(data: bytes) -> np.ndarray:
    """The numbers of ``coded``."""
    kind = "<u1" if data[-1] == 1 else "<u2"
    return np.cumsum(np.frombuffer(data, dtype=kind, count=(len(data) - 1) // data[-1]).astype(np.int64))


def _code_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [coded(np.sort(x.values.to_numpy())) for x in batch.column("offsets")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("gram"), batch.column("chunk"), pa.array(lists, pa.binary())], names=["gram", "chunk", "rows"]
        )


def write_index(df: DataFrame, path: str, name: str, order: list[str]) -> None:
    """Write a table in an order, numbered, and the trigram index of its column ``name``.

    A list holds the rows of one chunk at most, so a trigram that every name has makes many
    short lists and no long one. NULL names and names of one or two characters are in no list.
    """
    spark, keys = df.sparkSession, [F.col(c) for c in order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt.withColumn(ROW, F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/{ROWS}")
    rows = spark.read.parquet(f"{path}/{ROWS}")
    place = rows.select(F.explode(grams(F.col(f"`{name}`"))).alias("gram"), F.shiftright(ROW, CHUNK).alias("chunk"), ROW)
    offset = F.col(ROW).bitwiseAND(F.lit((1 << CHUNK) - 1)).cast("int")
    lists = place.groupBy("gram", "chunk").agg(F.collect_list(offset).alias("offsets"))
    lists = lists.mapInArrow(_code_lists, "gram string, chunk long, rows binary")
    lists = lists.repartitionByRange("gram", "chunk").sortWithinPartitions("gram", "chunk")
    lists.write.mode("overwrite").parquet(f"{path}/{LISTS}")


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame | None:
    """Numbers of the rows whose names hold all trigrams of a text; None if it has fewer than three characters."""
    wanted = spark.range(1).select(grams(F.lit(text)).alias("g")).first().g
    if not wanted:
        return None

    many, width = len(wanted), CHUNK

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that all lists of a chunk share; lists come sorted by chunk, and one chunk's are held."""

        def flat() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                yield from zip(batch.column("chunk").to_pylist(), batch.column("rows").to_pylist(), strict=True)

        for chunk, own in groupby(flat(), key=lambda x: x[0]):
            parts = sorted((decoded(x) for _, x in own), key=len)
            if len(parts) == many:
                left = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), parts)
                yield pa.RecordBatch.from_arrays([pa.array((chunk << width) + left)], names=[ROW])

    lists = spark.read.parquet(f"{path}/{LISTS}").filter(F.col("gram").isin(wanted)).select("chunk", "rows")
    return lists.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(common, f"{ROW} long")


def containing(spark: SparkSession, path: str, name: str, text: str) -> DataFrame:
    """The indexed table's rows whose ``name`` contains a text, whatever the case; as a scan would find them.

    The candidates are counted into at most ``RANGES`` ranges of row numbers when this is
    called, for the scan to skip what lies between. Texts of one or two characters are
    looked for in all rows.
    """
    rows = spark.read.parquet(f"{path}/{ROWS}")
    found = candidates(spark, path, text)
    if found is None:
        return rows.filter(name_contains(F.col(f"`{name}`"), text)).drop(ROW)
    found = found.persist()  # a lost part is made again from the index
    ends = found.agg(F.min(ROW).alias("a"), F.max(ROW).alias("b")).first()
    if ends.a is None:
        return rows.limit(0).drop(ROW)
    part = F.expr(f"({ROW} - {ends.a}) div {(ends.b - ends.a) // RANGES + 1}")
    spans = found.groupBy(part.alias("part")).agg(F.min(ROW).alias("a"), F.max(ROW).alias("b")).collect()
    near = reduce(or_, [F.col(ROW).between(s.a, s.b) for s in spans])
    met = rows.filter(near).join(found, ROW, "left_semi")
    return met.filter(name_contains(F.col(f"`{name}`"), text)).drop(ROW)
