"""Helpers that several operators share: words, row keys, stored steps, global order, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
BLANKS = r"[\x20\x09-\x0D]+"

#: Rows that Python code holds as objects at a time; Arrow batches are cut to this.
SLICE = 256


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body names it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` (null becomes empty) and ``text_key``, a 64-bit hash of the text.

    (doc_id, text_key) names a document in the steps of an operator. Rows that repeat
    both the id and the text are one document and get the same result.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("text_key"))


def same_document(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join two tables on (doc_id, text_key), null ids included; the keys stay once."""
    right = right.withColumnsRenamed({"doc_id": "_doc_id", "text_key": "_text_key"})
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key"))
    return left.join(right, on, how).drop("_doc_id", "_text_key")


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; a temporary one where it is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="demarca-")
    return f"{root.rstrip('/')}/demarca-{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "snappy", path: str | None = None) -> DataFrame:
    """Write a step to the shared folder and read it back: its lineage ends, lost executors don't matter.

    ``path`` is a name from ``shared_folder`` for steps that the caller removes with ``drop_stored``.
    """
    path = path or shared_folder(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, path: str) -> None:
    """Remove a stored step that nothing reads any more; its folder must be one of this module's."""
    if not path.rsplit("/", 1)[-1].startswith("demarca-"):
        raise ValueError(f"not a stored step: {path}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ordered(df: DataFrame, keys: list[Column], name: str) -> tuple[DataFrame, int]:
    """Number rows 0, 1, .. in the order of ``keys`` as column ``name``; also the number of rows.

    Rows are range partitioned and sorted by all keys, so equal leading keys are split
    over tasks. Each row gets its place in its partition; the step is stored, because
    range bounds are sampled anew in each run. Only one count per partition is gathered.
    """
    spark = df.sparkSession
    placed = stored(
        df.repartitionByRange(partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    return numbered(placed, name)


def numbered(placed: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Turn ``_at`` (partition and place in it, of a stored step) into a dense number; also the number of rows."""
    part = F.shiftright("_at", 33).cast("int")
    counts = placed.groupBy(part.alias("_part")).count().collect()
    before, total = [], 0
    for p, n in sorted(counts):
        before.append((p, total))
        total += n
    starts = placed.sparkSession.createDataFrame(before, "_part int, _first long")  # one row per partition
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    met = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return met.withColumn(name, F.col("_first") + inside).drop("_at", "_part", "_first"), total


def by_slice(
    columns: list[str], make: Callable[[], Callable[..., list[pa.Array]]], names: list[str]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function: ``make()`` once per task, then its result on lists of each slice.

    The slice's first column goes through unchanged and heads the output.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = work(*[part.column(c).to_pylist() for c in columns])
                yield pa.RecordBatch.from_arrays([part.column(0), *out], names=names)

    return run


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``links`` (a, b longs): rows (node, root), root the smallest node.

    Alternates two steps until nothing changes: every node hangs its larger neighbours
    on its smallest one, then its smaller neighbours. Each step is an aggregate, which
    combines a hot node's rows, and a join of stored tables, in which Spark can split them.
    No links give no rows; self links and repeats don't matter.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges, before = stored(edges), None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        edges = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b"))
        edges = stored(edges.where(a != b).distinct())
        least = stored(edges.groupBy("a").agg(F.min("b").alias("m")))
        small = edges.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
