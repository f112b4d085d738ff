"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded order and ranked; a row's place in its source,
as a fraction, orders the whole corpus, so every stretch of it has the corpus mixture.
Equal cuts of that order are the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.llm.common import ordered


def seeded_order(seed: int, row_id: Column) -> Column:
    """A pseudo-random order value: md5 of the seed and the id, as hex text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))).cast("binary"))


def interleave(
    docs: DataFrame, shards: int, source: str = "source", row_id: str = "doc_id", seed: int = 42, ties: list[str] = ()
) -> DataFrame:
    """Columns of ``docs`` plus ``global_slot``, ``shard`` and ``slot``.

    ``global_slot`` is the place in the interleaved order, ``shard`` one of ``shards``
    equal cuts of it (row counts differ by one at most) and ``slot`` the place in the
    shard; both places run from 0 without gaps. A null source is a source of its own, a
    null id ranks like an empty one, rows equal in id, source and ``ties`` may swap
    places, and an empty table gives no rows. Input columns with those names are replaced.

    No task holds a source: both orders are range partitioned by all keys. A source's
    size and first place are aggregates, joined back with AQE's skew split.
    """
    src, own = F.col(f"`{source}`"), [F.col(f"`{c}`") for c in [row_id, *ties]]
    mixed = seeded_order(seed, F.col(f"`{row_id}`"))
    docs = docs.drop("global_slot", "shard", "slot", "_mixed", "_place", "_share", "_first", "_size", "_source")
    ranked, total = ordered(docs.withColumn("_mixed", mixed), [src, F.col("_mixed"), *own], "_place")
    sizes = ranked.groupBy(src.alias("_source")).agg(F.min("_place").alias("_first"), F.count("*").alias("_size"))
    shared = ranked.join(sizes, src.eqNullSafe(F.col("_source"))).withColumn(
        "_share", (2 * (F.col("_place") - F.col("_first")) + 1).cast("double") / (2 * F.col("_size")).cast("double")
    )
    slotted, _ = ordered(
        shared.drop("_source", "_place", "_first", "_size"), [F.col("_share"), F.col("_mixed"), src, *own], "global_slot"
    )
    rows = max(total, 1)
    shard = F.expr(f"cast(global_slot * {shards} div {rows} as int)")
    start = F.expr(f"(cast(shard as long) * {rows} + {shards - 1}) div {shards}")
    return slotted.withColumn("shard", shard).withColumn("slot", F.col("global_slot") - start).drop("_mixed", "_share")
