"""Running sums over a table that is stored in order: one range shuffle, and totals of its parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a row's place inside its part.
PLACE = 33


def running_total_stored(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, path: str, name: str = "running"
) -> DataFrame:
    """Every row with its running sum in its group and the group's sum (``<name>_total``).

    ``order`` must be total within a group. Rows are written to ``path`` in the order of
    keys and order columns, so a group, however large, lies in parts of about one size; each
    part's sum by group is added up over the parts before it, and a window sees one part of
    a group at a time. The sums of a group's parts are as many as its parts. NULL keys are a
    group, a NULL value adds nothing, no rows give none.
    """
    spark, by = df.sparkSession, [F.col(k) for k in [*keys, *order]]
    laid = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    laid.write.mode("overwrite").parquet(path)
    rows = spark.read.schema(laid.schema).parquet(path).withColumn("_part", F.shiftright("_at", PLACE))
    sums = rows.groupBy(*keys, "_part").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_own"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = F.sum("_own").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_part").alias("_key_part"),
        F.coalesce(before, F.lit(0)).alias("_before"),
        F.sum("_own").over(group).alias(f"{name}_total"),
    )
    inside = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_run", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = F.col("_part") == F.col("_key_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = summed.join(sums, on).withColumn(name, F.col("_before") + F.col("_run"))
    return out.select(*df.columns, name, f"{name}_total")


def with_group_total(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The sum of each row's group beside it; the sums are aggregated first, so a large group needs no window."""
    sums = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.sum(value).alias(name))
    if not keys:
        return df.withColumn(name, sums.select(name).scalar())
    on = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    joined = df.join(sums, on)
    return joined.select(*df.columns, name)
