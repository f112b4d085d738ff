"""Order statistics, running totals and per-group limits that hold on hot groups.

A window over a whole group puts the group into one task. The functions here cut
every group into value ranges first; a window then sees one range at a time, and
the ranges of a group are tied together by their totals. Ranges are fixed bins
where only a few values are wanted, and lie between sampled cut points where
every row is. Cut points are the rows with the smallest hashes, so they are the
same in every evaluation; results never depend on which rows were picked.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

RELATIVE = 4096.0
SUB_BINS = 1024
CUTS = 900
STEP = 30
SALTS = 64
RANGE_ROWS = 100_000
FEW_GROUPS = 2_000


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, salt: Column | None = None, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of every group in the given total order.

    With ``salt`` a group is first cut down inside each salt value, so no task
    sorts more than ``n`` rows per salt of a hot group in the second step.
    """
    pos = rank or "_pos"
    if salt is not None:
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_part", F.row_number().over(part))
            .filter(F.col("_part") <= n)
            .drop("_part", "_salt")
        )
    out = df.withColumn(pos, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(pos) <= n)
    return out if rank else out.drop(pos)


def _places(df: DataFrame, ident: str) -> Column:
    """A whole number that never falls as the id rises: the id itself, or six bytes behind the beginning that all ids share."""
    if isinstance(df.schema[ident].dataType, IntegralType):
        return F.col(ident).cast("long")
    ends = df.agg(F.min(ident).alias("lo"), F.max(ident).alias("hi"))
    alike = F.expr("size(filter(sequence(1, greatest(1, least(length(lo), length(hi)))), i -> left(lo, i) = left(hi, i)))")
    skip = F.octet_length(F.left("lo", alike))
    rest = F.substring(F.col(ident).cast("binary"), ends.select(F.coalesce(skip, F.lit(0))).scalar() + 1, F.lit(6))
    return F.conv(F.hex(F.rpad(rest, F.lit(6), F.unhex(F.lit("00")))), 16, 10).cast("long")


def smallest_per_group(df: DataFrame, keys: list[str], ident: str, n: int) -> DataFrame:
    """The rows with the ``n`` smallest ids of every group, whatever its size. Ids are unique in a group and not NULL.

    Groups of up to ``n`` rows are left as they are. In a larger one the ids' range is cut
    into bins, only bin totals are put in order, and the bin that holds the n-th row is cut
    again. Rows below it stay without being sorted; those of the last bin are ranked.
    """
    place = F.col("_place")
    rows = df.withColumn("_place", _places(df, ident))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_low"), F.max(place).alias("_high"))
    sizes = sizes.withColumns({"_need": F.lit(n).cast("long"), "_width": F.expr(f"(_high - _low) div {SUB_BINS} + 1")})
    rows = _on_keys(rows, sizes.drop("_high"), keys)
    small, large = rows.filter(F.col("_n") <= n), rows.filter(F.col("_n") > n)
    kept = small
    for _ in range(2):
        binned = large.withColumn("_bin", F.expr("(_place - _low) div _width"))
        totals = binned.groupBy(*keys, "_bin", "_low", "_width", "_need").agg(F.count(F.lit(1)).alias("_own"))
        up_to = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        totals = totals.withColumn("_upto", F.sum("_own").over(up_to))
        last = totals.filter((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_own") < F.col("_need")))
        last = last.select(
            *keys,
            F.col("_bin").alias("_last"),
            (F.col("_need") - F.col("_upto") + F.col("_own")).alias("_left"),
            (F.col("_low") + F.col("_bin") * F.col("_width")).alias("_from"),
            F.expr(f"(_width - 1) div {SUB_BINS} + 1").alias("_finer"),
        )
        met = _on_keys(binned, last, keys)
        helpers = ["_bin", "_last", "_left", "_from", "_finer"]
        kept = kept.unionByName(met.filter(F.col("_bin") < F.col("_last")).drop(*helpers))
        inner = met.filter(F.col("_bin") == F.col("_last"))
        finer = {"_need": F.col("_left"), "_low": F.col("_from"), "_width": F.col("_finer")}
        large = inner.withColumns(finer).drop(*helpers)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(ident))
    found = large.withColumn("_rank", rank).filter((F.col("_rank") <= n) & (F.col("_rank") <= F.col("_need"))).drop("_rank")
    return kept.unionByName(found).drop("_place", "_n", "_need", "_low", "_width")


def _on_keys(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's values; a group without a key value is a group too."""
    named = side.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return rows.join(named, on).drop(*[f"_key_{k}" for k in keys])


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return top_per_group(df, keys, order, 1)


def cut_points(df: DataFrame, keys: list[str], value: Column, n: int = CUTS) -> DataFrame:
    """Per group, at most ``n`` values picked by smallest hash, sorted (``_cuts``), and every 30th of them (``_heads``)."""
    vals = df.select(*keys, value.alias("_v")).withColumn("_h", F.xxhash64("_v"))
    salt = F.pmod(F.shiftright("_h", 7), F.lit(SALTS))
    picked = top_per_group(vals, keys, [F.col("_h"), F.col("_v")], n, salt=salt)
    cuts = picked.groupBy(*keys).agg(F.sort_array(F.collect_set("_v")).alias("_cuts"))
    starts = F.sequence(F.lit(0), F.floor((F.size("_cuts") - 1) / F.lit(STEP)).cast("int"))
    return cuts.withColumn("_heads", F.transform(starts, lambda i: F.col("_cuts")[i * STEP]))


def _below(value: Column, cuts: Column, heads: Column) -> Column:
    """Number of cut points below the value, found by one coarse and one fine step."""
    coarse = F.size(F.filter(heads, lambda x: x < value))
    fine = F.size(F.filter(F.slice(cuts, (coarse - 1) * STEP + 1, F.lit(STEP)), lambda x: x < value))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * STEP + fine)


def _offsets(ranged: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Per range: weight before it in its group, its own weight, the group's weight."""
    totals = ranged.groupBy(*keys, "_range").agg(F.sum(weight).alias("_own"))
    w = Window.partitionBy(*keys)
    up_to = w.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return totals.select(
        *keys,
        "_range",
        "_own",
        (F.sum("_own").over(up_to) - F.col("_own")).alias("_before"),
        F.sum("_own").over(w).alias("_total"),
    )


def _attach(df: DataFrame, side: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """A cut group's row on all rows of the group, nulls on others; without keys the side is one row and becomes a scalar.

    Cut groups are few, or one for every ``RANGE_ROWS`` rows or so at most. Their rows stay
    where they are: a join by shuffle would put all rows of a group into one task.
    """
    if keys:
        return df.join(F.broadcast(side), by, "left")
    return df.withColumns({c: side.select(c).scalar() for c in side.columns if c not in by})


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, keys) if keys else (df.withColumn("_all", F.lit(1)), ["_all"])


def _log_bin(v: Column) -> Column:
    """Bin of relative width 1 / RELATIVE; never decreases as the value grows."""
    size = F.floor(F.log1p(F.abs(v)) * RELATIVE)
    return F.coalesce(F.when(v < 0, -size).otherwise(size).cast("int"), F.lit(0))


def _sub_bin(v: Column, b: Column) -> Column:
    """Equal-width bin inside a log bin, from the log bin's own ends."""
    down = F.when(b > 0, F.expm1(b / RELATIVE)).otherwise(-F.expm1((1 - b) / RELATIVE))
    up = F.when(b < 0, -F.expm1(-b / RELATIVE)).otherwise(F.expm1((b + 1) / RELATIVE))
    at = F.floor((v - down) / (up - down) * SUB_BINS)
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(SUB_BINS - 1), at)).cast("int"), F.lit(0))


def _narrow(rows: DataFrame, group: list[str], b: str, place: Column, goals: list[Callable[[Column], Column]]):
    """Keep the rows of the value bins in which a target is reached.

    Only bin totals are put in order, never rows. Returns the rows left, with the
    weight before their bin (``_before``) and the whole weight (``_total``).
    """
    binned = rows.withColumn(b, place)
    deeper = "_before" in rows.columns
    carried = [F.max(c).alias(c) for c in ("_before", "_total") if deeper]
    totals = binned.groupBy(*group, b).agg(F.sum("_weight").alias("_own"), *carried)
    w = Window.partitionBy(*group)
    run = F.sum("_own").over(w.orderBy(b).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = F.col("_before") if deeper else F.lit(0)
    whole = F.col("_total") if deeper else F.sum("_own").over(w)
    spans = totals.select(*group, b, "_own", (start + run - F.col("_own")).alias("_before"), whole.alias("_total"))
    hit = F.lit(False)
    for goal in goals:
        at = goal(F.col("_total"))
        starts = (F.col("_before") < at) | (F.col("_before") == 0)
        hit = hit | (starts & (F.col("_before") + F.col("_own") >= at))
    return binned.drop("_before", "_total").join(spans.filter(hit).drop("_own"), [*group, b])


def values_at_weight(
    df: DataFrame, keys: list[str], value: str, weight: Column, targets: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """Per group, the smallest value whose cumulative weight reaches each target.

    A target is a function of the group's total weight. Rows without a key, a value
    or a positive weight are left out. The result also carries ``total_weight``.

    The weights of equal values are added up first. A round of logarithmic bins and
    one of equal-width bins then leave, per target, the distinct values within about
    a four-millionth of it; only those are put in order. Filters on keys and bins are
    stated up front, so that all steps share one shuffle of the summed weights.
    """
    df, by = _keyed(df, keys)
    rows = (
        df.select(*by, F.col(value).alias("_value"), weight.alias("_weight"))
        .dropna(subset=[*by, "_value", "_weight"])
        .groupBy(*by, "_value")
        .agg(F.sum("_weight").alias("_weight"))
        .filter(F.col("_weight") > 0)
    )
    goals = list(targets.values())
    v = F.col("_value").cast("double")
    rows = _narrow(rows, by, "_log", _log_bin(v), goals)
    rows = _narrow(rows, [*by, "_log"], "_sub", _sub_bin(v, F.col("_log")), goals)
    inside = Window.partitionBy(*by, "_log", "_sub").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    scanned = rows.withColumn("_cum", F.col("_before") + F.sum("_weight").over(inside))
    reached = {name: F.col("_cum") >= goal(F.col("_total")) for name, goal in targets.items()}
    out = scanned.groupBy(*by).agg(
        *[F.min(F.when(cond, F.col("_value"))).alias(name) for name, cond in reached.items()],
        F.max("_total").alias("total_weight"),
    )
    return out if keys else out.drop("_all")


def weighted_percentiles(
    df: DataFrame, keys: list[str], value: str, weight: str, shares: dict[str, str]
) -> DataFrame:
    """Weighted percentiles: smallest value with cumulative weight >= share x total.

    ``shares`` maps a result name to a decimal literal such as ``"0.5"``.
    """
    targets = {
        name: (lambda p: lambda total: total * F.lit(p).cast("decimal(4,3)"))(p) for name, p in shares.items()
    }
    return values_at_weight(df, keys, value, F.col(weight), targets)


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, tuple[int, int]]) -> DataFrame:
    """Linearly interpolated quantiles (the type-7 rule) of each group.

    ``shares`` maps a result name to a fraction ``(numerator, denominator)``.
    """

    def index(total: Column, p: tuple[int, int]) -> Column:
        return (total - 1) * F.lit(p[0])

    targets: dict[str, Callable[[Column], Column]] = {}
    for name, p in shares.items():
        targets[f"_lo_{name}"] = (lambda p: lambda t: F.floor(index(t, p) / F.lit(p[1])) + 1)(p)
        targets[f"_hi_{name}"] = (lambda p: lambda t: F.ceil(index(t, p) / F.lit(p[1])) + 1)(p)
    found = values_at_weight(df, keys, value, F.lit(1), targets)
    cols = []
    for name, p in shares.items():
        part = F.pmod(index(F.col("total_weight"), p), F.lit(p[1])) / F.lit(p[1])
        lo, hi = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        cols.append(F.when(part == 0, lo).otherwise(lo * (1 - part) + hi * part).alias(name))
    return found.select(*keys, *cols, F.col("total_weight").alias("n"))


def running_total(
    df: DataFrame,
    keys: list[str],
    order: str,
    ties: list[str],
    value: str,
    name: str = "running",
    levels: int | None = None,
    few: bool = False,
) -> DataFrame:
    """Running sum of every row, ordered by ``order`` and then by ``ties``.

    The order must be total within a group, and the first tie column close to
    unique. An order value that many rows share becomes a range of its own, which
    is split again by the first tie column. Also returns ``<name>_total``, the
    group's sum. Neither order column may be NULL.

    Ranges are cut again, and again, until about ``RANGE_ROWS`` rows are left in one,
    so they grow in number with the table and not in size. ``levels`` fixes how often;
    without it the rows are counted when this function is called, and the groups: up to
    about ``FEW_GROUPS`` (``few``) are all cut. Of more groups, and of ranges that are cut
    again, one of up to ``RANGE_ROWS`` rows, by its sample's largest hash, stays one range.
    """
    if levels is None:
        levels, reach = 1, CUTS * RANGE_ROWS
        rows, groups = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(*keys) if keys else F.lit(1))).first()
        few = groups <= FEW_GROUPS
        while rows > reach:
            levels, reach = levels + 1, reach * CUTS
    df, by = _keyed(df, keys)
    rows = df.select(*by, F.col(order).alias("_v"), F.col(ties[0]).alias("_t"))
    # Rows, not distinct values, are sampled, so a value many rows share is sure to be picked.
    sample = rows.withColumn("_h", F.xxhash64("_t", "_v"))
    salt = F.pmod(F.shiftright("_h", 7), F.lit(SALTS))
    picked = top_per_group(sample, by, [F.col("_h"), F.col("_t"), F.col("_v")], CUTS, salt=salt)
    group = Window.partitionBy(*by)
    counted = picked.withColumns({"_picked": F.count(F.lit(1)).over(group), "_most": F.max("_h").over(group)})
    # Hashes are spread evenly over 64 bits: the more rows a group has, the less is the largest of the smallest ones.
    large = counted.filter((F.col("_picked") == CUTS) & (F.col("_most") <= int(CUTS / max(CUTS, RANGE_ROWS) * (2**64 - 2048)) - 2**63))
    picked = picked if few else large.drop("_picked", "_most")
    cuts = cut_points(picked, by, F.col("_v"))
    tie_cuts = cut_points(picked, by, F.col("_t")).withColumnsRenamed({"_cuts": "_tcuts", "_heads": "_theads"})
    cut = F.col("_cuts").isNotNull()
    v, t = F.col(order), F.col(ties[0])
    below = _below(v, F.col("_cuts"), F.col("_heads"))
    own = F.coalesce(F.get("_cuts", F.col("_below")) == v, F.lit(False))
    placed = _attach(_attach(df, cuts, keys, by), tie_cuts, keys, by).withColumn("_below", below)
    ranged = placed.withColumns(
        {
            "_range": F.struct(
                F.when(cut, F.col("_below") * 2 + own.cast("int")).otherwise(0).alias("v"),
                F.when(cut & own, _below(t, F.col("_tcuts"), F.col("_theads"))).otherwise(0).alias("t"),
            )
        }
    ).drop("_cuts", "_heads", "_tcuts", "_theads", "_below")
    spans = _offsets(ranged, by, value).select(*by, "_range", "_before", "_total")
    if levels > 1:
        inner = f"_range{levels}"
        deeper = running_total(
            ranged.withColumnRenamed("_range", inner), [*by, inner], order, ties, value, "_deep", levels - 1
        )
        summed = deeper.drop("_deep_total").withColumnsRenamed({inner: "_range", "_deep": "_run"})
    else:
        inside = Window.partitionBy(*by, "_range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
        summed = ranged.withColumn("_run", F.sum(value).over(inside))
    out = (
        summed.join(spans, [*by, "_range"])
        .withColumn(name, F.col("_before") + F.col("_run"))
        .withColumn(f"{name}_total", F.col("_total"))
        .drop("_run", "_range", "_before", "_total")
    )
    return out if keys else out.drop("_all")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a stable order; pages count from 1."""
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The first ``size`` rows behind a key (None: from the start), in key order.

    Each task keeps ``size`` rows at most, however deep the page is; the last row's key
    is where the next page starts. The key must be unique and not NULL.
    """
    if size < 1:
        raise ValueError("a page size starts at 1")
    rows = df if after is None else df.filter(F.col(key) > after)
    return rows.orderBy(key).limit(size)


def with_total(limited: DataFrame, whole: DataFrame, name: str) -> DataFrame:
    """Put the row count of the whole set beside a limited list of its rows."""
    return limited.withColumn(name, whole.agg(F.count(F.lit(1))).scalar())


def ranked_by(
    df: DataFrame, choice: str, orders: dict[str, list[Column]], limit: int | None = None
) -> DataFrame:
    """Rows in one of the allowed orders: all of them, or the first ``limit``."""
    if choice not in orders:
        raise ValueError(f"unknown order {choice!r}; allowed: {', '.join(orders)}")
    return first(df.orderBy(*orders[choice]), limit)


def first(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of an order, or all of them without a limit."""
    if limit is None:
        return rows
    if limit < 1:
        raise ValueError("a limit starts at 1")
    return rows.limit(limit)
