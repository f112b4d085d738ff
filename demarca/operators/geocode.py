"""Placing records by postcode and neighbourhood name, using registry rows as neighbours.

Within a (state, postcode) a record takes the place of a registry row whose
neighbourhood name matches: every word of the shorter name occurs in the longer
one. Of several matches the smallest (municipality, tract) wins. Without a match
it takes the most frequent municipality of the postcode and the most frequent
tract there, smallest on a tie.

Pairs of names are never enumerated: names are made distinct first, and a pair
is looked at only if it shares the rarest word of the shorter name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.functions.text import tokens

AREA = ["state", "postcode"]
METHODS = ("cp_colonia", "cp_modal", "none")


def _names(df: DataFrame, name: Column) -> DataFrame:
    words = tokens(name)
    return df.withColumns({"_len": F.size(words), "_set": F.array_sort(F.array_distinct(words))}).withColumn(
        "_name", F.concat_ws(" ", F.col("_len").cast("string"), F.col("_set"))
    )


def _subset(small: str, large: str) -> Column:
    return F.size(F.array_except(F.col(small), F.col(large))) == 0


def _place(mun: str, tract: str) -> Column:
    return F.struct(F.col(mun).alias("m"), F.col(tract).alias("t"))


def name_matches(target_names: DataFrame, registry_names: DataFrame) -> DataFrame:
    """First matching place of every distinct target name.

    Both sides have ``AREA``, ``_name``, ``_set``, ``_len``; the registry side also ``_place``.
    """
    known = registry_names.withColumnsRenamed({"_set": "_rset", "_len": "_rlen"}).drop("_name")
    words = known.withColumn("_word", F.explode("_rset"))
    vocab = words.groupBy(*AREA, "_word").agg(
        F.count(F.lit(1)).alias("_freq"), F.min("_place").alias("_word_place")
    )
    wanted = target_names.withColumn("_word", F.explode("_set"))
    rarest = F.min(F.struct("_freq", "_word"))["_word"]

    # Target is the shorter name: all of its words must be known.
    probe = (
        wanted.join(vocab, [*AREA, "_word"])
        .groupBy(*AREA, "_name", "_set", "_len")
        .agg(F.count(F.lit(1)).alias("_hits"), rarest.alias("_word"), F.min("_word_place").alias("_word_place"))
        .filter(F.col("_hits") == F.size("_set"))
    )
    single = probe.filter(F.col("_len") == 1).select(*AREA, "_name", F.col("_word_place").alias("_place"))
    longer = (
        probe.filter(F.col("_len") > 1)
        .drop("_word_place")
        .join(words, [*AREA, "_word"])
        .filter((F.col("_len") <= F.col("_rlen")) & _subset("_set", "_rset"))
        .select(*AREA, "_name", "_place")
    )

    # Registry name is the shorter one: look it up by its own rarest word.
    anchored = (
        words.join(vocab.drop("_word_place"), [*AREA, "_word"])
        .groupBy(*AREA, "_rset", "_rlen")
        .agg(rarest.alias("_word"), F.min("_place").alias("_place"))
    )
    shorter = (
        wanted.join(anchored, [*AREA, "_word"])
        .filter((F.col("_rlen") < F.col("_len")) & _subset("_rset", "_set"))
        .select(*AREA, "_name", "_place")
    )
    found = single.unionByName(longer).unionByName(shorter)
    return found.groupBy(*AREA, "_name").agg(F.min("_place").alias("_matched"))


def modal_places(registry: DataFrame, mun: str, tract: str) -> DataFrame:
    """Most frequent municipality per postcode and most frequent tract in it."""
    tracts = registry.groupBy(*AREA, mun, tract).agg(F.count(F.lit(1)).alias("_n"))
    towns = tracts.groupBy(*AREA, mun).agg(
        F.sum("_n").alias("_n"), F.min(F.struct((-F.col("_n")).alias("n"), F.col(tract).alias("t"))).alias("_best")
    )
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(mun).alias("m"), F.col("_best.t").alias("t")))
    return towns.groupBy(*AREA).agg(best.alias("_b")).select(
        *AREA, F.struct(F.col("_b.m").alias("m"), F.col("_b.t").alias("t")).alias("_modal")
    )


def geocode_by_neighbors(
    targets: DataFrame, registry: DataFrame, target_name: str, registry_name: str, mun: str, tract: str
) -> DataFrame:
    """Targets with ``cve_mun``, ``cvegeo`` and ``geocode_method``.

    Both sides carry ``state`` and ``postcode``, compared trimmed; blank or NULL ones never
    match, and their rows stay out of the joins.
    """
    trimmed = {c: F.trim(F.col(c)) for c in AREA}
    registry = registry.withColumns(trimmed)
    own = [c if c not in AREA else f"_own_{c}" for c in targets.columns]
    targets_named = targets.withColumns({f"_own_{c}": F.col(c) for c in AREA}).withColumns(trimmed)
    usable = (F.col("postcode") != "") & (F.col("state") != "")
    reg = registry.filter(usable)
    t = _names(targets_named, F.col(target_name))
    asked = t.filter(usable & (F.col("_len") > 0)).select(*AREA, "_name", "_set", "_len").distinct()
    offered = (
        _names(reg, F.col(registry_name))
        .filter(F.col("_len") > 0)
        .groupBy(*AREA, "_name", "_set", "_len")
        .agg(F.min(_place(mun, tract)).alias("_place"))
    )
    blank = ~F.coalesce(usable, F.lit(False))
    placed = t.filter(~blank).join(name_matches(asked, offered), [*AREA, "_name"], "left")
    placed = placed.join(modal_places(reg, mun, tract), AREA, "left")
    out = placed.unionByName(t.filter(blank), allowMissingColumns=True)
    place = F.coalesce(F.col("_matched"), F.col("_modal"))
    method = (
        F.when(F.col("_matched").isNotNull(), METHODS[0]).when(F.col("_modal").isNotNull(), METHODS[1])
    ).otherwise(METHODS[2])
    return out.select(
        *[F.col(o).alias(c) for o, c in zip(own, targets.columns)],
        place["m"].alias("cve_mun"),
        place["t"].alias("cvegeo"),
        method.alias("geocode_method"),
    )
