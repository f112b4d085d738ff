"""Stored summaries: built in a set order, read in preference to live aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from demarca.sources.sinks import overwrite

Build = Callable[[], DataFrame]


def build_summaries(builders: dict[str, Build], root: str, order: Sequence[str]) -> list[str]:
    """Write the named summaries below ``root``, in order (put the cheap ones first)."""
    missing = [n for n in order if n not in builders]
    if missing:
        raise ValueError(f"no builder for {missing}")
    for name in order:
        overwrite(builders[name](), f"{root}/{name}")
    return list(order)


def summary_or_live(spark: SparkSession, path: str, live: Build) -> DataFrame:
    """The stored summary if it exists, else the live aggregation with the same rows."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return live()
