"""Registering a Spark query beside its DuckDB twin, and pieces of twin SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, DecimalType, IntegerType, TimestampType

from workbench.roles import table, with_roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Driver tables and roles by attribute, for one scale folder."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf, name, self._made)


def plain(df: DataFrame) -> DataFrame:
    """Results in types that compare alike in both engines: long, double, string, boolean."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, IntegerType):
            c = c.cast("long")
        elif isinstance(f.dataType, (DateType, TimestampType)):
            c = c.cast("string")
        elif isinstance(f.dataType, ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under a name, with its twin."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf: plain(fn(Tables(spark, sf)))
        if sql is not None:
            ORACLE[name] = with_roles(sql)
        return fn

    return register


def ratio(num: str, den: str, mul: int = 1, digits: int = 2) -> str:
    """Twin of an exact ratio rounded half away from zero, on 128-bit integers."""
    n = f"(CAST({num} AS HUGEINT) * {mul * 10**digits})"
    d = f"CAST({den} AS HUGEINT)"
    return (
        f"CASE WHEN ({den}) > 0 THEN CAST(sign({n}) * ((2 * abs({n}) + {d}) // (2 * {d})) AS DOUBLE) / {10**digits} END"
    )


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"
