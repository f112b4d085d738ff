"""Reshaping: months to rows, flat rows to nested groups, missing units to zero rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.functions.text import null_tokens
from demarca.operators.joins import one_row

# Month columns in calendar order.
MONTHS = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
]


def months_to_rows(df: DataFrame, months: list[str] = MONTHS, month: str = "mes", value: str = "count") -> DataFrame:
    """One row per month with a value; blank cells are dropped."""
    ids = [c for c in df.columns if c not in months]
    number = F.create_map(*[x for i, m in enumerate(months, 1) for x in (F.lit(m), F.lit(i))])
    cells = df.unpivot([F.col(c) for c in ids], [F.col(m) for m in months], "_month", "_cell")
    return cells.filter(F.col("_cell") != "").select(
        *ids, number[F.col("_month")].alias(month), F.col("_cell").cast("long").alias(value)
    )


def nest(df: DataFrame, groups: dict[str, list[str]], markers: dict[str, Column] | None = None) -> DataFrame:
    """Fold columns into named structs; a group is NULL unless its marker holds."""
    folded = {c for cols in groups.values() for c in cols}
    keep = [F.col(c) for c in df.columns if c not in folded]
    structs = []
    for name, cols in groups.items():
        s = F.struct(*cols)
        if markers and name in markers:
            s = F.when(markers[name], s)
        structs.append(s.alias(name))
    return df.select(*keep, *structs)


def any_known(*cols: str) -> Column:
    """True when at least one of the columns has a value."""
    return F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull()


def null_row(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row of one unit, or a row of NULLs."""
    return one_row(key, value, [df])


def zero_row(df: DataFrame, key: str, value: str, measures: list[str]) -> DataFrame:
    """The row of one unit, or a row of zeros when the unit has none."""
    found = null_row(df.select(key, *measures), key, value)
    return found.select(key, *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures])


def clean_columns(df: DataFrame, tokens: list[str], types: dict[str, str]) -> DataFrame:
    """Missing-value tokens to NULL and strict casts on the named columns; others stay."""
    return df.withColumns({c: null_tokens(F.col(c), tokens).cast(t) for c, t in types.items()})
