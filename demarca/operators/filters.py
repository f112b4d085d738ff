"""Row filters: grains, domains, taxonomy codes, grades, pins."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.functions.keys import CATCH_ALL, MUNICIPALITY_PART, STATE
from demarca.functions.measures import GRADES

# Activity level reached by each code length.
LEVELS = {2: "sector", 3: "subsector", 4: "rama", 5: "subrama", 6: "clase"}

# Named activity bundles.
BUNDLES = {
    "salud_minorista": ["4641", "46451", "46411"],
    "salud_servicios": ["6211", "6212", "6213", "6221", "6222"],
    "financiero_retail": ["5221", "5222", "5223"],
    "comercio_diario": ["4611", "4612"],
    "comercio_especializado": ["4671", "4673", "4658", "4659", "4631"],
    "hospitalidad": ["7223", "7212", "7224"],
    "educacion_particular": ["6111", "6112", "6113", "6114", "6115", "6116"],
    "servicios_profesionales": ["5411", "5412", "5413", "5416"],
    "belleza_personal": ["8121"],
    "manufactura_ligera": ["3118", "3115", "3119", "3141", "3152"],
}


def select_grain(df: DataFrame, grain: str, mun: str = "mun", loc: str = "loc", state: str = "entidad") -> DataFrame:
    """One grain of a locality census that holds its own total rows."""
    m, loc_c, s = F.col(mun), F.col(loc), F.col(state)
    rules = {
        "state": (loc_c == "0000") & (m == "000") & (s != "00"),
        "municipality": (loc_c == "0000") & (m != "000"),
        "locality": (loc_c != "0000") & (m != "000"),
    }
    return df.filter(rules[grain])


def select_tract_grain(df: DataFrame, grain: str) -> DataFrame:
    """Tract totals or blocks of a tract census that mixes both."""
    block = F.col("mza")
    if grain == "tract":
        parts = [~F.col("ageb").isin("0000", "*"), ~F.col("loc").isin("0000", "*"), ~F.col("mun").isin("000", "*")]
        return df.filter(reduce(lambda a, b: a & b, parts, block == "000"))
    if grain == "block":
        return df.filter((block != "000") & block.rlike("^[0-9]+$"))
    raise ValueError(f"unknown grain {grain!r}")


def totals_only(df: DataFrame, dims: list[str]) -> DataFrame:
    """Rows the source has already added up over all the given dimensions."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(d).isNull() for d in dims]))


def valid_territory(df: DataFrame, state: str, municipality: str | None = None) -> DataFrame:
    """Rows with a state in 01–32 and, if named, a 1–3-digit municipality."""
    keep = F.trim(F.col(state)).rlike(STATE)
    if municipality:
        keep = keep & F.trim(F.col(municipality)).rlike(MUNICIPALITY_PART)
    return df.filter(keep)


def drop_catch_all(df: DataFrame, key: str, pattern: str = CATCH_ALL) -> DataFrame:
    return df.filter(~F.col(key).rlike(pattern))


def _check_codes(codes: list[str]) -> None:
    if not codes:
        raise ValueError("no activity code given")
    for code in codes:
        if not re.fullmatch(r"[0-9]{2,6}", code):
            raise ValueError(f"activity code {code!r} is not 2 to 6 digits")


def taxonomy_filter(codes: list[str], columns: dict[int, str], mixed: bool = False) -> Column:
    """Match activity codes, each on the column of its own length.

    Codes of one length only, unless ``mixed``.
    """
    _check_codes(codes)
    lengths = sorted({len(c) for c in codes})
    if not mixed and len(lengths) > 1:
        raise ValueError("all activity codes must have the same length")
    return reduce(or_, [F.col(columns[n]).isin([c for c in codes if len(c) == n]) for n in lengths])


def prefix_columns(clase: Column) -> dict[str, Column]:
    """The five activity levels as prefixes of a six-digit class code."""
    return {name: F.left(clase, F.lit(n)) for n, name in LEVELS.items()}


def bundle_filter(name: str, columns: dict[int, str]) -> Column:
    """Match a named bundle of activities."""
    return taxonomy_filter(BUNDLES[name], columns, mixed=True)


def grade_filter(c: Column, grades: list[str]) -> Column:
    """Keep the given grades; an empty list keeps everything."""
    unknown = [g for g in grades if g not in GRADES]
    if unknown or len(set(grades)) != len(grades):
        raise ValueError(f"grades must be distinct members of {GRADES}")
    return c.isin(grades) if grades else F.lit(True)


def pin_filter(c: Column, values: list) -> Column:
    """Keep rows whose value, as text, is pinned; no pins keep everything."""
    return c.cast("string").isin([str(v) for v in values]) if values else F.lit(True)


def name_contains(c: Column, text: str) -> Column:
    """Case-insensitive substring match; the text carries no wildcards."""
    return F.contains(F.lower(c), F.lower(F.lit(text)))


def lookup_row(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row with one key."""
    return df.filter(F.col(key) == value)
