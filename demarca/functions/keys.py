"""Territorial and activity codes: assembly, derivation, prefixes, domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code shapes.
STATE = r"^(0[1-9]|[12][0-9]|3[0-2])$"
MUNICIPALITY_PART = r"^[0-9]{1,3}$"
MUNICIPALITY = r"^(0[1-9]|[12][0-9]|3[0-2])[0-9]{3}$"
TRACT = r"^([0-9A-Z]{9}|[0-9A-Z]{13})$"
CATCH_ALL = r"99[89]$"
YEAR = r"^[0-9]{4}$"

#: Prefix length of each territorial grain inside a full key.
GRAIN_WIDTH = {"state": 2, "municipality": 5, "locality": 9, "tract": 13, "block": 16}


def make_key(*parts: tuple[Column, int | None]) -> Column:
    """Concatenate code parts, zero-padding those that carry a width.

    A part longer than its width would be cut by ``lpad``, which would turn a bad
    code into somebody else's good one, so such keys are NULL instead.
    """
    pieces = []
    for c, width in parts:
        if width is None:
            pieces.append(c)
        else:
            pieces.append(F.when(F.length(c) <= width, F.lpad(c, width, "0")))
    return F.concat(*pieces)


def pad(c: Column, width: int) -> Column:
    """Zero-pad one code part."""
    return make_key((c, width))


def derive_code(identifier: Column, start: int, length: int) -> Column:
    """Digits of an identifier from 1-based ``start``; NULL unless all are digits."""
    piece = F.substring(identifier, start, length)
    return F.when(piece.rlike(rf"^[0-9]{{{length}}}$"), piece)


def at_grain(key: Column, grain: str) -> Column:
    """Roll a nested key up to a coarser grain by prefix."""
    return F.left(key, F.lit(GRAIN_WIDTH[grain]))


def is_state(c: Column) -> Column:
    return F.trim(c).rlike(STATE)


def is_municipality_part(c: Column) -> Column:
    return F.trim(c).rlike(MUNICIPALITY_PART)


def is_catch_all(key: Column, pattern: str = CATCH_ALL) -> Column:
    """Publisher buckets such as ``…998`` and ``…999`` that name no place."""
    return key.rlike(pattern)


def label_key(c: Column) -> Column:
    """Neighbourhood and name labels compare trimmed and in upper case."""
    return F.upper(F.trim(c))
