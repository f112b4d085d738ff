"""Cleaning of values that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

# Whitespace trimmed from text fields.
BLANKS = " \t\n\r\x0b\x0c\u00a0\ufeff"

# Accented Latin letters and the plain letter each folds to.
ACCENTED = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝáàâäãåéèêëíìîïóòôöõúùûüñçýÿªº" + (
    "ĀāĂăĄąĆćĈĉĊċČčĎďĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĨĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽž"
)
FOLDED = "AAAAAAEEEEIIIIOOOOOUUUUNCYaaaaaaeeeeiiiiooooouuuuncyyao" + (
    "AaAaAaCcCcCcCcDdEeEeEeEeEeGgGgGgGgHhIiIiIiIiIJjKkLlLlLlNnNnNnOoOoOoRrRrRrSsSsSsSsTtTtUuUuUuUuUuUuWwYyYZzZzZz"
)

# Text that looks like a plain decimal number.
PLAIN_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"
COORDINATE = r"^-?[0-9]+\.?[0-9]*$"
LEADING_NUMBER = r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"


def strip(c: Column) -> Column:
    """Trim all blanks, not only spaces."""
    return F.btrim(c, F.lit(BLANKS))


def clean_text(c: Column) -> Column:
    """Trimmed text, NULL where it is blank or spells ``null``."""
    t = strip(c)
    return F.when((t != "") & (F.lower(t) != "null"), t)


def null_tokens(c: Column, tokens: list[str] | tuple[str, ...]) -> Column:
    """NULL where the text is one of the source's missing-value tokens."""
    return F.when(~c.isin(list(tokens)), c)


def typed(c: Column, tokens: list[str] | tuple[str, ...], to: str | DataType) -> Column:
    """Missing-value tokens to NULL, then a strict cast: other text fails the job."""
    return null_tokens(c, tokens).cast(to)


def strip_thousands(c: Column) -> Column:
    """Drop the thousands separator."""
    return F.replace(c, F.lit(","), F.lit(""))


def guarded_number(c: Column, to: str | DataType = "double", pattern: str = PLAIN_NUMBER) -> Column:
    """The number where the text matches ``pattern``, else NULL."""
    return F.when(c.rlike(pattern), c).try_cast(to)


def parse_coord(c: Column) -> Column:
    """Leading number of the text as a double; text after the number is ignored."""
    lead = F.regexp_extract(strip(c), LEADING_NUMBER, 1)
    return F.when(lead != "", lead).try_cast("double")


def parse_date(c: Column) -> Column:
    """``DD/MM/YYYY`` or an ISO prefix; anything else is NULL."""
    day_first = F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(c, "dd/MM/yyyy"))
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.left(c, F.lit(10)), "yyyy-MM-dd"))
    return F.coalesce(day_first, iso)


def first_part(c: Column) -> Column:
    """Text before the first comma, NULL when that is empty."""
    part = strip(F.split_part(c, F.lit(","), F.lit(1)))
    return F.when(part != "", part)


def fold_text(c: Column) -> Column:
    """Upper case without accents or punctuation, single spaces, never NULL."""
    plain = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), ACCENTED, FOLDED), r"[^\x00-\x7F]+", "")
    return F.trim(F.regexp_replace(F.upper(plain), r"[^A-Z0-9]+", " "))


def tokens(c: Column) -> Column:
    """Words of a folded text, in order; an empty array for an empty text."""
    return F.filter(F.split(fold_text(c), " "), lambda w: w != "")


def class_flags(c: Column, patterns: dict[str, str]) -> dict[str, Column]:
    """One boolean per named whole-word pattern, matched on the folded text."""
    folded = fold_text(c)
    return {name: folded.rlike(rf"\b({body})\b") for name, body in patterns.items()}


# Authorised-line words behind the six licence flags.
LICENCE_PATTERNS = {
    "has_estupefacientes": "ESTUPEFACIENTES?",
    "has_psicotropicos": "PSICOTROPIC[OA]S?",
    "has_vacunas": "VACUNAS?",
    "has_toxoides": "TOXOIDES?",
    "has_sueros_antitoxinas": "SUEROS?|ANTITOXINAS?",
    "has_hemoderivados": "HEMODERIVADOS?",
}


def compact_number(c: Column) -> Column:
    """Short label of a number: 1.2M, 12.3k, 12.3, 1.23, 0.034."""
    size = F.abs(c)

    def scaled(by: float, digits: int, suffix: str) -> Column:
        return F.format_string(f"%.{digits}f{suffix}", F.round(c / F.lit(by), digits))

    return (
        F.when(c.isNull() | F.isnan(c) | (size == float("inf")), F.lit("—"))
        .when(size >= 1e9, scaled(1e9, 1, "B"))
        .when(size >= 1e6, scaled(1e6, 1, "M"))
        .when(size >= 1e3, scaled(1e3, 1, "k"))
        .when(size >= 10, scaled(1.0, 1, ""))
        .when(size >= 1, scaled(1.0, 2, ""))
        .otherwise(scaled(1.0, 3, ""))
    )
