import datetime
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from demarca.functions import geo, keys, measures, text
from demarca.operators import filters


def values(spark, fn, items, schema="c string"):
    df = spark.createDataFrame([(i,) for i in items], schema)
    return [r[0] for r in df.select(fn(F.col("c"))).collect()]


def test_clean_text(spark):
    got = values(spark, text.clean_text, [" a ", "", " NULL ", "\t\n", None, "null x", "  b"])
    assert got == ["a", None, None, None, None, "null x", "b"]


def test_tokens_become_null_and_other_text_fails(spark):
    assert values(spark, lambda c: text.typed(c, ["*", ""], "int"), ["*", "", "07", None]) == [None, None, 7, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        values(spark, lambda c: text.typed(c, ["*"], "int"), ["x"])


def test_guarded_number_and_thousands(spark):
    assert values(spark, text.guarded_number, ["12", "-3.5", "1e3", "00-3", ""]) == [12.0, -3.5, None, None, None]
    assert values(spark, text.strip_thousands, ["1,234,567"]) == ["1234567"]


def test_parse_coord_takes_leading_number(spark):
    assert values(spark, text.parse_coord, [" 19.5 N", "-99", "x1", "", None, ".5", "1e2m"]) == [
        19.5, -99.0, None, None, None, 0.5, 100.0,
    ]


def test_parse_date(spark):
    got = values(spark, text.parse_date, ["05/11/2019", "2020-02-29T10:00", "31/02/2020", "2019", ""])
    assert got == [datetime.date(2019, 11, 5), datetime.date(2020, 2, 29), None, None, None]


def test_fold_and_tokens(spark):
    assert values(spark, text.fold_text, ["  Niño,  de la Peña-Gómez ß", None]) == ["NINO DE LA PENA GOMEZ", ""]
    assert values(spark, text.tokens, [" Col.  Ñuñoa ", ""]) == [["COL", "NUNOA"], []]


def test_licence_flags_match_whole_words(spark):
    flags = text.class_flags(F.col("c"), text.LICENCE_PATTERNS)
    df = spark.createDataFrame([("Vacunas/Sueros",), ("REVACUNAR",), ("psicotrópicas",), (None,)], "c string")
    got = df.select(*[c.alias(n) for n, c in flags.items()]).collect()
    assert got[0].has_vacunas and got[0].has_sueros_antitoxinas and not got[0].has_toxoides
    assert not any(got[1]) and got[2].has_psicotropicos and not any(got[3])


def test_compact_number(spark):
    got = values(
        spark, text.compact_number, [1234567.0, 12345.0, 12.345, 1.5, 0.0345, float("nan"), None, 2e9, -2500.0], "c double"
    )
    assert got == ["1.2M", "12.3k", "12.3", "1.50", "0.035", "—", "—", "2.0B", "-2.5k"]


def test_keys(spark):
    assert values(spark, lambda c: keys.pad(c, 3), ["7", "1234", None]) == ["007", None, None]
    assert values(spark, lambda c: keys.derive_code(c, 6, 2), ["0900146411", "09001X6", "0900"]) == ["46", None, None]
    assert values(spark, keys.is_catch_all, ["09998", "09999", "09997"]) == [True, True, False]
    assert values(spark, lambda c: keys.at_grain(c, "locality"), ["0900100012345"]) == ["090010001"]


def test_ratio_rounds_half_away_and_guards_zero(spark):
    df = spark.createDataFrame([(1, 8), (-1, 8), (2675, 1000), (5, 0), (None, 3)], "n long, d long")
    got = [r[0] for r in df.select(measures.ratio(F.col("n"), F.col("d"), 1, 2).cast("string")).collect()]
    assert got == ["0.13", "-0.13", "2.68", None, None]
    assert [r[0] for r in df.select(measures.round_to_long(F.lit("2.5").cast("decimal(4,2)"))).take(1)] == [3]


@settings(max_examples=15, deadline=None)
@given(st.integers(-(10**12), 10**12), st.integers(1, 10**12))
def test_ratio_is_exact(spark, num, den):
    from decimal import ROUND_HALF_UP, Decimal, getcontext

    getcontext().prec = 60
    want = (Decimal(num) * 100 / Decimal(den)).quantize(Decimal("0.01"), ROUND_HALF_UP)
    df = spark.range(1).select(measures.percent(F.lit(num), F.lit(den)).alias("p"))
    assert df.first().p == want


def test_grades(spark):
    assert values(spark, measures.grade_or_missing, ["Alto", "alto", None]) == ["Alto", "sin_dato", "sin_dato"]
    assert values(spark, measures.ordinal, ["Muy bajo", "Muy alto", "x", None]) == [1, 5, None, None]


def test_taxonomy_filter_rules():
    cols = {2: "s", 4: "r", 6: "c"}
    for bad in ([], ["4"], ["46a"], ["46", "4641"]):
        with pytest.raises(ValueError):
            filters.taxonomy_filter(bad, cols)
    filters.taxonomy_filter(["46", "4641"], cols, mixed=True)
    filters.taxonomy_filter(["11"] * 17, cols, mixed=True)


def test_grade_filter_rejects_unknown_and_duplicates():
    for bad in (["alto"], ["Alto", "Alto"]):
        with pytest.raises(ValueError):
            filters.grade_filter(F.lit("x"), bad)


def test_name_contains_has_no_wildcards(spark):
    assert values(spark, lambda c: filters.name_contains(c, "50%_"), ["Al 50%_ más", "Al 50 xx"]) == [True, False]


def test_haversine_and_box(spark):
    km = spark.range(1).select(geo.haversine_km(F.lit(-99.1332), F.lit(19.4326), F.lit(-103.3496), F.lit(20.6597))).first()[0]
    assert abs(km - 461.2) < 1.5
    dlon, dlat = geo.degrees_around(19.4, 10)
    assert math.isclose(dlat, math.degrees(10 / geo.EARTH_KM)) and dlon > dlat


def test_folding_keeps_letters_outside_latin_1(spark):
    assert values(spark, text.fold_text, ["1ª Sección", "Łódź", "Nº 5", None]) == ["1A SECCION", "ODZ", "NO 5", ""]


def test_compact_label_of_infinity(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1234.0,)], "v double")
    got = [r[0] for r in df.select(text.compact_number(F.col("v"))).collect()]
    assert got == ["—", "—", "—", "1.2k"]
