import pytest
from conftest import rows
from pyspark.sql import functions as F

from demarca.operators import aggregate, joins, layers, quality, reshape
from demarca.plans import indices


def test_mode_prefers_smallest_on_tie(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", None), ("b", "z")], "k string, v string")
    assert rows(aggregate.mode_by(df, ["k"], "v", "m")) == [("a", "x"), ("b", "z")]


def test_top_n_array_orders_by_count_then_value(spark):
    data = [("k", r) for r in ["r3"] * 3 + ["r1"] * 2 + ["r2"] * 2 + ["r9"]] + [("k", None)]
    df = spark.createDataFrame(data, "k string, r string")
    assert aggregate.top_n_array(df, ["k"], "r", 3, "top").first().top == ["r3", "r1", "r2"]


def test_id_pages_concatenate_to_the_ordered_list(spark):
    df = spark.range(0, 95).select((F.col("id") % 2).alias("g"), "id")
    got = aggregate.id_pages(df, ["g"], "id", F.floor(F.col("id") / 10)).orderBy("g", "page").collect()
    assert [i for r in got if r.g == 1 for i in r.ids] == list(range(1, 95, 2))
    assert max(len(r.ids) for r in got) <= 10


def test_tier_shares_are_null_when_nothing_is_classified(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", None, 5), ("b", None, 3), ("c", 2, 0)], "k string, tier int, n int")
    got = rows(df.groupBy("k").agg(*aggregate.tier_shares(F.col("n"), F.col("tier"), {1: "one", 2: "two"})))
    assert [(k, None if a is None else float(a), None if b is None else float(b)) for k, a, b in got] == [
        ("a", 100.0, 0.0), ("b", None, None), ("c", None, None),
    ]


def test_weighted_mean_counts_missing_weight_as_zero(spark):
    df = spark.createDataFrame([("a", "10.0", 1), ("a", "40.0", 2), ("a", "99.0", None), ("b", "5.0", None)], "k string, v string, w int")
    got = df.groupBy("k").agg(aggregate.weighted_mean(F.col("v").cast("decimal(6,2)"), F.col("w")).cast("double").alias("m"))
    assert rows(got) == [("a", 30.0), ("b", None)]


def test_numbered_columns_are_anchored():
    cols = ["adm02", "adm23", "admisiones", "adm_x", "aob02", "xadm02"]
    assert aggregate.numbered_columns(cols, "adm") == ["adm02", "adm23"]
    with pytest.raises(ValueError):
        aggregate.row_sum([])


def test_months_to_rows_drops_blanks(spark):
    df = spark.createDataFrame([("a", "3", "", None)], "k string, enero string, febrero string, marzo string")
    assert rows(reshape.months_to_rows(df, ["enero", "febrero", "marzo"])) == [("a", 1, 3)]


def test_nested_groups_and_markers(spark):
    df = spark.createDataFrame([("a", 1, None, 5), ("b", None, None, 6)], "k string, x int, y int, z int")
    got = {r.k: r for r in reshape.nest(df, {"g": ["x", "y"]}, {"g": reshape.any_known("x", "y")}).collect()}
    assert got["a"].g.x == 1 and got["a"].g.y is None and got["b"].g is None and got["b"].z == 6


def test_zero_and_null_rows(spark):
    df = spark.createDataFrame([("a", 4)], "k string, n int")
    assert rows(reshape.zero_row(df, "k", "zz", ["n"])) == [("zz", 0)]
    assert rows(reshape.zero_row(df, "k", "a", ["n"])) == [("a", 4)]
    assert rows(reshape.null_row(df, "k", "zz")) == [("zz", None)]


def test_clean_columns(spark):
    df = spark.createDataFrame([("a", "*", "5")], "k string, x string, y string")
    assert rows(reshape.clean_columns(df, ["*"], {"x": "int", "y": "int"})) == [("a", None, 5)]


def test_one_row_has_nulls_for_missing_sides(spark):
    a = spark.createDataFrame([("s", 1)], "k string, x int")
    b = spark.createDataFrame([("t", 2)], "k string, y int")
    assert rows(joins.one_row("k", "s", [a, b])) == [("s", 1, None)]


def test_assemble_layers_keeps_keys_with_any_value(spark):
    keys = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "k string")
    one = spark.createDataFrame([("a", 1.0), ("c", None)], "k string, v double")
    two = spark.createDataFrame([("b", 2.0), ("z", 9.0)], "k string, v double")
    assert rows(joins.assemble_layers(keys, {"one": one, "two": two})) == [("a", 1.0, None), ("b", None, 2.0)]
    with pytest.raises(ValueError):
        joins.assemble_layers(keys, {})


def test_layer_checks(spark):
    with pytest.raises(ValueError, match="not registered"):
        layers.layer_values({}, "muni", ["nope"])
    with pytest.raises(ValueError, match="grain"):
        layers.layer_values({}, "ageb", ["pobreza_pct"])
    df = spark.createDataFrame([("01001", 2000, 5)], "cve_mun string, ano int, total_delitos long")
    with pytest.raises(ValueError, match="year"):
        layers.layer({"crime_yearly": df}, "total_delitos_year")
    assert len(layers.LAYERS) == 20


def test_bin_index_is_strict_below(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,), (float("nan"),)], "v double")
    got = [r[0] for r in df.select(layers.bin_index(F.col("v"), [F.lit(2.0), F.lit(3.0)])).collect()]
    assert got == [0, 1, 2, None, None]


def test_quantile_bins_of_equal_values(spark):
    df = spark.createDataFrame([(5.0,)] * 4 + [(None,)], "v double")
    assert sorted(repr(r.b) for r in layers.quantile_bins(df, "v", 3, "b").collect()) == ["2"] * 4 + ["None"]


def test_grouped_quantile_bins(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(9)] + [("b", float(i * 100)) for i in range(9)], "g string, v double")
    got = layers.quantile_bins(df, "v", 3, "b", ["g"]).groupBy("g", "b").count()
    assert rows(got) == [(g, b, 3) for g in "ab" for b in range(3)]


def test_range_position_of_constant(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 4.0), (3, None)], "id int, v double")
    assert rows(layers.range_position(df, "v").select("id", "position")) == [(1, 0.5), (2, 0.5), (3, None)]


def test_drill_steps():
    assert layers.next_level(layers.GEO_LEVELS, "municipality", True) == "tract"
    assert layers.next_level(layers.GEO_LEVELS, "tract", True) == "tract"
    assert layers.next_level(layers.ACTIVITY_LEVELS, 2, False) == 2
    assert layers.pick_dataset(["censo.pobtot_ageb", "coneval.grado_rezago_ageb"]) == "tract_wide"
    with pytest.raises(ValueError):
        layers.pick_dataset(["censo.pobtot_ageb", "censo.pobtot"])
    assert layers.pick_dataset(["registro.municipio_nombre", "sesnsp.homicidio_doloso"]) == "crime_summary"
    assert layers.pick_dataset(["registro.entidad_nombre", "coneval.pobreza_pct"]) == "treemap_by_state"
    carried = {d for f in layers.FIELDS.values() for d in f.columns}
    assert carried == set(layers.DATASETS)


def test_explorer_drops_rows_without_population(spark):
    df = spark.createDataFrame(
        [("01001", 100, 5, "Alto"), ("01002", None, 7, "Bajo"), (" ", 10, 1, "Bajo"), ("01003", 50, 1, "sin_dato")],
        "municipio string, poblacion long, establecimientos long, irs_grado string",
    )
    data = {"municipality_wide": df}
    rates = layers.explorer_rows(
        data, "registro.municipio_nombre", "registro.total_establecimientos", "coneval.irs_grado", per_1000=True
    )
    assert rows(rates) == [("01001", 50.0, 3.0), ("01003", 20.0, None)]
    counts = layers.explorer_rows(data, "registro.municipio_nombre", "censo.pobtot", per_1000=True, pins=["01001", "01002"])
    assert rows(counts) == [("01001", 100.0, None)]


def test_coverage_status_bands(spark):
    counts = spark.createDataFrame([("01", 99), ("02", 95), ("03", 10), ("04", 1)], "entidad string, loaded long")
    totals = spark.createDataFrame([("01", 100), ("02", 100), ("03", 100)], "entidad string, official_total long")
    got = {r.entidad: r.status for r in quality.coverage_status(counts, totals, "entidad").collect()}
    assert got == {"01": "green", "02": "yellow", "03": "red", "04": "unverified"}


def test_profile_skips_columns_with_gaps(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (3, None, "y")], "a int, b double, c string")
    assert rows(quality.profile(df)) == [(2, "a", 1.0, 3.0, 2.0)]
    assert rows(quality.first_rows(df, [F.desc("a")], 1)) == [(3, None, "y")]


def test_required_nulls(spark):
    df = spark.createDataFrame([("a", ""), (None, "x")], "p string, q string")
    assert rows(quality.required_nulls(df, ["p", "q"]).select("field", "missing", "rows")) == [("p", 1, 2), ("q", 1, 2)]


def test_match_rate_of_empty_table(spark):
    empty = spark.createDataFrame([], "k string")
    assert rows(quality.match_rate(empty, empty, "k", 85)) == [(0, 0, None, None)]


def test_location_score_bounds(spark):
    df = spark.createDataFrame([(50, 5e9, 3, 2000), (50, None, 3, 0)], "base_score long, ingresos double, unidades long, robo_promedio long")
    got = [float(r.score_fase2) for r in indices.location_score(df).collect()]
    assert got == [20 + 20 + 2.25 + 0, 20 + 20 + 2.25 + 25]


def test_prevalence_model_rises_with_its_covariate(spark):
    sample = spark.createDataFrame([(float(i % 10 > 5), i % 10 / 10) for i in range(200)], "sick double, age double")
    areas = spark.createDataFrame([("a", 0.1), ("b", 0.9)], "cvegeo string, age double")
    got = {r.cvegeo: r.prevalence for r in indices.prevalence_model(sample, "sick", ["age"], areas).collect()}
    assert 0 <= got["a"] < got["b"] <= 1


def test_weighted_ratio(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 1, 3), ("b", 5, 0)], "k string, n long, d long")
    got = df.groupBy("k").agg(aggregate.weighted_ratio(F.col("n"), F.col("d")).cast("string").alias("r"))
    assert rows(got) == [("a", "33.33"), ("b", None)]


def test_infinite_values_have_no_class(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(9)] + [(10, float("inf")), (11, float("nan")), (12, None)], "id int, v double")
    got = {r.id: r.b for r in layers.quantile_bins(df, "v", 3, "b").collect()}
    assert [got[i] for i in range(9)] == [0] * 3 + [1] * 3 + [2] * 3 and got[10] is got[11] is got[12] is None


def test_profile_of_small_values_numeric_text_and_one_row(spark):
    df = spark.createDataFrame([(1e-5, "3", "x", 1), (3e-5, " 4 ", "5", None)], "a double, b string, c string, d int")
    got = {r.column: (r.min, r.max, r.mean) for r in quality.profile(df).collect()}
    assert got == {"a": (1e-5, 3e-5, pytest.approx(2e-5)), "b": (3.0, 4.0, 3.5)}
    assert quality.profile(df.limit(1)).count() == 3


def test_every_role_keeps_the_rows_of_its_table(spark, small):
    """Roles on customers and orders lose none, at any number of suppliers."""
    from workbench.kit import Tables

    t = Tables(spark, small)
    for name in ("shops", "licences", "geo_targets", "clinics"):
        assert getattr(t, name).count() == t.customer.count(), name
    for name in ("crime_long", "finance_raw", "morbidity_raw", "movements"):
        assert getattr(t, name).count() == t.orders.count(), name
    assert getattr(t, "shops").select("area_geo").distinct().count() == t.units.count()
