import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from demarca.plans.census import social_lag
from demarca.sources import contracts, delimited, lookups, registry, sinks, summaries


def write(path, data: bytes):
    path.write_bytes(data)
    return str(path)


def test_contract_csv_keeps_text_and_checks_header(spark, tmp_path):
    good = write(tmp_path / "a.csv", "﻿cve,valor\r\n01,\r\n002,\"a,b\"\r\n".encode())
    df = delimited.read_contract_csv(spark, good, ["cve", "valor"])
    assert rows(df) == [("002", "a,b"), ("01", "")]
    bad = write(tmp_path / "b.csv", b"cve,otro\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        delimited.read_contract_csv(spark, bad, ["cve", "valor"])
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder / "1.csv", b"cve,valor\n1,2\n")
    write(folder / "2.csv", b"cve,otro\n3,4\n")
    with pytest.raises(Exception, match="header|HEADER"):
        delimited.read_contract_csv(spark, str(folder), ["cve", "valor"]).collect()
    short = write(tmp_path / "c.csv", b"cve,valor\n1\n")
    with pytest.raises(Exception, match="MALFORMED"):
        delimited.read_contract_csv(spark, short, ["cve", "valor"]).collect()


def test_legacy_charset_and_renames(spark, tmp_path):
    data = "Año,Cve. Municipio,Bien jurídico afectado\n2020,1001,Robo – año\n".encode("cp1252")
    path = write(tmp_path / "m.csv", data)
    df = delimited.read_header_csv(spark, path, "windows-1252", renames=contracts.MONTHLY_CRIME_HEADER)
    assert df.columns == ["ano", "cve_municipio", "bien_juridico"]
    assert rows(df) == [("2020", "1001", "Robo – año")]
    with pytest.raises(ValueError, match="unknown"):
        delimited.read_header_csv(spark, path, "windows-1252", renames={"año": "ano"})
    latin = write(tmp_path / "l.csv", "a,b\nñ,é\n".encode("latin-1"))
    assert rows(delimited.read_contract_csv(spark, latin, ["a", "b"], "ISO-8859-1")) == [("ñ", "é")]
    broken = delimited.read_contract_csv(spark, latin, ["a", "b"])
    assert rows(delimited.undecodable_rows(broken)) == [(1, 1)]


def test_header_csv_identifiers(spark, tmp_path):
    ok = write(tmp_path / "h.csv", b"ENTIDAD,MUN,LOC\n01,001,0001\n")
    assert delimited.read_header_csv(spark, ok, required=["entidad", "loc"]).columns == ["entidad", "mun", "loc"]
    for header, required in ((b"a;drop,b\n", ()), (b"a,b\n", ("c",))):
        bad = write(tmp_path / "bad.csv", header + b"1,2\n")
        with pytest.raises(ValueError):
            delimited.read_header_csv(spark, bad, required=required)


def test_positions_survive_a_rename(spark, tmp_path):
    one = write(tmp_path / "q1.csv", b"x,ent,w\na,1,5\n")
    two = write(tmp_path / "q3.csv", b"x,cve_ent,w\nb,2,6\n")
    parts = {q: delimited.select_by_position(spark, p, {"ent": 2, "w": 3}) for q, p in (("1", one), ("3", two))}
    assert rows(delimited.union_tagged(parts, "trimestre")) == [("1", "5", "1"), ("2", "6", "3")]
    with pytest.raises(ValueError):
        delimited.select_by_position(spark, one, {"ent": 9})
    assert delimited.skip_national(["c_nac_1", "b_ags_1"]) == ["b_ags_1"]
    with pytest.raises(ValueError):
        delimited.rename_columns(parts["1"], {"ent": "e"})


def test_registry_json_array_and_normal_form(spark, tmp_path):
    base = {f: "" for f in contracts.REGISTRY}
    records = [
        {**base, "CLEE": "09001464111000012000", "Nombre": " FARMACIA ", "Ubicacion": "TLALPAN, CDMX", "Latitud": "19.3",
         "Longitud": "-99.1", "Fecha_Alta": "01/07/2010", "Colonia": "null"},
        {**base, "CLEE": "0900", "RAMA_ACTIVIDAD_ID": "4641", "AreaGeo": "09012"},
    ]
    path = write(tmp_path / "r.json", json.dumps(records).encode())
    got = registry.normalize_registry(registry.read_registry(spark, path))
    a, b = sorted(got.collect(), key=lambda r: r.clee, reverse=True)
    assert (a.nombre, a.municipio, a.colonia, a.entidad, a.area_geo) == ("FARMACIA", "TLALPAN", None, "09", "09001")
    assert (a.clase_actividad_id, a.sector_actividad_id, a.latitud, str(a.fecha_alta)) == ("464111", "46", 19.3, "2010-07-01")
    assert (b.rama_actividad_id, b.area_geo, b.clase_actividad_id, b.ageb) == ("4641", "09012", None, None)
    assert json.loads(a.raw_json)["CLEE"] == a.clee
    assert len(got.columns) == 37


def test_contract_sizes():
    sizes = {
        "DEATHS": 74,
        "INCOME_SURVEY": 126,
        "WELFARE": 14,
        "TRAFFIC": 26,
        "HOUSING_FINANCE": 16,
        "COMMERCIAL_CREDIT": 18,
        "SOCIAL_LAG": 19,
        "POVERTY": 37,
        "INCLUSION_MUNICIPAL_NUMBERS": 70,
    }
    for name, n in sizes.items():
        cols = getattr(contracts, name)
        assert len(cols) == n and len(set(cols)) == n, name


def test_lookups(spark):
    sizes = {"states": 32, "official_totals": 32, "bodies": 26, "banks": 18, "modalities": 4, "destinations": 18,
             "tiers": 6, "airports": 64, "sectors": 23}
    for name, n in sizes.items():
        assert lookups.lookup(spark, name).count() == n, name


def test_upsert_last_write_wins_and_skips_empty_keys(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 9), ("", 7), (None, 8)], "k string, v int")
    assert rows(sinks.upsert(old, new, "k", [F.desc("v")])) == [("a", 1), ("b", 3), ("c", 9)]


def test_replace_partition_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("x", 1), ("y", 2)], "p string, v int")
    sinks.overwrite(df, path, ["p"])
    sinks.replace_partition(spark.createDataFrame([(5, "x")], "v int, p string"), path, ["p"])
    assert rows(spark.read.parquet(path).select("p", "v")) == [("x", 5), ("y", 2)]
    sinks.overwrite(df, path)
    assert spark.read.parquet(path).count() == 2


def test_geojson(spark, tmp_path):
    df = spark.createDataFrame([("a", "N", -99.5, 19.0), ("b", None, None, 1.0)], "clee string, nombre string, lon double, lat double")
    lines = [json.loads(r.value) for r in sinks.to_geojson_lines(df, "lon", "lat", ["clee", "nombre"], False).collect()]
    by = {x["properties"]["clee"]: x for x in lines}
    assert by["a"]["geometry"] == {"type": "Point", "coordinates": [-99.5, 19.0]}
    assert by["b"]["geometry"] is None and by["b"]["properties"] == {"clee": "b", "nombre": None}
    assert sinks.to_geojson_lines(df, "lon", "lat", ["clee"]).count() == 1
    with pytest.raises(ValueError):
        sinks.to_geojson_lines(df, "lon", "lat", ["clee"], limit=1)
    out = str(tmp_path / "g")
    sinks.export_geojson(df, out, "lon", "lat", ["clee"], geometry_only=False, order=[F.asc("clee")], limit=1)
    assert spark.read.text(out).count() == 1
    assert rows(sinks.without_geometry(df, "lon", "lat")) == [(2, 1)]


def test_summaries_in_order_and_fallback(spark, tmp_path):
    root, seen = str(tmp_path / "s"), []

    def builder(name, value):
        def build():
            seen.append(name)
            return spark.createDataFrame([(value,)], "v int")

        return build

    made = summaries.build_summaries({"dear": builder("dear", 2), "cheap": builder("cheap", 1)}, root, ["cheap", "dear"])
    assert made == seen == ["cheap", "dear"]
    live = builder("live", 3)
    assert rows(summaries.summary_or_live(spark, f"{root}/cheap", live)) == [(1,)]
    assert rows(summaries.summary_or_live(spark, f"{root}/none", live)) == [(3,)]
    with pytest.raises(ValueError):
        summaries.build_summaries({}, root, ["x"])


def test_typed_view_fails_on_unexpected_text(spark):
    raw = spark.createDataFrame([("01001", "x1", "n.d", "Alto", "n.d")],
                                "cve_mun_local string, pob_total string, irs_indice string, irs_grado string, irs_lugar_nacional string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        social_lag(raw).collect()


def test_files_of_one_folder_may_order_columns_but_not_change_them(spark, tmp_path):
    (tmp_path / "a_01.csv").write_text('x,"y, long"\n1,2\n')
    (tmp_path / "a_02.csv").write_text('"y, long",x\n4,3\n')
    names = {"x": "x", "y,_long": "y"}
    df = delimited.read_header_csv(spark, str(tmp_path), renames=names, tag={"part": r"_(\d+)\."})
    assert sorted(tuple(r) for r in df.collect()) == [("1", "2", "01"), ("3", "4", "02")]
    (tmp_path / "a_03.csv").write_text("x\n5\n")
    with pytest.raises(ValueError):
        delimited.read_header_csv(spark, str(tmp_path), renames=names)
    picked = delimited.select_by_position(spark, str(tmp_path), {"first": 1})
    assert sorted(r.first for r in picked.collect()) == ["1", "4", "5"]


def test_quoted_cells_with_line_breaks(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b\n"one\ntwo, ""three""",2\n')
    df = delimited.read_contract_csv(spark, str(tmp_path / "m.csv"), ["a", "b"], multi_line=True)
    assert [tuple(r) for r in df.collect()] == [('one\ntwo, "three"', "2")]


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    for n in range(150):
        (tmp_path / f"f {n:03d}.csv").write_bytes(("\ufeffA,\"b, c\"\r\n" if n % 2 else '"b, c",A\n').encode() + b"1,2\n" * 50)
    spark.sparkContext.setJobGroup("headers", "headers")
    found = delimited.headers_of(spark, str(tmp_path))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 150 and len(jobs) == 1
    assert [v for _, v in sorted(found.items())][:2] == [["b, c", "A"], ["A", "b, c"]]
    df = delimited.read_header_csv(spark, str(tmp_path), renames={"a": "a", "b,_c": "b"})
    assert df.count() == 150 * 50 and sorted(tuple(r) for r in df.distinct().collect()) == [("1", "2"), ("2", "1")]
    (tmp_path / "f 150.csv").write_text("A,b\n1,2\n")
    with pytest.raises(ValueError, match="150"):
        delimited.read_header_csv(spark, str(tmp_path), renames={"a": "a", "b": "x", "b,_c": "b"})
    (tmp_path / "f 150.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        delimited.headers_of(spark, str(tmp_path))
