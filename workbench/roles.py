"""Input tables in the shapes the library expects, derived from the driver's tables.

Each role is one SELECT in the dialect Spark SQL and DuckDB share, so both sides of
a comparison start from the same rows. Arithmetic is on integers; doubles come from
an integer divided once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demarca.sources.lookups import SECTORS

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _pad(expr: str, width: int) -> str:
    return f"lpad(CAST({expr} AS STRING), {width}, '0')"


def _milli(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE) / 1000"


ENT = _pad("s.s_nationkey + 1", 2)
MUN = f"{ENT} || {_pad('s.s_suppkey % 1000', 3)}"
SECTOR_DIGITS = "".join(list(SECTORS)[:20])


def _paired(table: str, key: str, other: str, name: str) -> str:
    """A table with ``name``: its key spread over all keys of another table, which run from 0."""
    return f"(SELECT x.*, x.{key} % (SELECT count(*) FROM {{{other}}} n) AS {name} FROM {{{table}}} x)"


CUSTOMERS = _paired("customer", "c_custkey", "supplier", "seller")
ORDERS = _paired("orders", "o_custkey", "supplier", "seller")


def _digits(pk: str) -> str:
    """Six nested activity digits of a part key."""
    at = f"CAST(1 + 2 * ({pk} % 20) AS INT)"
    steps = [(20, 6), (120, 3), (360, 2), (720, 3)]
    rest = " || ".join(f"CAST(1 + CAST(floor({pk} / {by}) AS BIGINT) % {n} AS STRING)" for by, n in steps)
    return f"substr('{SECTOR_DIGITS}', {at}, 2) || {rest}"


def _levels(clase: str) -> str:
    names = {
        "clase_actividad_id": 6,
        "sector_actividad_id": 2,
        "subsector_actividad_id": 3,
        "rama_actividad_id": 4,
        "subrama_actividad_id": 5,
    }
    return ", ".join(f"substr({clase}, 1, {n}) AS {name}" for name, n in names.items())


MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()

ROLES: dict[str, str] = {
    "units": f"""
        SELECT {ENT} AS cve_ent, {MUN} AS cve_mun, min(s.s_suppkey) AS k, min(s.s_name) AS nom_mun
        FROM {{supplier}} s GROUP BY {ENT}, {MUN}""",
    "registry": f"""
        SELECT clee, entidad, CASE WHEN p % 97 = 0 THEN NULL ELSE mun END AS area_geo,
          CASE WHEN o % 13 = 0 THEN '' WHEN o % 19 = 0 THEN NULL ELSE mun || '0001' || {_pad("1 + o % 4", 4)} END AS ageb,
          CASE WHEN p % 17 = 0 THEN NULL WHEN p % 18 = 0 THEN '  '
            ELSE CASE WHEN o % 2 = 0 THEN ' colonia ' ELSE 'Colonia ' END || CAST(p % 23 AS STRING) END AS colonia,
          {_levels("clase")},
          CASE WHEN o % 31 = 0 THEN NULL ELSE estrato END AS estrato,
          CASE WHEN o % 5 = 0 THEN NULL WHEN o % 7 = 0 THEN '' ELSE CAST(o AS STRING) END AS telefono,
          CASE WHEN o % 3 = 0 THEN NULL ELSE CAST(p AS STRING) END AS correo_e,
          CASE WHEN o % 11 = 0 THEN NULL ELSE {_milli("(o * 7919) % 4000 - 100000")} END AS longitud,
          {_milli("(o * 6007 + p) % 4000 + 18000")} AS latitud,
          created AS created_at, created AS updated_at
        FROM (
          SELECT CAST(l.l_orderkey * 8 + l.l_linenumber AS STRING) AS clee, {ENT} AS entidad, {MUN} AS mun,
            {_digits("l.l_partkey")} AS clase, l.l_returnflag || l.l_linestatus AS estrato,
            CAST(CAST(l.l_shipdate AS DATE) AS STRING) AS created, l.l_orderkey AS o, l.l_partkey AS p
          FROM {{lineitem}} l JOIN {{supplier}} s ON s.s_suppkey = l.l_suppkey
        ) t""",
    "shops": f"""
        SELECT 'E' || {_pad("c.c_custkey", 9)} AS clee, c.c_custkey AS num, c.c_name AS nombre,
          {_pad("c.c_nationkey + 1", 2)} AS entidad, {MUN} AS area_geo,
          {_levels(_digits("c.c_custkey"))},
          CASE WHEN c.c_custkey % 41 = 0 THEN NULL ELSE {_milli("(c.c_custkey * 7919) % 4000 - 100000")} END AS longitud,
          {_milli("(c.c_custkey * 6007) % 4000 + 18000")} AS latitud,
          c.c_mktsegment AS segment
        FROM {CUSTOMERS} c JOIN {{supplier}} s ON s.s_suppkey = c.seller""",
    "clinics": """
        SELECT clee AS clues, area_geo AS cve_mun, entidad,
          CASE WHEN num % 37 = 0 THEN '' WHEN num % 43 = 0 THEN 'sin dato' ELSE CAST(latitud AS STRING) END AS latitud,
          CASE WHEN longitud IS NULL THEN '' ELSE CAST(longitud AS STRING) END AS longitud
        FROM {shops} x""",
    "census_municipal": f"""
        SELECT cve_mun, cve_ent AS entidad, substr(cve_mun, 3, 3) AS mun, nom_mun, 'Estado ' || cve_ent AS nom_ent,
          CASE WHEN k % 23 = 0 THEN NULL ELSE 1000 + (k * 7919) % 60000 END AS pobtot,
          300 + (k * 131) % 20000 AS pea, CASE WHEN k % 29 = 0 THEN 0 ELSE 700 + (k * 131) % 30000 END AS p_15ymas,
          CASE WHEN k % 13 = 0 THEN NULL ELSE (k * 17) % 9000 END AS psinder, (k * 11) % 7000 AS p_60ymas,
          CAST(CAST((k * 37) % 150 AS DOUBLE) / 10 AS DECIMAL(9,2)) AS graproes
        FROM {{units}} u""",
    "poverty": f"""
        SELECT cve_mun, CASE WHEN k % 19 = 0 THEN NULL ELSE 1000 + (k * 7919) % 60000 END AS poblacion,
          CAST(CAST((k * 31) % 1000 AS DOUBLE) / 10 AS DECIMAL(12,4)) AS pobreza_pct,
          CAST(CAST((k * 7) % 300 AS DOUBLE) / 10 AS DECIMAL(12,4)) AS pobreza_extrema_pct,
          CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(CAST((k * 53) % 600 AS DOUBLE) / 10 AS DECIMAL(12,4)) END
            AS carencia_acceso_salud_pct
        FROM {{units}} u""",
    "lag": """
        SELECT cve_mun, CASE (k * 7) % 6 WHEN 0 THEN 'Muy bajo' WHEN 1 THEN 'Bajo' WHEN 2 THEN 'Medio' WHEN 3 THEN 'Alto'
            WHEN 4 THEN 'Muy alto' ELSE NULL END AS irs_grado,
          CAST(CAST((k * 61) % 4000 - 2000 AS DOUBLE) / 1000 AS DECIMAL(12,4)) AS irs_indice
        FROM {units} u WHERE k % 31 <> 5""",
    "crime_long": f"""
        SELECT CASE WHEN o.o_orderkey % 29 = 0 THEN {ENT} || '999' WHEN o.o_orderkey % 31 = 0 THEN substr({MUN}, 2, 4)
            WHEN o.o_orderkey % 37 = 0 THEN NULL ELSE {MUN} END AS cve_mun,
          year(o.o_orderdate) AS ano, month(o.o_orderdate) AS mes,
          CASE o.o_orderstatus WHEN 'F' THEN 'El patrimonio' WHEN 'O' THEN 'La vida y la Integridad corporal'
            ELSE 'Otros' END AS bien_juridico,
          CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Robo a negocio' WHEN '2-HIGH' THEN 'Homicidio doloso'
            WHEN '3-MEDIUM' THEN 'Extorsión' ELSE 'Otro' END AS subtipo_delito,
          1 + o.o_orderkey % 3 AS count
        FROM {ORDERS} o JOIN {{supplier}} s ON s.s_suppkey = o.seller""",
    "crime_wide": f"""
        SELECT CAST(ano AS STRING) AS ano,
          CASE WHEN substr(cve_mun, 1, 1) = '0' THEN substr(cve_mun, 2, 4) ELSE cve_mun END AS cve_municipio,
          bien_juridico, subtipo_delito,
          {", ".join(f"coalesce(CAST(sum(CASE WHEN mes = {i} THEN count END) AS STRING), '') AS {m}" for i, m in enumerate(MONTHS, 1))}
        FROM {{crime_long}} t
        GROUP BY ano, cve_mun, bien_juridico, subtipo_delito""",
    "deaths": f"""
        SELECT {_pad("l_suppkey % 36", 2)} AS ent_resid,
          CASE WHEN l_partkey % 41 = 0 THEN '999' WHEN l_partkey % 43 = 0 THEN NULL ELSE {_pad("l_partkey % 90 + 1", 3)} END
            AS mun_resid,
          CASE WHEN l_partkey % 47 = 0 THEN '' WHEN l_partkey % 53 = 0 THEN 'n.e.' ELSE CAST(year(l_shipdate) AS STRING) END
            AS anio_ocur,
          CAST(1000 * (1 + l_orderkey % 4) + CAST(l_quantity AS BIGINT) AS STRING) AS edad,
          CASE WHEN l_orderkey % 59 = 0 THEN '' ELSE CAST(l_orderkey % 22 AS STRING) END AS capitulo
        FROM {{lineitem}} l""",
    "income_raw": f"""
        SELECT {_pad("l_suppkey % 34", 2)} || {_pad("l_partkey % 500", 3)} AS ubica_geo,
          CASE WHEN l_orderkey % 23 = 0 THEN '0' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS factor,
          CAST(1 + l_orderkey % 7 AS STRING) AS tot_integ,
          CASE WHEN l_orderkey % 67 = 0 THEN '' ELSE CAST(CAST(l_extendedprice AS DECIMAL(20,2)) AS STRING) END AS ing_cor,
          CASE WHEN l_orderkey % 11 = 0 THEN '' ELSE CAST(2000 + l_orderkey % 9000 AS STRING) END AS gasto_mon,
          CAST(l_orderkey % 900 AS STRING) AS alimentos, CAST(l_partkey % 700 AS STRING) AS vivienda,
          CASE WHEN l_partkey % 9 = 0 THEN '' ELSE CAST(l_partkey % 300 AS STRING) END AS salud,
          CAST((l_orderkey + l_partkey) % 500 AS STRING) AS transporte, CAST(l_suppkey % 200 AS STRING) AS educacion
        FROM {{lineitem}} l""",
    "labour_raw": """
        SELECT CASE WHEN l_orderkey % 2 = 0 THEN ' ' ELSE '' END || CAST(l_suppkey % 35 AS STRING) AS ent,
          CASE WHEN l_orderkey % 71 = 0 THEN ' ' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS fac_tri,
          CASE WHEN l_orderkey % 73 = 0 THEN ' ' ELSE CAST(l_partkey % 90 AS STRING) END AS eda,
          CASE WHEN l_partkey % 90 < 15 THEN '0' WHEN l_orderkey % 5 < 3 THEN '1' ELSE '2' END AS clase1,
          CASE WHEN l_partkey % 90 < 15 THEN '0' WHEN l_orderkey % 5 < 3 THEN
            CASE WHEN l_orderkey % 15 = 1 THEN '2' ELSE '1' END ELSE '4' END AS clase2,
          CASE WHEN l_partkey % 90 < 15 OR l_orderkey % 5 >= 3 THEN '0' WHEN l_orderkey % 15 = 1 THEN '0'
            WHEN l_linenumber % 2 = 0 THEN '1' ELSE '2' END AS emp_ppal,
          CASE WHEN l_orderkey % 7 = 0 THEN ' ' ELSE CAST(l_orderkey % 20000 AS STRING) END AS ingocup,
          quarter(l_shipdate) AS trimestre
        FROM {lineitem} l""",
    "finance_raw": f"""
        SELECT CAST(year(o.o_orderdate) AS STRING) AS ano, CAST(month(o.o_orderdate) AS STRING) AS mes,
          CASE WHEN o.o_orderkey % 53 = 0 THEN '99' WHEN o.o_orderkey % 59 = 0 THEN '' ELSE {ENT} END AS cve_ent,
          CASE WHEN o.o_orderkey % 17 = 0 THEN '' ELSE CAST(s.s_suppkey % 1000 AS STRING) END AS cve_mun,
          CAST(1 + o.o_custkey % 28 AS STRING) AS organismo, CAST(1 + o.o_orderkey % 4 AS STRING) AS modalidad,
          CASE WHEN o.o_orderkey % 5 = 0 THEN '' ELSE CAST(1 + o.o_orderkey % 2 AS STRING) END AS tipo,
          CASE WHEN o.o_orderkey % 6 = 0 OR s.s_suppkey % 12 = 1 THEN '' ELSE CAST(1 + o.o_custkey % 2 AS STRING) END AS sexo,
          CASE WHEN o.o_orderkey % 7 = 0 OR s.s_suppkey % 10 = 3 THEN '' ELSE CAST(1 + o.o_custkey % 6 AS STRING) END
            AS vivienda_valor,
          CAST(1 + o.o_orderkey % 3 AS STRING) AS poblacion_indigena,
          CASE WHEN o.o_orderkey % 8 = 0 THEN '' ELSE CAST(o.o_custkey % 9 AS STRING) END AS linea_credito,
          CASE WHEN o.o_orderkey % 9 = 0 THEN '' ELSE CAST(o.o_custkey % 5 AS STRING) END AS esquema,
          CASE o.o_custkey % 5 WHEN 0 THEN '040002' WHEN 1 THEN '040012' WHEN 2 THEN '040014' WHEN 3 THEN '040021'
            ELSE '049999' END AS intermediario_financiero,
          CAST(o.o_orderkey % 3 AS STRING) AS acciones,
          CAST(CAST(o.o_totalprice AS DECIMAL(20,2)) AS STRING) AS monto
        FROM {ORDERS} o JOIN {{supplier}} s ON s.s_suppkey = o.seller""",
    "stations_raw": """
        SELECT x.*, 'Estado ' || entidad AS estado FROM (
          SELECT entidad, CASE WHEN longitud IS NULL THEN '' ELSE CAST(longitud AS STRING) END AS longitud,
            CAST(latitud AS STRING) AS latitud, CASE WHEN num % 15 = 0 THEN 'sin dato' ELSE CAST(num % 300 AS STRING) END
              AS clave,
            CASE WHEN num % 14 = 0 THEN NULL ELSE 'MEX-' || CAST(num % 12 AS STRING) END AS ruta,
            'P' || CAST(num AS STRING) AS punto_generador, CAST(num % 100 AS STRING) AS km, '1' AS te, '0' AS sc,
            CASE WHEN num % 33 = 0 THEN '' ELSE CAST(100 + (num * 37) % 9000 AS STRING) END AS tdpa,
            CAST(num % 5 AS STRING) AS m, CASE WHEN num % 21 = 0 THEN '*' ELSE CAST(40 + num % 30 AS STRING) END AS a,
            CAST(num % 4 AS STRING) AS b, CAST(num % 6 AS STRING) AS c2, CAST(num % 3 AS STRING) AS c3, '2' AS t3s2,
            '1' AS t3s3, CAST(num % 2 AS STRING) AS t3s2r4, CAST(num % 7 AS STRING) AS otros
          FROM {shops} a
        ) x
        UNION ALL
        SELECT x.*, 'Estado ' || substr(entidad, 2, 1) AS estado FROM (
          SELECT entidad, CASE WHEN longitud IS NULL THEN '' ELSE CAST(longitud AS STRING) END AS longitud,
            CAST(latitud AS STRING) AS latitud, CASE WHEN num % 15 = 0 THEN 'sin dato' ELSE CAST(num % 300 AS STRING) END
              AS clave,
            CASE WHEN num % 14 = 0 THEN NULL ELSE 'MEX-' || CAST(num % 12 AS STRING) END AS ruta,
            'P' || CAST(num AS STRING) AS punto_generador, CAST(num % 100 AS STRING) AS km, '1' AS te, '0' AS sc,
            CASE WHEN num % 33 = 0 THEN '' ELSE CAST(100 + (num * 37) % 9000 AS STRING) END AS tdpa,
            CAST(num % 5 AS STRING) AS m, CASE WHEN num % 21 = 0 THEN '*' ELSE CAST(40 + num % 30 AS STRING) END AS a,
            CAST(num % 4 AS STRING) AS b, CAST(num % 6 AS STRING) AS c2, CAST(num % 3 AS STRING) AS c3, '2' AS t3s2,
            '1' AS t3s3, CAST(num % 2 AS STRING) AS t3s2r4, CAST(num % 7 AS STRING) AS otros
          FROM {shops} a WHERE segment = 'MACHINERY'
        ) x""",
    "boxes": f"""
        SELECT cve_mun, k, {_milli("gx * 100 - 100000")} AS x0, {_milli("gx * 100 - 99950")} AS xm,
          {_milli("gx * 100 - 99900")} AS x1, {_milli("gy * 100 + 18000")} AS y0, {_milli("gy * 100 + 18050")} AS ym,
          {_milli("gy * 100 + 18100")} AS y1, k % 5 = 0 AS notched
        FROM (SELECT cve_mun, k, k % 40 AS gx, CAST(floor(k / 40) AS BIGINT) AS gy FROM {{units}} u) t""",
    "tract_boxes": """
        SELECT cve_mun, cve_mun || '00010001' AS cvegeo, k, 0 AS q, ' Urbana' AS ambito, x0, y0, xm AS x1, ym AS y1 FROM {boxes} a
        UNION ALL
        SELECT cve_mun, cve_mun || '00010002' AS cvegeo, k, 1 AS q, 'Urbana' AS ambito, xm AS x0, y0, x1, ym AS y1 FROM {boxes} b
        UNION ALL
        SELECT cve_mun, cve_mun || '00010003' AS cvegeo, k, 2 AS q, ' ' AS ambito, x0, ym AS y0, xm AS x1, y1 FROM {boxes} c
        UNION ALL
        SELECT cve_mun, cve_mun || '00010004' AS cvegeo, k, 3 AS q, 'Rural' AS ambito, xm AS x0, ym AS y0, x1, y1 FROM {boxes} d""",
    "tract_census": """
        SELECT cvegeo, substr(cvegeo, 10, 4) AS ageb,
          CASE WHEN (k + q) % 9 = 0 THEN NULL WHEN (k + q) % 11 = 0 THEN 0 ELSE 200 + (k * 7919 + q * 131) % 5000 END AS pobtot,
          CASE WHEN (k + q) % 7 = 0 THEN NULL ELSE (k * 17 + q * 29) % 200 END AS psinder,
          (k * 5 + q) % 180 AS p_60ymas, (k * 3 + q) % 90 AS pcon_disc, (k * 13 + q) % 150 AS vph_autom,
          (k * 19 + q) % 150 AS vph_inter, (k * 23 + q) % 190 AS pocupada, 150 + (k + q) % 50 AS tvivparhab,
          CAST(CAST((k * 37 + q) % 180 AS DOUBLE) / 10 AS DECIMAL(9,2)) AS graproes
        FROM {tract_boxes} t""",
    "tract_lag": """
        SELECT cvegeo, CASE (k * 7 + q) % 5 WHEN 0 THEN 'Muy bajo' WHEN 1 THEN 'Bajo' WHEN 2 THEN 'Medio' WHEN 3 THEN 'Alto'
            ELSE 'Muy alto' END AS grado
        FROM {tract_boxes} t WHERE (k + q) % 6 <> 2""",
    "morbidity_raw": f"""
        SELECT CASE WHEN o.o_orderkey % 61 = 0 THEN 'XX' ELSE {ENT} END AS clave_entidad,
          {_pad("s.s_suppkey % 1000", 3)} AS clave_municipio, 'U' || CAST(o.o_custkey % 40 AS STRING) AS clues,
          CASE WHEN o.o_orderkey % 67 = 0 THEN 'NULL' ELSE CAST(year(o.o_orderdate) AS STRING) END AS anio,
          CASE WHEN o.o_orderkey % 5 = 0 THEN 'NULL' ELSE CAST(o.o_orderkey % 9 AS STRING) END AS adm02,
          CAST(o.o_custkey % 4 AS STRING) AS adm03, CAST(o.o_orderkey % 6 AS STRING) AS aha02,
          CASE WHEN o.o_orderkey % 4 = 0 THEN 'NULL' ELSE CAST(o.o_custkey % 8 AS STRING) END AS aob02,
          '7' AS aob_extra
        FROM {ORDERS} o JOIN {{supplier}} s ON s.s_suppkey = o.seller""",
    "morbidity": """
        SELECT cve_mun, 2020 + k % 3 AS anio, CAST(CAST((k * 11) % 900 AS DOUBLE) / 10 AS DECIMAL(12,1)) AS casos_dm2_promedio,
          CAST(CAST((k * 13) % 800 AS DOUBLE) / 10 AS DECIMAL(12,1)) AS casos_hta_promedio,
          CAST(CAST((k * 17) % 700 AS DOUBLE) / 10 AS DECIMAL(12,1)) AS casos_obesidad_promedio
        FROM {units} a
        UNION ALL
        SELECT cve_mun, 2019 AS anio, CAST(1 AS DECIMAL(12,1)) AS casos_dm2_promedio, CAST(2 AS DECIMAL(12,1)) AS casos_hta_promedio,
          CAST(3 AS DECIMAL(12,1)) AS casos_obesidad_promedio
        FROM {units} b WHERE k % 4 <> 1""",
    "welfare_raw": """
        SELECT CASE WHEN o_orderkey % 83 = 0 THEN '99' WHEN o_orderkey % 89 = 0 THEN 'cveent' ELSE
            CAST(1 + o_custkey % 25 AS STRING) END AS cveent,
          'Estado ' || CAST(1 + o_custkey % 25 AS STRING) AS entidad_etq,
          CASE WHEN o_orderkey % 7 = 0 THEN 'N/D' ELSE CAST(o_orderkey * 10 AS STRING) END AS beneficiarios,
          CASE WHEN o_orderkey % 9 = 0 THEN 'n.d' ELSE CAST(o_custkey AS STRING) END AS intervenciones,
          CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE CAST(o_orderkey % 30 AS STRING) END AS dependencias,
          CAST(o_orderkey % 50 AS STRING) AS padrones, CAST(o_custkey % 60 AS STRING) AS programas,
          CAST(o_orderkey AS STRING) AS periodo_cve, CAST(year(o_orderdate) AS STRING) AS anio,
          'T' || CAST(quarter(o_orderdate) AS STRING) AS trimestre,
          CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS fecha
        FROM {orders} o""",
    "licences": f"""
        SELECT c.c_custkey AS num,
          CASE c.c_custkey % 5 WHEN 0 THEN 'Farmacia Hospitalaria' WHEN 1 THEN 'BOTICA' WHEN 2 THEN 'Droguería'
            WHEN 3 THEN 'Drogueria' ELSE 'Farmacia' END AS giro,
          CASE WHEN c.c_custkey % 8 = 0 THEN 'Cancelada' ELSE 'Vigente' END AS estatus_licencia,
          CASE WHEN c.c_custkey % 12 = 0 THEN NULL WHEN c.c_custkey % 9 = 0 THEN 'Revacunar; psicotrópicos'
            ELSE CASE WHEN c.c_custkey % 2 = 0 THEN 'Estupefacientes, ' ELSE '' END
              || CASE WHEN c.c_custkey % 3 = 0 THEN 'PSICOTRÓPICOS/' ELSE '' END
              || CASE WHEN c.c_custkey % 4 = 1 THEN 'vacunas-toxoides' ELSE '' END
              || CASE WHEN c.c_custkey % 5 = 2 THEN ' sueros' WHEN c.c_custkey % 5 = 3 THEN ' Antitoxina' ELSE '' END
              || CASE WHEN c.c_custkey % 7 = 3 THEN ' (hemoderivados)' ELSE '' END END AS lineas_autorizadas,
          CASE WHEN c.c_custkey % 10 = 0 THEN NULL WHEN c.c_custkey % 23 = 0 THEN 'x' ELSE {MUN} END AS cve_mun,
          CASE WHEN c.c_custkey % 10 = 0 THEN NULL WHEN c.c_custkey % 15 = 1 THEN substr({MUN}, 1, 5) || '001A'
            ELSE {MUN} || '0001' || {_pad("1 + c.c_custkey % 4", 4)} END AS cvegeo_ageb
        FROM {CUSTOMERS} c JOIN {{supplier}} s ON s.s_suppkey = c.seller""",
    "census_raw": f"""
        SELECT CASE WHEN c_custkey % 200 = 0 THEN '00' ELSE {_pad("c_nationkey + 1", 2)} END AS entidad,
          CASE WHEN c_custkey % 25 = 0 THEN '000' ELSE {_pad("1 + c_custkey % 50", 3)} END AS mun,
          CASE WHEN c_custkey % 25 = 0 OR c_custkey % 7 = 0 THEN '0000' ELSE {_pad("1 + c_custkey % 9000", 4)} END AS loc,
          'Loc ' || CAST(c_custkey AS STRING) AS nom_loc, 'Mun' AS nom_mun, 'Ent' AS nom_ent,
          CASE WHEN c_custkey % 6 = 0 THEN '' ELSE CAST(1 + c_custkey % 14 AS STRING) END AS tamloc,
          CASE WHEN c_custkey % 8 = 0 THEN '00-3' ELSE CAST(c_custkey % 2500 AS STRING) END AS altitud,
          CAST(c_custkey * 3 AS STRING) AS pobtot,
          CASE WHEN c_custkey % 5 = 0 THEN 'N/D' WHEN c_custkey % 11 = 0 THEN '' ELSE CAST(c_custkey AS STRING) END AS pea,
          CASE WHEN c_custkey % 5 = 0 THEN 'N/D' ELSE CAST(CAST(CAST(c_custkey % 150 AS DOUBLE) / 10 AS DECIMAL(9,2)) AS STRING) END
            AS graproes,
          CAST(c_custkey % 900 AS STRING) AS tvivpar,
          CASE WHEN c_custkey % 9 = 0 THEN 'N/D' ELSE CAST(c_custkey % 700 AS STRING) END AS vph_inter,
          CAST(c_custkey % 77 AS STRING) AS pcatolica, CAST(c_custkey % 33 AS STRING) AS psinder,
          CAST(c_custkey % 21 AS STRING) AS pnacent, CAST(c_custkey % 13 AS STRING) AS pcon_disc
        FROM {{customer}} c""",
    "tract_raw": f"""
        SELECT {_pad("c_nationkey + 1", 2)} AS entidad,
          CASE WHEN c_custkey % 30 = 0 THEN '000' ELSE {_pad("1 + c_custkey % 50", 3)} END AS mun,
          CASE WHEN c_custkey % 15 = 0 THEN '0000' ELSE '0001' END AS loc, 'Loc' AS nom_loc,
          CASE WHEN c_custkey % 10 = 0 THEN '0000' ELSE {_pad("c_custkey % 90", 3)} || 'A' END AS ageb,
          CASE WHEN c_custkey % 3 = 0 THEN '000' WHEN c_custkey % 16 = 0 THEN '*' ELSE {_pad("1 + c_custkey % 60", 3)} END AS mza,
          CASE WHEN c_custkey % 7 = 0 THEN '*' ELSE CAST(c_custkey * 2 AS STRING) END AS pobtot,
          CASE WHEN c_custkey % 6 = 0 THEN '*' ELSE CAST(c_custkey AS STRING) END AS pobfem,
          CAST(c_custkey % 400 AS STRING) AS pobmas, CAST(c_custkey % 95 AS STRING) AS tvivpar,
          CAST(c_custkey % 81 AS STRING) AS vph_inter, CAST(c_custkey % 64 AS STRING) AS vph_autom,
          CASE WHEN c_custkey % 4 = 0 THEN '*' ELSE CAST(c_custkey % 55 AS STRING) END AS psinder
        FROM {{customer}} c""",
    "poverty_raw": """
        SELECT CASE WHEN substr(cve_mun, 1, 1) = '0' THEN substr(cve_mun, 2, 4) ELSE cve_mun END AS clave_municipio,
          CASE WHEN k % 19 = 0 THEN '' ELSE CAST(1 + k % 90 AS STRING) || ',' || lpad(CAST((k * 79) % 1000 AS STRING), 3, '0') END
            AS poblacion,
          CASE WHEN k % 7 = 0 THEN 'n.d' ELSE CAST((k * 31) % 100 AS STRING) || '.5' END AS pobreza,
          CASE WHEN k % 7 = 0 THEN 'n.d' ELSE '1,' || lpad(CAST(k % 1000 AS STRING), 3, '0') END AS pobreza_pob,
          CAST(k % 40 AS STRING) AS pobreza_e, '12' AS pobreza_e_pob, CAST(k % 60 AS STRING) AS ic_asalud
        FROM {units} u""",
    "lag_raw": """
        SELECT cve_mun AS cve_mun_local, CAST(1000 + k AS STRING) AS pob_total, CAST(k % 30 AS STRING) || '.25' AS piso_tierra,
          CASE WHEN k % 8 = 0 THEN 'n.d' ELSE CAST(k % 5 AS STRING) || '.125' END AS irs_indice,
          CASE WHEN k % 8 = 0 THEN 'n.d' ELSE 'Medio' END AS irs_grado,
          CASE WHEN k % 8 = 0 THEN 'n.d' ELSE CAST(k AS STRING) END AS irs_lugar_nacional
        FROM {units} u""",
    "tract_lag_raw": """
        SELECT cvegeo, CASE WHEN (k + q) % 6 = 0 THEN '*' ELSE CAST(k * 10 + q AS STRING) END AS pobtot,
          CAST(k + 40 AS STRING) AS vivpar_hab, CASE WHEN k % 5 = 0 THEN '*' ELSE CAST(k % 90 AS STRING) || '.5' END AS ind_sin_salud,
          CASE (k + q) % 7 WHEN 0 THEN 'Muy bajo' WHEN 1 THEN 'Bajo' WHEN 2 THEN 'Medio' WHEN 3 THEN 'Alto' WHEN 4 THEN 'Muy alto'
            WHEN 5 THEN 'Sin grado' ELSE NULL END AS grado
        FROM {tract_boxes} t""",
    "economic_raw": """
        SELECT cve_ent AS e03, substr(cve_mun, 3, 3) AS e04, '' AS sector, '' AS clase, '' AS id_estrato,
          CAST(100 + k AS STRING) AS ue, CAST(500 + k * 3 AS STRING) AS h001a,
          CASE WHEN k % 6 = 0 THEN '' ELSE CAST(k * 7 AS STRING) || '.125' END AS a131a
        FROM {units} u
        UNION ALL
        SELECT cve_ent AS e03, '' AS e04, '' AS sector, '' AS clase, '' AS id_estrato, '9999' AS ue, '9' AS h001a, '' AS a131a
        FROM {units} v
        UNION ALL
        SELECT entidad AS e03, substr(area_geo, 3, 3) AS e04, sector_actividad_id AS sector, clase_actividad_id AS clase,
          CASE WHEN estrato = 'AF' THEN '1' WHEN estrato = 'NO' THEN '2' ELSE '' END AS id_estrato, CAST(count(*) AS STRING) AS ue,
          CAST(count(telefono) AS STRING) AS h001a, '1.5' AS a131a
        FROM {registry} r WHERE area_geo IS NOT NULL
        GROUP BY entidad, area_geo, sector_actividad_id, clase_actividad_id, estrato""",
    "inclusion_raw": """
        SELECT CASE WHEN k % 33 = 0 THEN '99999' ELSE cve_mun END AS cve_mun, CASE WHEN k % 4 = 0 THEN '*' ELSE 'Bajo' END AS rezago_social,
          CAST(1000 + k AS STRING) AS poblacion_total, CASE WHEN k % 5 = 0 THEN '*' ELSE CAST(k % 9 AS STRING) END AS sucursales_bm,
          CASE WHEN k % 3 = 0 THEN '*' ELSE CAST(k AS STRING) || '.75' END AS remesas_mdd, 'panorama' AS periodo
        FROM {units} u""",
    "inclusion_state_raw": """
        SELECT CAST(n_nationkey * 2 AS STRING) AS cve_estado_num, CAST(5000 + n_nationkey AS STRING) AS poblacion_total,
          CASE WHEN n_nationkey % 5 = 0 THEN '*' ELSE CAST(n_nationkey AS STRING) || '.5' END AS seg_vida,
          CASE WHEN n_nationkey % 4 = 0 THEN '*' ELSE 'Alto' END AS ac_inf_estado, 'panorama' AS periodo
        FROM {nation} n""",
    "airport_crosswalk": f"""
        SELECT n_name || ' ' AS airport_name, {_pad("n_nationkey + 1", 2)} || '00' || CAST(n_nationkey % 3 AS STRING) AS cve_mun
        FROM {{nation}} n WHERE n_nationkey % 8 <> 7""",
    "movements": """
        SELECT CASE WHEN o.o_orderkey % 3 = 0 THEN ' ' || lower(n.n_name) ELSE n.n_name END AS airport_name,
          year(o.o_orderdate) AS ano, 1 + o.o_orderkey % 5 AS mar_flights, o.o_orderstatus AS operator
        FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey""",
    "geo_registry": f"""
        SELECT {_pad("1 + p_partkey % 5", 2)} AS state, {_pad("p_partkey % 30", 5)} AS postcode,
          CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 6 = 0 THEN upper(p_name)
            ELSE p_name || ', ' || lower(p_type) || CASE WHEN p_partkey % 4 = 0 THEN ' ñorte' ELSE '' END END AS colonia,
          {_pad("1 + p_partkey % 5", 2)} || {_pad("p_partkey % 7", 3)} AS mun,
          {_pad("1 + p_partkey % 5", 2)} || {_pad("p_partkey % 7", 3)} || '0001' || {_pad("p_partkey % 11", 4)} AS tract
        FROM {{part}} p""",
    "geo_targets": f"""
        SELECT c.c_custkey AS num, {_pad("1 + c.c_custkey % 6", 2)} AS state,
          CASE WHEN c.c_custkey % 19 = 0 THEN '' ELSE {_pad("c.c_custkey % 32", 5)} END AS postcode,
          CASE WHEN c.c_custkey % 13 = 0 THEN NULL WHEN c.c_custkey % 4 = 0 THEN p.p_name || ' Norte'
            WHEN c.c_custkey % 4 = 1 THEN p.p_name || ' ' || p.p_type || ' sección ' || CAST(c.c_custkey % 3 AS STRING)
            WHEN c.c_custkey % 4 = 2 THEN substr(p.p_name, 1, 3) ELSE p.p_name END AS colonia
        FROM {_paired("customer", "c_custkey", "part", "product")} c LEFT JOIN {{part}} p ON p.p_partkey = c.product""",
    "registry_export": """
        SELECT CASE WHEN c_custkey % 50 = 0 THEN '2' ELSE lpad(CAST(c_nationkey + 1 AS STRING), 2, '0')
            || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0')
            || CASE WHEN c_custkey % 20 = 0 THEN '46X' ELSE '464111' END || lpad(CAST(c_custkey AS STRING), 12, '0') END AS CLEE,
          CAST(c_custkey AS STRING) AS Id, CASE WHEN c_custkey % 9 = 0 THEN ' NULL ' ELSE '  ' || c_name || ' ' END AS Nombre,
          CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_mktsegment END AS Razon_social,
          CASE WHEN c_custkey % 4 = 0 THEN ' , Estado' WHEN c_custkey % 5 = 0 THEN NULL ELSE ' Pueblo ' || CAST(c_custkey % 7 AS STRING)
            || ', Estado' END AS Ubicacion,
          CASE WHEN c_custkey % 8 = 0 THEN '7224' ELSE '' END AS RAMA_ACTIVIDAD_ID,
          CASE WHEN c_custkey % 7 = 0 THEN 'n/a' WHEN c_custkey % 11 = 0 THEN '19.5 N' ELSE CAST(18 + c_custkey % 9 AS STRING) || '.25' END
            AS Latitud,
          '-99.' || CAST(c_custkey % 90 AS STRING) AS Longitud,
          CASE c_custkey % 4 WHEN 0 THEN '05/11/2019' WHEN 1 THEN '2020-02-29T00:00' WHEN 2 THEN '31/02/2020' ELSE '2019' END
            AS Fecha_Alta,
          CASE WHEN c_custkey % 10 = 0 THEN '09001' ELSE ' ' END AS AreaGeo
        FROM {customer} c""",
    "survey_points": """
        SELECT e.user_id % 25 AS g, CAST(round(e.value * 100) AS BIGINT) AS v, 1 + e.event_id % 5 AS w, e.event_id AS id
        FROM {events} e""",
}

_REF = re.compile(r"\{([a-z]\w*)\}")
_COUNT = re.compile(r"<(\d+(?:,\d+)?)>")  # a repeat count of a pattern, written <n> beside {role} names


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(_REF.findall(sql)))


def table(spark: SparkSession, sf: str, name: str, made: dict[str, DataFrame]) -> DataFrame:
    """A driver table, or a role derived from driver tables; ``made`` keeps what was already planned."""
    if name not in made:
        if name in DRIVER_TABLES:
            made[name] = spark.read.parquet(f"{sf}/{name}.parquet")
        else:
            sql = ROLES[name]
            made[name] = spark.sql(sql, **{n: table(spark, sf, n, made) for n in _needs(sql)})
    return made[name]


def with_roles(body: str) -> str:
    """The body's ``{role}`` names resolved as common table expressions for DuckDB."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in DRIVER_TABLES or name in order:
            return
        for n in _needs(ROLES[name]):
            visit(n)
        order.append(name)

    for n in _needs(body):
        visit(n)
    ctes = [f"{n} AS ({_REF.sub(lambda m: m.group(1), ROLES[n])})" for n in order]
    text = _REF.sub(lambda m: m.group(1), body).strip()
    text = _COUNT.sub(lambda m: "{" + m.group(1) + "}", text)
    if not ctes:
        return text
    if text[:5].upper() == "WITH ":
        return f"WITH {', '.join(ctes)}, {text[5:]}"
    return f"WITH {', '.join(ctes)} {text}"


def rings(boxes: DataFrame, notched: bool = False) -> DataFrame:
    """Boxes as closed rings; notched boxes lose their upper right quarter."""

    def ring(*points: tuple[str, str]):
        return F.array(*[F.struct(F.col(x).alias("lon"), F.col(y).alias("lat")) for x, y in points])

    square = ring(("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))
    if notched:
        corner = ring(
            ("x0", "y0"), ("x1", "y0"), ("x1", "ym"), ("xm", "ym"), ("xm", "y1"), ("x0", "y1"), ("x0", "y0")
        )
        square = F.when(F.col("notched"), corner).otherwise(square)
    return boxes.withColumn("ring", square)


#: Cell size near the size of the driver-table areas, in degrees.
CELL = 0.1
