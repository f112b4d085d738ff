"""Cleaning, keys, reshaping, set rules and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from demarca.functions import keys, measures, text
from demarca.operators import aggregate, filters, ordered, reshape
from demarca.sources import pages as ranked_pages
from demarca.sources import running as stored_running
from demarca.sources.delimited import rename_columns, select_positions, undecodable_rows, union_tagged
from demarca.sources.registry import normalize_registry
from demarca.sources.sinks import upsert
from workbench.kit import big, query, ratio
from workbench.scratch import scratch_folder

STRIPPED = "trim({c}, ' ' || chr(9) || chr(10) || chr(13))"


def _clean(c: str) -> str:
    t = STRIPPED.format(c=c)
    return f"CASE WHEN {t} = '' OR lower({t}) = 'null' THEN NULL ELSE {t} END"


@query(
    "registry_normalised",
    f"""SELECT CLEE AS clee, {_clean("Id")} AS registro_id, CAST(NULL AS VARCHAR) AS telefono, CAST(NULL AS VARCHAR) AS ageb,
      CASE WHEN regexp_full_match(substr(CLEE, 6, 3), '[0-9]<3>') THEN substr(CLEE, 6, 3) END AS subsector_actividad_id,
      CASE WHEN regexp_full_match(substr(CLEE, 6, 5), '[0-9]<5>') THEN substr(CLEE, 6, 5) END AS subrama_actividad_id,
      {_clean("Ubicacion")} AS ubicacion, {_clean("Nombre")} AS nombre, {_clean("Razon_social")} AS razon_social,
      CASE WHEN trim(split_part({_clean("Ubicacion")}, ',', 1)) = '' THEN NULL ELSE trim(split_part({_clean("Ubicacion")}, ',', 1)) END
        AS municipio,
      CASE WHEN length(CLEE) >= 2 THEN substr(CLEE, 1, 2) END AS entidad,
      CASE WHEN regexp_full_match(substr(CLEE, 6, 6), '[0-9]<6>') THEN substr(CLEE, 6, 6) END AS clase_actividad_id,
      CASE WHEN regexp_full_match(substr(CLEE, 6, 2), '[0-9]<2>') THEN substr(CLEE, 6, 2) END AS sector_actividad_id,
      coalesce({_clean("RAMA_ACTIVIDAD_ID")}, CASE WHEN regexp_full_match(substr(CLEE, 6, 4), '[0-9]<4>') THEN substr(CLEE, 6, 4) END)
        AS rama_actividad_id,
      coalesce({_clean("AreaGeo")}, CASE WHEN regexp_full_match(substr(CLEE, 1, 5), '[0-9]<5>') THEN substr(CLEE, 1, 5) END) AS area_geo,
      TRY_CAST(nullif(regexp_extract(Latitud, '^[-0-9.]+'), '') AS DOUBLE) AS latitud, CAST(Longitud AS DOUBLE) AS longitud,
      CASE Fecha_Alta WHEN '05/11/2019' THEN '2019-11-05' WHEN '2020-02-29T00:00' THEN '2020-02-29' END AS fecha_alta
    FROM {{registry_export}}""",
)
def registry_normalised(t):
    export = t.registry_export
    absent = [c for c in _export_fields() if c not in export.columns]
    rows = normalize_registry(export.withColumns({c: F.lit(None).cast("string") for c in absent}))
    return rows.select(
        "clee", "nombre", "razon_social", "municipio", "entidad", "clase_actividad_id", "sector_actividad_id",
        "rama_actividad_id", "area_geo", "latitud", "longitud", "fecha_alta", "registro_id", "telefono", "ageb",
        "subsector_actividad_id", "subrama_actividad_id", "ubicacion",
    )


def _export_fields() -> list[str]:
    from demarca.sources.contracts import REGISTRY

    return REGISTRY


@query(
    "missing_tokens_and_guards",
    f"""SELECT nom_loc, TRY_CAST(nullif(nullif(pea, ''), 'N/D') AS BIGINT) AS pea,
      CASE WHEN regexp_full_match(altitud, '-?[0-9]+([.][0-9]+)?') THEN CAST(altitud AS DOUBLE) END AS altitud_m,
      TRY_CAST(nullif(tamloc, '') AS BIGINT) AS tamloc FROM {{census_raw}}""",
)
def missing_tokens(t):
    return t.census_raw.select(
        "nom_loc",
        text.typed(F.col("pea"), ["", "N/D"], "long").alias("pea"),
        text.guarded_number(F.col("altitud")).alias("altitud_m"),
        text.typed(F.col("tamloc"), [""], "long").alias("tamloc"),
    )


@query(
    "folded_text_flags",
    """SELECT source, count(*) AS docs, count(*) FILTER (WHERE regexp_matches(f, '\\b(LICENSE|LICENCE|COPYRIGHT)\\b')) AS licence,
      count(*) FILTER (WHERE regexp_matches(f, '\\b(THE|AND)\\b')) AS english,
      count(*) FILTER (WHERE regexp_matches(f, '\\b(QUE|LAS?)\\b')) AS romance,
      CAST(sum(length(f)) AS BIGINT) AS folded_chars
    FROM (SELECT source, trim(regexp_replace(regexp_replace(upper(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')),
      '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS f FROM {documents}) GROUP BY 1""",
)
def folded_flags(t):
    flags = text.class_flags(
        F.col("text"), {"licence": "LICENSE|LICENCE|COPYRIGHT", "english": "THE|AND", "romance": "QUE|LAS?"}
    )
    rows = t.documents.select("source", F.length(text.fold_text(F.col("text"))).alias("n"), *[
        c.alias(n) for n, c in flags.items()
    ])
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"),
        *[F.count_if(F.col(n)).alias(n) for n in flags],
        F.sum("n").alias("folded_chars"),
    )


@query(
    "key_assembly",
    """SELECT c_custkey, lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS cve_mun,
      CASE WHEN c_custkey < 1000 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0') END AS guarded,
      substr(c_name, 10, 4) AS piece, CASE WHEN c_custkey % 1000 IN (998, 999) THEN true ELSE false END AS catch_all
    FROM {customer}""",
)
def key_assembly(t):
    key = keys.make_key(((F.col("c_nationkey") + 1).cast("string"), 2), ((F.col("c_custkey") % 1000).cast("string"), 3))
    return t.customer.select(
        "c_custkey",
        key.alias("cve_mun"),
        keys.pad(F.col("c_custkey").cast("string"), 3).alias("guarded"),
        keys.derive_code(F.col("c_name"), 10, 4).alias("piece"),
        keys.is_catch_all(key).alias("catch_all"),
    )


@query(
    "valid_territory_by_state",
    """SELECT trim(cve_ent) AS cve_ent, count(*) AS n FROM {finance_raw} WHERE regexp_full_match(trim(cve_ent), '0[1-9]|[12][0-9]|3[0-2]')
      AND regexp_full_match(trim(cve_mun), '[0-9]<1,3>') GROUP BY 1""",
)
def valid_territory(t):
    return aggregate.count_by(filters.valid_territory(t.finance_raw, "cve_ent", "cve_mun"), ["cve_ent"], "n")


@query(
    "catch_all_dropped",
    "SELECT cve_mun, CAST(sum(count) AS BIGINT) AS n FROM {crime_long} WHERE cve_mun NOT LIKE '%998' AND cve_mun NOT LIKE '%999' GROUP BY 1",
)
def catch_all(t):
    return filters.drop_catch_all(t.crime_long, "cve_mun").groupBy("cve_mun").agg(F.sum("count").alias("n"))


@query(
    "pinned_rows",
    "SELECT entidad, count(*) AS n FROM {registry} WHERE entidad IN ('03', '08', '21') GROUP BY 1",
)
def pinned(t):
    return aggregate.count_by(t.registry.filter(filters.pin_filter(F.col("entidad"), ["03", "08", 21])), ["entidad"], "n")


@query(
    "months_to_rows",
    """SELECT lpad(CASE WHEN k LIKE '0%' THEN substr(k, 2, 4) ELSE k END, 5, '0') AS cve_mun, ano, mes, bien_juridico, subtipo_delito, count
    FROM (SELECT cve_mun AS k, ano, mes, bien_juridico, subtipo_delito, CAST(sum(count) AS BIGINT) AS count FROM {crime_long} GROUP BY ALL)""",
)
def months(t):
    from demarca.plans.incidence import crime_long

    return crime_long(t.crime_wide).select("cve_mun", "ano", "mes", "bien_juridico", "subtipo_delito", "count")


@query(
    "latest_per_key",
    """SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey AS c_custkey, *, row_number() OVER (PARTITION BY o_custkey
      ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM {orders}) WHERE rn = 1""",
)
def latest(t):
    rows = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    picked = ordered.latest_per_key(rows, ["c_custkey"], [F.desc_nulls_last("o_orderdate"), F.asc("o_orderkey")])
    return picked.select("c_custkey", "o_orderkey", "o_totalprice")


@query(
    "deduplicated_lines",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (
      PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS rn FROM {lineitem})
    WHERE rn = 1""",
)
def dedup(t):
    order = [F.asc(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")]
    picked = ordered.latest_per_key(t.lineitem, ["l_orderkey", "l_linenumber"], order)
    return picked.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query(
    "running_weight",
    """SELECT id, g, CAST(sum(w) OVER (PARTITION BY g ORDER BY v, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running,
      CAST(sum(w) OVER (PARTITION BY g) AS BIGINT) AS running_total FROM {survey_points}""",
)
def running(t):
    out = ordered.running_total(t.survey_points, ["g"], "v", ["id"], "w")
    return out.select("id", "g", "running", "running_total")


@query(
    "running_weight_stored",
    """SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (
      PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)
      AS BIGINT) AS running, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_returnflag) AS BIGINT) AS running_total FROM {lineitem}""",
)
def running_stored(t):
    """One range shuffle into stored parts instead of sampled cuts."""
    rows = t.lineitem.withColumn("q", F.col("l_quantity").cast("long"))
    order = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    out = stored_running.running_total_stored(rows, ["l_returnflag"], order, "q", f"{scratch_folder(t.spark)}/lines")
    return out.select("l_returnflag", *order, "running", "running_total")


@query(
    "weight_of_group",
    """SELECT id, g, w, CAST(sum(w) OVER (PARTITION BY g) AS BIGINT) AS group_weight FROM {survey_points}""",
)
def weight_of_group(t):
    return stored_running.with_group_total(t.survey_points.select("id", "g", "w"), ["g"], "w", "group_weight")


@query(
    "running_weight_one_group",
    """SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (
      PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)
      AS BIGINT) AS running FROM {lineitem}""",
)
def running_hot(t):
    rows = t.lineitem.withColumn("q", F.col("l_quantity").cast("long"))
    order = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    out = ordered.running_total(rows, ["l_returnflag"], order[0], order[1:], "q")
    return out.select("l_returnflag", *order, "running")


@query(
    "weighted_percentiles",
    """WITH ranked AS (SELECT g, v, sum(w) OVER (PARTITION BY g ORDER BY v, id ROWS UNBOUNDED PRECEDING) AS cumw,
      sum(w) OVER (PARTITION BY g) AS totw FROM {survey_points})
    SELECT g, min(v) FILTER (WHERE cumw * 10 >= totw) AS p10, min(v) FILTER (WHERE cumw * 2 >= totw) AS p50,
      min(v) FILTER (WHERE cumw * 10 >= totw * 9) AS p90, CAST(max(totw) AS BIGINT) AS total_weight FROM ranked GROUP BY 1""",
)
def percentiles(t):
    return ordered.weighted_percentiles(t.survey_points, ["g"], "v", "w", {"p10": "0.1", "p50": "0.5", "p90": "0.9"})


@query(
    "top_supplier_share",
    f"""SELECT nation, top_part, top_qty, {ratio("top_qty", "total", 100)} AS top_share FROM (
      SELECT nation, p AS top_part, q AS top_qty, tot AS total FROM (SELECT s_nationkey AS nation, l_partkey AS p, {big("sum(l_quantity)")} AS q,
        {big("sum(sum(l_quantity)) OVER (PARTITION BY s_nationkey)")} AS tot,
        row_number() OVER (PARTITION BY s_nationkey ORDER BY sum(l_quantity) DESC, l_partkey) AS rk
        FROM {{lineitem}} JOIN {{supplier}} ON s_suppkey = l_suppkey GROUP BY 1, 2) WHERE rk = 1)""",
)
def top_share(t):
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("nation"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("q")
    )
    top = aggregate.best_category(rows, ["nation"], "part", F.sum("q"), ("top_part", "top_qty"))
    total = rows.groupBy("nation").agg(F.sum("q").alias("total"))
    return top.join(total, "nation").select(
        "nation", "top_part", "top_qty", measures.percent(F.col("top_qty"), F.col("total")).alias("top_share")
    )


@query(
    "modal_flag_by_supplier",
    """SELECT l_suppkey, l_shipmonth AS modal_month FROM (SELECT l_suppkey, month(l_shipdate) AS l_shipmonth,
      row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, month(l_shipdate)) AS rn FROM {lineitem} GROUP BY 1, 2) WHERE rn = 1""",
)
def modal(t):
    rows = t.lineitem.select("l_suppkey", F.month("l_shipdate").alias("m"))
    return aggregate.mode_by(rows, ["l_suppkey"], "m", "modal_month")


@query(
    "top_three_parts_array",
    """SELECT l_suppkey, array_to_string(list(l_partkey ORDER BY n DESC, l_partkey), '|') AS parts FROM (SELECT l_suppkey, l_partkey,
      count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) AS rk FROM {lineitem} GROUP BY 1, 2)
    WHERE rk <= 3 GROUP BY 1""",
)
def top_array(t):
    return aggregate.top_n_array(t.lineitem, ["l_suppkey"], "l_partkey", 3, "parts")


@query(
    "ordered_ids_in_pages",
    """SELECT o_orderpriority, CAST(floor(o_orderkey / 1000) AS BIGINT) AS page, array_to_string(list(o_orderkey ORDER BY o_orderkey), '|') AS ids
    FROM {orders} GROUP BY 1, 2""",
)
def pages(t):
    return aggregate.id_pages(t.orders, ["o_orderpriority"], "o_orderkey", F.floor(F.col("o_orderkey") / 1000))


@query(
    "distinct_counts",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS lines
    FROM {lineitem} GROUP BY 1""",
)
def distinct_counts(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"),
        F.count_distinct("l_suppkey").alias("suppliers"),
        F.count(F.lit(1)).alias("lines"),
    )


@query(
    "conditional_sums",
    f"""SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS clicks,
      {big("coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type = 'purchase'), 0)")} AS purchase_cents,
      {big("sum(CAST(round(value * 100) AS BIGINT))")} AS cents FROM {{events}} GROUP BY 1""",
)
def conditional(t):
    cents = F.round(F.col("value") * 100).cast("long")
    kind = F.col("event_type")
    return aggregate.agg_where(
        t.events,
        ["user_id"],
        {
            "total": (None, None),
            "clicks": (kind == "click", None),
            "purchase_cents": (kind == "purchase", cents),
            "cents": (None, cents),
        },
    )


@query(
    "share_families",
    f"""SELECT k, {ratio("coalesce(sum(n) FILTER (WHERE st = 'F'), 0)", "sum(n)", 100)} AS pct_f,
      {ratio("coalesce(sum(n) FILTER (WHERE st = 'F'), 0)", "sum(n) FILTER (WHERE st IN ('F', 'O'))", 100)} AS pct_f_known,
      {ratio("coalesce(sum(n) FILTER (WHERE tier = 1), 0)", "sum(n) FILTER (WHERE tier IS NOT NULL)", 100)} AS pct_one,
      {ratio("coalesce(sum(n) FILTER (WHERE tier = 2), 0)", "sum(n) FILTER (WHERE tier IS NOT NULL)", 100)} AS pct_two
    FROM (SELECT o_custkey % 50 AS k, 1 + o_orderkey % 3 AS n, o_orderstatus AS st,
      CASE WHEN o_custkey % 5 = 0 OR o_orderkey % 4 = 0 THEN NULL ELSE 1 + o_orderkey % 2 END AS tier FROM {{orders}}) GROUP BY 1""",
)
def shares(t):
    rows = t.orders.select(
        (F.col("o_custkey") % 50).alias("k"),
        (1 + F.col("o_orderkey") % 3).alias("n"),
        F.col("o_orderstatus").alias("st"),
        F.when((F.col("o_custkey") % 5 != 0) & (F.col("o_orderkey") % 4 != 0), 1 + F.col("o_orderkey") % 2).alias("tier"),
    )
    n, st = F.col("n"), F.col("st")
    return rows.groupBy("k").agg(
        aggregate.share(n, st == "F").alias("pct_f"),
        aggregate.share_known(n, st == "F", st.isin("F", "O")).alias("pct_f_known"),
        *aggregate.tier_shares(n, F.col("tier"), {1: "pct_one", 2: "pct_two"}),
    )


@query(
    "latest_complete_year",
    "SELECT max(ano) AS ano FROM (SELECT ano FROM {crime_long} GROUP BY 1 HAVING count(DISTINCT mes) = 12) WHERE ano <= 2026",
)
def complete_year(t):
    from demarca.plans.incidence import latest_complete_crime_year

    return latest_complete_crime_year(t.crime_long, 2026)


@query(
    "row_sum_group_mean",
    f"""SELECT ent, {ratio("sum(a + b)", "12", 1, 1)} AS mean FROM (SELECT clave_entidad AS ent,
      coalesce(TRY_CAST(nullif(adm02, 'NULL') AS BIGINT), 0) AS a, CAST(adm03 AS BIGINT) AS b FROM {{morbidity_raw}}) GROUP BY 1""",
)
def row_sums(t):
    raw = t.morbidity_raw
    total = aggregate.row_sum(aggregate.numbered_columns(raw.columns, "adm"))
    return raw.groupBy(F.col("clave_entidad").alias("ent")).agg(
        measures.ratio(F.sum(total), F.lit(12), 1, 1).alias("mean")
    )


@query(
    "upsert_by_key",
    """WITH inc AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey, price) AS rn
      FROM (SELECT CAST(l_orderkey AS VARCHAR) AS o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS price FROM {lineitem}
        WHERE l_returnflag = 'R'))
    SELECT o_orderkey, price FROM inc WHERE rn = 1
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_totalprice FROM {orders} WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT o_orderkey FROM inc)""",
)
def upserted(t):
    existing = t.orders.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_totalprice").alias("price"))
    extra = ["l_linenumber", "l_partkey", "l_suppkey"]
    existing = existing.select("o_orderkey", *[F.lit(None).cast("long").alias(c) for c in extra], "price")
    incoming = t.lineitem.filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").cast("string").alias("o_orderkey"),
        *[F.col(c).cast("long").alias(c) for c in extra],
        F.col("l_extendedprice").alias("price"),
    )
    order = [F.desc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("price")]
    return upsert(existing, incoming, "o_orderkey", order).select("o_orderkey", "price")


@query(
    "offset_page",
    "SELECT c_custkey, c_name FROM {customer} ORDER BY c_custkey LIMIT 25 OFFSET 50",
)
def offset_page(t):
    return ordered.page(t.customer.select("c_custkey", "c_name"), [F.asc("c_custkey")], 3, 25)


@query(
    "ranked_page",
    """SELECT l_orderkey, l_linenumber, l_partkey, (SELECT count(*) FROM {lineitem}) AS total,
      (SELECT count(*) FROM {lineitem} WHERE l_orderkey < (SELECT max(l_orderkey) // 2 FROM {lineitem})) AS before_half
    FROM {lineitem} ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 40 OFFSET 4960""",
)
def ranked_page(t):
    """A page far down a table that is stored with ranks, the table's size, and the rank of a key."""
    path = f"{scratch_folder(t.spark)}/lines"
    rows = t.lineitem.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_partkey").cast("long"))
    ranked_pages.write_ranked(rows, path, ["l_orderkey", "l_linenumber", "l_partkey"], files=16)
    half = rows.agg(F.expr("max(l_orderkey) div 2")).first()[0]
    counts = ranked_pages.total(t.spark, path), ranked_pages.rank_of(t.spark, path, (half, 0, 0))
    return ranked_pages.page(t.spark, path, 125, 40).withColumns({"total": F.lit(counts[0]), "before_half": F.lit(counts[1])})


@query(
    "allowed_order_with_total",
    """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM {orders}) AS total FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 30""",
)
def ranked(t):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    orders = {
        "price": [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")],
        "key": [F.asc("o_orderkey")],
    }
    return ordered.with_total(ordered.ranked_by(rows, "price", orders, 30), rows, "total")


@query(
    "union_of_tagged_files",
    """SELECT trimestre, count(*) AS n, CAST(sum(q) AS BIGINT) AS q FROM (
      SELECT 'R' AS trimestre, CAST(l_quantity AS BIGINT) AS q FROM {lineitem} WHERE l_returnflag = 'R'
      UNION ALL SELECT 'A', CAST(l_quantity AS BIGINT) FROM {lineitem} WHERE l_returnflag = 'A'
      UNION ALL SELECT 'N', CAST(l_quantity AS BIGINT) FROM {lineitem} WHERE l_returnflag = 'N') GROUP BY 1""",
)
def tagged(t):
    lines = t.lineitem
    parts = {f: lines.filter(F.col("l_returnflag") == f).select(F.col("l_quantity").cast("long").alias("q")) for f in "RAN"}
    return union_tagged(parts, "trimestre").groupBy("trimestre").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))


@query(
    "renamed_and_positional",
    "SELECT o_orderkey AS pedido, o_custkey AS cliente, o_totalprice AS importe FROM {orders}",
)
def renamed(t):
    picked = select_positions(t.orders, {"o_orderkey": 1, "o_custkey": 2, "o_totalprice": 4})
    return rename_columns(picked, {"o_orderkey": "pedido", "o_custkey": "cliente", "o_totalprice": "importe"})


@query(
    "undecodable_rows",
    "SELECT count(*) AS rows, count(*) FILTER (WHERE contains(text, chr(65533))) AS undecodable FROM {documents}",
)
def undecodable(t):
    return undecodable_rows(t.documents, ["text"])


@query(
    "rates_and_changes",
    f"""SELECT k, {ratio("a", "b", 1000)} AS per_1k, {ratio("a", "b", 100000)} AS per_100k, {ratio("a - b", "b", 100, 1)} AS change_pct,
      {ratio("a", "b", 100)} AS pct FROM (SELECT o_custkey AS k, count(*) FILTER (WHERE o_orderstatus = 'F') AS a,
        count(*) FILTER (WHERE o_orderstatus = 'O') AS b FROM {{orders}} GROUP BY 1)""",
)
def rates(t):
    rows = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b")
    )
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "k",
        measures.per_thousand(a, b).alias("per_1k"),
        measures.per_hundred_thousand(a, b).alias("per_100k"),
        measures.change_percent(a, b).alias("change_pct"),
        measures.percent(a, b).alias("pct"),
    )


@query(
    "zero_row_for_absent_unit",
    """SELECT u.unit, count(l_suppkey) AS n, coalesce(CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT), 0) AS q
      FROM (VALUES ('9999'), ('S1'), ('S7')) u(unit) LEFT JOIN {lineitem} l ON 'S' || l_suppkey = u.unit GROUP BY 1""",
)
def zero(t):
    rows = t.lineitem.groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("unit")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q")
    )
    parts = [reshape.zero_row(rows, "unit", unit, ["n", "q"]) for unit in ("9999", "S1", "S7")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_LABELS = [("1e9", "1e9", 1, "B"), ("1e6", "1e6", 1, "M"), ("1e3", "1e3", 1, "k"), ("10", "1", 1, ""), ("1", "1", 2, ""), ("0", "1", 3, "")]
_LABEL = " ".join(f"WHEN abs(v) >= {lo} THEN printf('%.{n}f{tail}', round(v / {by}, {n}) + 0.0)" for lo, by, n, tail in _LABELS)


@query(
    "compact_labels",
    f"""SELECT o_orderkey, part, CASE WHEN v IS NULL OR isinf(v) THEN '—' {_LABEL} END AS label FROM (
      SELECT o_orderkey, 'whole' AS part, o_totalprice AS v FROM {{orders}}
      UNION ALL SELECT o_orderkey, 'small' AS part, o_totalprice / 1e6 - 0.1 AS v FROM {{orders}}
      UNION ALL SELECT o_orderkey, 'large' AS part, CASE o_orderkey % 3 WHEN 0 THEN 'Infinity'::DOUBLE WHEN 1 THEN NULL
        ELSE o_totalprice * 1e5 END AS v FROM {{orders}})""",
)
def labels(t):
    price, k = F.col("o_totalprice"), F.col("o_orderkey") % 3
    odd = F.when(k == 0, float("inf")).when(k == 2, price * 1e5)
    parts = {"whole": price, "small": price / 1e6 - 0.1, "large": odd}
    found = [
        t.orders.select("o_orderkey", F.lit(name).alias("part"), text.compact_number(v).alias("label")) for name, v in parts.items()
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])
