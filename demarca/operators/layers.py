"""Map layers and explorer measures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.functions.keys import GRAIN_WIDTH, is_catch_all
from demarca.functions.measures import ordinal
from demarca.operators.joins import assemble_layers, with_single
from demarca.operators.ordered import quantiles


@dataclass(frozen=True)
class Layer:
    """A named measure: where it lives and how its value is read."""

    grain: str
    table: str
    key: str
    value: Callable[[], Column]
    #: Column of the year to pick or average over, if the table has several.
    year: str | None = None
    #: "mean" averages complete past years, "latest" takes each key's last year, "fixed" one year.
    years: str | None = None


def _col(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


# The published map layers and the table column behind each.
LAYERS: dict[str, Layer] = {
    "pobreza_pct": Layer("muni", "poverty", "cve_mun", _col("pobreza_pct")),
    "pobreza_extrema_pct": Layer("muni", "poverty", "cve_mun", _col("pobreza_extrema_pct")),
    "carencia_acceso_salud_pct": Layer("muni", "poverty", "cve_mun", _col("carencia_acceso_salud_pct")),
    "irs_indice": Layer("muni", "lag", "cve_mun", _col("irs_indice")),
    "homicidio_doloso_year": Layer("muni", "crime_yearly", "cve_mun", _col("homicidio_doloso"), "ano", "mean"),
    "total_delitos_year": Layer("muni", "crime_yearly", "cve_mun", _col("total_delitos"), "ano", "mean"),
    "defunciones_total": Layer("muni", "mortality_yearly", "cve_mun", _col("total_defunciones"), "ano", "fixed"),
    "farmacias_licenciadas": Layer("muni", "licences_municipal", "cve_mun", _col("total_licenciadas")),
    "farmacias_endorsements_controlados": Layer(
        "muni",
        "licences_municipal",
        "cve_mun",
        lambda: F.col("con_estupefacientes")
        + F.col("con_psicotropicos")
        + F.col("con_vacunas")
        + F.col("con_hemoderivados"),
    ),
    "dm2_casos_promedio": Layer("muni", "morbidity", "cve_mun", _col("casos_dm2_promedio"), "anio", "latest"),
    "monto_credito_comercial": Layer("muni", "credit_municipal", "cve_mun", _col("monto_total")),
    "pct_femenino_credito": Layer("muni", "credit_municipal", "cve_mun", _col("pct_femenino")),
    "monto_subsidiado_vivienda": Layer("muni", "housing_municipal", "cve_mun", _col("monto_total")),
    "acciones_vivienda_total": Layer("muni", "housing_municipal", "cve_mun", _col("acciones_total")),
    "tdpa_total": Layer("muni", "traffic_municipal", "cve_mun", _col("tdpa_total")),
    "pobtot_muni": Layer("muni", "census_municipal", "cve_mun", _col("pobtot")),
    "pobtot_ageb": Layer("ageb", "census_tract", "cvegeo", _col("pobtot")),
    "pct_sin_cobertura_salud": Layer(
        "ageb",
        "census_tract",
        "cvegeo",
        lambda: F.when(F.col("pobtot") > 0, F.col("psinder").cast("double") / F.col("pobtot") * 100),
    ),
    "grado_rezago_ageb_ordinal": Layer("ageb", "lag_tract", "cvegeo", lambda: ordinal(F.col("grado"))),
    "farmacias_licenciadas_ageb": Layer("ageb", "licences_tract", "cvegeo_ageb", _col("total_licenciadas")),
}

#: Table and key column that list every unit of a grain.
UNIVERSE = {"muni": ("census_municipal", "cve_mun"), "ageb": ("tract_areas", "cvegeo")}


def layer(tables: dict[str, DataFrame], name: str, state: str | None = None, as_of: int | None = None) -> DataFrame:
    """Keys and values (``k``, ``v``) of one layer, one row per key.

    ``as_of`` is the running year: "mean" layers use the years before it, "fixed"
    layers that very year.
    """
    d = LAYERS[name]
    df = tables[d.table]
    if state:
        df = df.filter(F.left(F.col(d.key), F.lit(2)) == state)
    k, v = F.col(d.key).alias("k"), d.value().cast("double")
    if d.years in ("mean", "fixed") and as_of is None:
        raise ValueError(f"layer {name!r} needs a year")
    if d.years == "mean":
        past = df.filter((F.col(d.year) < as_of) & ~is_catch_all(F.col(d.key)))
        return past.groupBy(k).agg(F.avg(v).alias("v"))
    if d.years == "fixed":
        return df.filter(F.col(d.year) == as_of).select(k, v.alias("v"))
    if d.years == "latest":
        return df.groupBy(k).agg(F.max_by(v, F.col(d.year)).alias("v"))
    return df.select(k, v.alias("v"))


def layer_values(
    tables: dict[str, DataFrame], grain: str, names: list[str], state: str | None = None, as_of: int | None = None
) -> DataFrame:
    """Layers of one grain on all its units, units without any value dropped."""
    for n in names:
        if n not in LAYERS:
            raise ValueError(f"layer {n!r} is not registered")
        if LAYERS[n].grain != grain:
            raise ValueError(f"layer {n!r} is not available at grain {grain!r}")
    table, key = UNIVERSE[grain]
    keys = tables[table].select(F.col(key).alias("k"))
    if state:
        keys = keys.filter(F.left(F.col("k"), F.lit(2)) == state)
    return assemble_layers(keys, {n: layer(tables, n, state, as_of) for n in names})


def per_capita(df: DataFrame, measures: dict[str, str], population: str, required: str) -> DataFrame:
    """Per-1,000 values of count measures; rates and the population itself stay as they are.

    ``measures`` maps columns to their type. Rows lose their place when the
    ``required`` measure is a count and the row has no population.
    """
    pop = F.col(population)
    usable = F.coalesce(pop > 0, F.lit(False))
    counts = [c for c, kind in measures.items() if kind == "numeric_count" and c != population]
    out = df
    if required in counts:
        out = out.filter(usable)
    out = out.filter(F.col(required).isNotNull())
    return out.withColumns(
        {c: F.when(usable, F.col(c) * 1000.0 / pop).otherwise(F.col(c).cast("double")) for c in counts}
    )


def finite(value: Column) -> Column:
    """Whether a value is a number: not NULL, NaN or infinite."""
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def bin_index(value: Column, breaks: list[Column]) -> Column:
    """0-based class of a value: the first break it lies below, NULL for what is no number."""
    out = F.when(~finite(value), None)
    for i, b in enumerate(breaks):
        out = out.when(value < b, i)
    return out.otherwise(len(breaks))


def _with_breaks(df: DataFrame, sample: DataFrame, value: str, bins: int, keys: list[str], prefix: str) -> DataFrame:
    """Rows with the quantile breaks of a sample in columns ``<prefix>1`` and up."""
    shares = {f"{prefix}{i}": (i, bins) for i in range(1, bins)}
    known = sample.filter(finite(F.col(value)))
    breaks = quantiles(known, keys, value, shares).drop("n")
    if keys:
        return df.join(breaks, keys, "left")
    return with_single(df, breaks)


def _class(value: str, bins: int, prefix: str) -> Column:
    return bin_index(F.col(value).cast("double"), [F.col(f"{prefix}{i}") for i in range(1, bins)])


def quantile_bins(df: DataFrame, value: str, bins: int, name: str, keys: list[str] | None = None) -> DataFrame:
    """Rows with their quantile class, the breaks being those of the whole sample (or of each group)."""
    if bins < 2:
        raise ValueError("at least 2 bins")
    out = _with_breaks(df, df, value, bins, keys or [], "_q").withColumn(name, _class(value, bins, "_q"))
    return out.drop(*[f"_q{i}" for i in range(1, bins)])


def layer_domain(df: DataFrame, value: str) -> DataFrame:
    """Tertile breaks, smallest and largest value and sample size of a layer, as one row."""
    df = df.filter(finite(F.col(value)))
    cuts = quantiles(df, [], value, {"break_1": (1, 3), "break_2": (2, 3)})
    return with_single(cuts, df.agg(F.min(value).alias("min"), F.max(value).alias("max")))


def bivariate_class(df: DataFrame, first: str, second: str, name: str = "bivariate") -> DataFrame:
    """Tertile pair of two layers as ``"<first>-<second>"``, NULL where either is missing."""
    both = _with_breaks(df, df, first, 3, [], "_a")
    both = _with_breaks(both, df, second, 3, [], "_b")
    parts = [_class(c, 3, p).cast("string") for c, p in ((first, "_a"), (second, "_b"))]
    return both.withColumn(name, F.concat(parts[0], F.lit("-"), parts[1])).drop("_a1", "_a2", "_b1", "_b2")


def range_position(df: DataFrame, value: str, name: str = "position") -> DataFrame:
    """Place of each value between the smallest (0) and largest (1); 0.5 when all are equal."""
    v = F.col(value)
    placed = with_single(df, df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi")))
    inner = F.when(F.col("_hi") == F.col("_lo"), 0.5).otherwise((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return placed.withColumn(name, F.when(v.isNotNull(), inner).cast("double")).drop("_lo", "_hi")


def drill(df: DataFrame, key: str, level: str | int, measures: list[str]) -> DataFrame:
    """Additive measures summed at one level of a nested key.

    A level is a territorial grain or a number of activity digits.
    """
    width = GRAIN_WIDTH[level] if isinstance(level, str) else level
    by = F.left(F.col(key), F.lit(width)).alias(key)
    return df.filter(F.length(key) >= width).groupBy(by).agg(*[F.sum(m).alias(m) for m in measures])


GEO_LEVELS = ["state", "municipality", "tract"]
ACTIVITY_LEVELS = [2, 3, 4, 5, 6]


def next_level(levels: list, current: str | int, down: bool) -> str | int:
    """One step finer or coarser, staying at the ends."""
    i = levels.index(current) + (1 if down else -1)
    return levels[max(0, min(len(levels) - 1, i))]


@dataclass(frozen=True)
class Field:
    """A measure of the explorer and the column that carries it in each dataset, the preferred dataset first."""

    ident: str
    kind: str
    grain: str
    columns: dict[str, str]


# Datasets and their grain.
DATASETS = {
    "treemap_by_state": "estado",
    "municipality_panel": "muni",
    "top_sectors": "nacional",
    "crime_summary": "muni",
    "mortality_summary": "muni",
    "municipality_wide": "muni",
    "state_wide": "estado",
    "tract_wide": "ageb",
}

# The published fields in their order, with kind, grain and the column in each dataset.
# Two have no dataset. The registry's own prefix is ``registro``.
FIELDS = {
    f.ident: f
    for f in [
        Field(
            "registro.total_establecimientos",
            "numeric_count",
            "muni",
            {
                "municipality_wide": "establecimientos",
                "municipality_panel": "establecimientos",
                "treemap_by_state": "establecimientos",
                "top_sectors": "count",
            },
        ),
        Field("registro.entidad_nombre", "categorical_nominal", "estado", {"treemap_by_state": "entidad", "state_wide": "nom_ent"}),
        Field(
            "registro.municipio_nombre",
            "categorical_nominal",
            "muni",
            {
                "municipality_wide": "municipio",
                "municipality_panel": "municipio",
                "crime_summary": "municipio",
                "mortality_summary": "municipio",
            },
        ),
        Field("registro.scian_sector", "categorical_nominal", "nacional", {"top_sectors": "name"}),
        Field(
            "censo.pobtot",
            "numeric_count",
            "muni",
            {
                "municipality_wide": "poblacion",
                "municipality_panel": "poblacion",
                "crime_summary": "poblacion",
                "mortality_summary": "poblacion",
            },
        ),
        Field("censo.cve_ageb", "categorical_nominal", "ageb", {"tract_wide": "cve_ageb"}),
        Field("censo.pobtot_ageb", "numeric_count", "ageb", {"tract_wide": "pobtot_ageb"}),
        Field("censo.pct_pea", "numeric_pct", "muni", {"municipality_wide": "pct_pea"}),
        Field("censo.graproes", "numeric_continuous", "muni", {"municipality_wide": "graproes"}),
        Field("censo.pct_sin_cobertura_salud", "numeric_pct", "muni", {"municipality_wide": "pct_sin_cobertura_salud"}),
        Field(
            "coneval.pobreza_pct",
            "numeric_pct",
            "muni",
            {
                "municipality_wide": "pobreza_pct",
                "municipality_panel": "pobreza_pct",
                "treemap_by_state": "pobreza_pct_promedio",
            },
        ),
        Field("coneval.pobreza_extrema_pct", "numeric_pct", "muni", {"municipality_wide": "pobreza_extrema_pct"}),
        Field("coneval.carencia_acceso_salud_pct", "numeric_pct", "muni", {"municipality_wide": "carencia_acceso_salud_pct"}),
        Field("coneval.irs_indice", "numeric_continuous", "muni", {"municipality_wide": "irs_indice", "municipality_panel": "irs_indice"}),
        Field(
            "coneval.irs_grado",
            "categorical_ordinal",
            "muni",
            {"municipality_wide": "irs_grado", "municipality_panel": "irs_grado", "treemap_by_state": "modal_irs_grado"},
        ),
        Field("coneval.grado_rezago_ageb", "categorical_ordinal", "ageb", {"tract_wide": "grado_rezago_ageb"}),
        Field("sesnsp.homicidio_doloso", "numeric_count", "muni", {"crime_summary": "homicidio_doloso"}),
        Field("sesnsp.total_delitos", "numeric_count", "muni", {"crime_summary": "total_delitos"}),
        Field("sesnsp.ano", "temporal", "muni", {}),
        Field("edr.total_defunciones", "numeric_count", "muni", {"mortality_summary": "total_defunciones"}),
        Field("edr.def_circulatorio", "numeric_count", "muni", {"mortality_summary": "def_circulatorio"}),
        Field("edr.def_neoplasias", "numeric_count", "muni", {"mortality_summary": "def_neoplasias"}),
        Field("clues.total", "numeric_count", "muni", {"municipality_wide": "unidades_salud", "municipality_panel": "unidades_clues"}),
        Field("sinba.casos_dm2_promedio", "numeric_count", "muni", {"municipality_wide": "dm2_promedio"}),
        Field("sinba.casos_hta_promedio", "numeric_count", "muni", {"municipality_wide": "hta_promedio"}),
        Field("sinba.casos_obesidad_promedio", "numeric_count", "muni", {"municipality_wide": "obesidad_promedio"}),
        Field("cofepris.total_licenciadas", "numeric_count", "muni", {"municipality_wide": "total_licenciadas"}),
        Field("cofepris.con_estupefacientes", "numeric_count", "muni", {"municipality_wide": "con_estupefacientes"}),
        Field("cofepris.con_controlados_ageb", "numeric_count", "ageb", {}),
        Field("ce2024.ue", "numeric_count", "muni", {"municipality_wide": "economico_ue"}),
        Field("ce2024.personal_ocupado", "numeric_count", "muni", {"municipality_wide": "economico_personal_ocupado"}),
        Field("ce2024.valor_agregado", "numeric_continuous", "muni", {"municipality_wide": "economico_valor_agregado"}),
        Field("enigh.ingreso_p50", "numeric_continuous", "estado", {"state_wide": "ingreso_corriente_mediana"}),
        Field("enigh.engel_coefficient", "numeric_pct", "estado", {"state_wide": "pct_gasto_alimentos"}),
        Field("enoe.pct_informal", "numeric_pct", "estado", {"state_wide": "tasa_informalidad"}),
        Field("enoe.tasa_desocupacion", "numeric_pct", "estado", {"state_wide": "tasa_desocupacion"}),
        Field("sict.tdpa_total", "numeric_count", "muni", {"municipality_wide": "tdpa_total"}),
        Field("sedatu.monto_total", "numeric_continuous", "muni", {"municipality_wide": "vivienda_monto_total"}),
        Field("sedatu.acciones_total", "numeric_count", "muni", {"municipality_wide": "vivienda_acciones_total"}),
        Field("cnbv.monto_total", "numeric_continuous", "muni", {"municipality_wide": "credito_monto_total"}),
        Field("cnbv.pct_femenino", "numeric_pct", "muni", {"municipality_wide": "credito_pct_femenino"}),
    ]
}


def pick_dataset(fields: list[str]) -> str:
    """The first dataset of the first field that carries all the chosen fields."""
    for name in FIELDS[fields[0]].columns:
        if all(name in FIELDS[f].columns for f in fields):
            return name
    raise ValueError("no dataset carries all of these fields")


def explorer_rows(datasets: dict[str, DataFrame], x: str, y: str, z: str | None = None, per_1000: bool = False,
                  pins: list | None = None) -> DataFrame:
    """Rows (x, y, z) of an explorer chart: named fields, graded z as its rank, optional rates, pins on x."""
    chosen = [f for f in (x, y, z) if f]
    name = pick_dataset(chosen)
    df = datasets[name]
    column = {f: FIELDS[f].columns[name] for f in chosen}
    xs = F.col(column[x])
    out = df.select(
        xs.alias("x"),
        F.col(column[y]).cast("double").alias("y"),
        (_explorer_z(FIELDS[z], column[z]) if z else F.lit(None).cast("double")).alias("z"),
        (F.col(FIELDS["censo.pobtot"].columns[name]) if DATASETS[name] == "muni" else F.lit(None).cast("long")).alias(
            "_pop"
        ),
    ).filter(xs.isNotNull() & (F.trim(xs.cast("string")) != ""))
    if per_1000 and DATASETS[name] == "muni":
        kinds = {"y": FIELDS[y].kind if y != "censo.pobtot" else "numeric_rate"}
        if z and FIELDS[z].kind == "numeric_count" and z != "censo.pobtot":
            kinds["z"] = "numeric_count"
        out = per_capita(out, kinds, "_pop", "y")
    if pins:
        out = out.filter(F.col("x").cast("string").isin([str(p) for p in pins]))
    return out.filter(F.col("y").isNotNull()).drop("_pop")


def _explorer_z(field: Field, column: str) -> Column:
    if field.kind == "categorical_ordinal":
        return ordinal(F.col(column), base=0).cast("double")
    return F.col(column).cast("double")
