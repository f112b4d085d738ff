"""User-level indices built on the finished tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.functions.measures import ratio_positive
from demarca.operators.joins import deserts, enrich

FINE = "decimal(20,4)"


def _part(num: str, den: str) -> Column:
    """``num / den`` to 8 digits, 0 where it is unknown."""
    return F.coalesce(ratio_positive(F.col(num), F.col(den), 1, 8), F.lit(0))


def socioeconomic_score(registry: DataFrame, tracts: DataFrame, poverty: DataFrame) -> DataFrame:
    """Establishments with a synthetic score of their tract and the poverty of their municipality.

    The score is taken per tract before the join.
    """
    school = F.coalesce(F.col("graproes").cast(FINE) / 12, F.lit(0))
    parts = _part("vph_autom", "pobtot") + school + _part("vph_inter", "pobtot") + _part("pocupada", "pobtot")
    scored = tracts.select(
        F.col("cvegeo").alias("ageb"), "pobtot", F.round(parts * 25 * 100, 2).alias("nse_sintetico")
    )
    poor = poverty.select(F.col("cve_mun").alias("area_geo"), "pobreza_pct")
    return registry.join(scored, "ageb", "left").join(poor, "area_geo", "left")


def market_potential(census: DataFrame, poverty: DataFrame) -> DataFrame:
    """Uncovered and older people and lack of access to health, 0 to 100."""
    lack = F.coalesce(F.col("carencia_acceso_salud_pct").cast(FINE) / 100, F.lit(0))
    index = _part("psinder", "pobtot") * 40 + _part("p_60ymas", "pobtot") * 30 + lack * 30
    out = enrich(
        census.select("cve_mun", "pobtot", "psinder", "p_60ymas"),
        [poverty.select("cve_mun", "pobreza_pct", "carencia_acceso_salud_pct")],
        "cve_mun",
    )
    return out.withColumns(
        {
            "pct_psinder": ratio_positive(F.col("psinder"), F.col("pobtot"), 100, 2),
            "pct_adultos_mayores": ratio_positive(F.col("p_60ymas"), F.col("pobtot"), 100, 2),
            "imp_score": F.round(index, 2) * 100,
        }
    )


def health_vulnerability(tracts: DataFrame) -> DataFrame:
    """Weights 0.35 older people, 0.25 little schooling, 0.20 no car, 0.20 disability; 0 to 100."""
    school = F.least(F.coalesce(F.col("graproes").cast(FINE) / 15, F.lit(0)), F.lit(1))
    index = (
        _part("p_60ymas", "pobtot") * 35
        + (F.lit(1) - school) * 25
        + (F.lit(1) - _part("vph_autom", "tvivparhab")) * 20
        + _part("pcon_disc", "pobtot") * 20
    )
    return tracts.select("cvegeo", "pobtot", F.round(index, 2).alias("ivs_salud"))


def location_score(units: DataFrame) -> DataFrame:
    """Weighted sum of four capped terms.

    Expects ``base_score``, ``ingresos``, ``unidades`` and ``robo_promedio``. As in
    the published formula, a missing capped term takes its bound, because ``least``
    and ``greatest`` skip NULLs.
    """
    cap, floor = F.lit(100).cast(FINE), F.lit(0).cast(FINE)
    terms = (
        F.col("base_score").cast(FINE) * 40
        + F.least(F.col("ingresos").cast(FINE) / 1_000_000, cap) * 20
        + F.least((F.col("unidades") * 5).cast(FINE), cap) * 15
        + F.greatest(cap - F.col("robo_promedio").cast(FINE) / 10, floor) * 25
    )
    return units.withColumn("score_fase2", F.round(terms / 100, 2))


def extended_location_score(units: DataFrame) -> DataFrame:
    """The location score with demand (0.25) and tourism (0.10) terms added; a missing term counts 0.

    Expects ``score_fase2``, ``egresos_cronicos`` and ``gasto_turista``.
    """
    cap, none = F.lit(100).cast(FINE), F.lit(0).cast(FINE)
    demand = F.least(F.coalesce(F.col("egresos_cronicos").cast(FINE) / 100, none), cap)
    tourism = F.least(F.coalesce(F.col("gasto_turista").cast(FINE) * 100 / 5000, none), cap)
    total = (F.col("score_fase2").cast(FINE) * 65 + demand * 25 + tourism * 10) / 100
    return units.withColumns(
        {"demanda_score": F.round(demand, 4), "turismo_score": F.round(tourism, 4), "score_fase3": F.round(total, 2)}
    )


def critical_deserts(census: DataFrame, points: DataFrame, key: str, floor_pct: int = 40) -> DataFrame:
    """Units without any point in which more than ``floor_pct`` percent are uncovered."""
    empty = deserts(census, points, key)
    share = ratio_positive(F.col("psinder"), F.col("pobtot"), 100, 2)
    return empty.select(key, "pobtot", "psinder", share.alias("pct_psinder")).filter(F.col("pct_psinder") > floor_pct)


def demand_per_supplier(demand: DataFrame, suppliers: DataFrame, key: str, floor: int) -> DataFrame:
    """Cases per supplier where the uncovered cases exceed a floor; NULL without a supplier.

    ``demand`` has ``casos`` and ``sin_cobertura`` per unit; suppliers are counted before the join.
    """
    counts = suppliers.groupBy(key).agg(F.count(F.lit(1)).alias("farmacias"))
    out = demand.filter(F.col("sin_cobertura") > floor).join(counts, key, "left")
    n = F.coalesce("farmacias", F.lit(0))
    return out.select(key, "casos", "sin_cobertura", n.alias("farmacias")).withColumn(
        "casos_por_farmacia", ratio_positive(F.col("casos"), F.col("farmacias"), 1, 1)
    )


def prevalence_model(sample: DataFrame, label: str, covariates: list[str], areas: DataFrame, weight: str | None = None):
    """Expected prevalence per area from a logistic model of a survey's covariates.

    Sample rows without a label or a covariate are not used; an area without a covariate
    stays, with a NULL prevalence. Fitting runs Spark jobs when this function is called.
    """
    assemble = VectorAssembler(inputCols=covariates, outputCol="_x", handleInvalid="keep")
    known = reduce(and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c)) for c in covariates])
    fit = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=50, **({"weightCol": weight} if weight else {}))
    model = fit.fit(assemble.transform(sample.filter(known & F.col(label).isNotNull())))
    scored = model.transform(assemble.transform(areas))
    prevalence = F.when(known, vector_to_array("probability")[1])
    return scored.withColumn("prevalence", prevalence).select(*areas.columns, "prevalence")


def prevalence_by(areas: DataFrame, intercept: float, coefficients: dict[str, float]) -> DataFrame:
    """Expected prevalence per area by a logistic model that is already fitted, from its coefficients by covariate.

    An area without a covariate stays, with a NULL prevalence.
    """
    known = reduce(and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in coefficients])
    load = reduce(lambda a, b: a + b, [F.col(c).cast("double") * w for c, w in coefficients.items()], F.lit(intercept))
    return areas.withColumn("prevalence", F.when(known, 1 / (1 + F.exp(-load))))
