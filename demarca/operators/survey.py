"""Weighted survey estimates per state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.functions.measures import money_ratio, money_share, ratio, round_to_long, sum_where
from demarca.operators.aggregate import period_average
from demarca.operators.ordered import weighted_percentiles


def income_calibrator(
    df: DataFrame, key: str, weight: str, members: str, income: str, spending: str, parts: dict[str, str], year: int
) -> DataFrame:
    """Households, persons, income mean and percentiles, spending mean and shares.

    Weights and members are integers, amounts are ``decimal(18,2)``. ``parts`` maps
    a result name to the column of one spending item. Means of spending divide by
    the weights of rows that report it.
    """
    w, spent = F.col(weight), F.col(spending)
    totals = df.groupBy(key).agg(
        F.lit(year).alias("ano_levantamiento"),
        round_to_long(F.sum(w).cast("decimal(28,0)")).alias("hogares_estimados"),
        round_to_long(F.sum(w * F.col(members)).cast("decimal(28,0)")).alias("poblacion_estimada"),
        money_ratio(F.sum(w * F.col(income)), F.sum(w)).alias("ingreso_corriente_promedio"),
        money_ratio(F.sum(w * spent), sum_where(spent.isNotNull(), w)).alias("gasto_corriente_promedio"),
        *[money_share(F.sum(w * F.col(c)), F.sum(w * spent)).alias(name) for name, c in parts.items()],
    )
    cuts = weighted_percentiles(
        df,
        [key],
        income,
        weight,
        {"ingreso_corriente_mediana": "0.5", "decil_1_ingreso": "0.1", "decil_9_ingreso": "0.9"},
    ).drop("total_weight")
    return totals.join(cuts, key, "left")


def labour_calibrator(df: DataFrame, key: str, year: int) -> DataFrame:
    """Labour totals averaged over the quarters present, and rates.

    Expects ``w`` (integer), ``edad``, ``clase1``, ``clase2``, ``emp_ppal``,
    ``ingreso`` (integer) and ``trimestre``.
    """
    w = F.col("w")
    adult = F.col("edad") >= 15
    active = F.col("clase1") == "1"
    employed = F.col("clase2") == "1"
    idle = F.col("clase2") == "2"
    informal = F.col("emp_ppal") == "1"
    paid = employed & (F.col("ingreso") > 0)

    def level(cond: Column) -> Column:
        return period_average(sum_where(cond, w), F.col("trimestre"))

    def rate(num: Column, den: Column) -> Column:
        return ratio(sum_where(num, w), sum_where(den, w), 100, 2)

    return df.groupBy(key).agg(
        F.lit(year).alias("ano_levantamiento"),
        level(adult).alias("poblacion_15_mas"),
        level(active).alias("pea"),
        level(employed).alias("ocupada"),
        level(idle).alias("desocupada"),
        level(informal).alias("informal"),
        rate(active, adult).alias("tasa_participacion"),
        rate(idle, active).alias("tasa_desocupacion"),
        rate(informal, employed).alias("tasa_informalidad"),
        ratio(sum_where(paid, w * F.col("ingreso")), sum_where(paid, w), 1, 2).alias("ingreso_promedio_mensual"),
        F.count_distinct("trimestre").cast("long").alias("trimestres_cargados"),
    )



