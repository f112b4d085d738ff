"""Household income and labour surveys to state calibrators, and their readers' joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demarca.functions.keys import MUNICIPALITY, STATE, at_grain, pad
from demarca.functions.measures import MONEY
from demarca.functions.text import null_tokens
from demarca.operators.joins import latest_join, one_row
from demarca.operators.ordered import latest_per_key
from demarca.operators.survey import income_calibrator, labour_calibrator

# Spending items and the shares they give.
SPENDING = {
    "pct_gasto_alimentos": "alimentos",
    "pct_gasto_vivienda": "vivienda",
    "pct_gasto_salud": "salud",
    "pct_gasto_transporte": "transporte",
    "pct_gasto_educacion": "educacion",
}


def income_rows(raw: DataFrame) -> DataFrame:
    """Typed households with a valid place and a positive weight."""
    weight = null_tokens(F.col("factor"), [""]).cast("long")
    money = {c: null_tokens(F.col(c), [""]).cast(MONEY) for c in ["ing_cor", "gasto_mon", *SPENDING.values()]}
    return (
        raw.filter(F.col("ubica_geo").rlike(MUNICIPALITY))
        .withColumns(
            {
                "entidad": at_grain(F.col("ubica_geo"), "state"),
                "factor": weight,
                "tot_integ": null_tokens(F.col("tot_integ"), [""]).cast("long"),
                **money,
            }
        )
        .filter(F.col("factor") > 0)
    )


def income_survey(raw: DataFrame, year: int) -> DataFrame:
    return income_calibrator(
        income_rows(raw), "entidad", "factor", "tot_integ", "ing_cor", "gasto_mon", SPENDING, year
    )


def labour_rows(raw: DataFrame) -> DataFrame:
    """Typed persons with a valid state and a positive weight; blanks mean "not asked"."""
    number = {c: null_tokens(F.trim(src), [""]).cast("long") for c, src in
              {"w": "fac_tri", "edad": "eda", "ingreso": "ingocup"}.items()}
    return raw.select(
        pad(F.trim("ent"), 2).alias("entidad"),
        *[c.alias(n) for n, c in number.items()],
        *[F.trim(c).alias(c) for c in ("clase1", "clase2", "emp_ppal")],
        "trimestre",
    ).filter(F.col("entidad").rlike(STATE) & (F.col("w") > 0))


def labour_survey(raw: DataFrame, year: int) -> DataFrame:
    return labour_calibrator(labour_rows(raw), "entidad", year)


def _latest(df: DataFrame, year_as: str) -> DataFrame:
    latest = latest_per_key(df, ["entidad"], [F.desc_nulls_last("ano_levantamiento")])
    return latest.withColumnRenamed("ano_levantamiento", year_as)


def state_calibrators(income: DataFrame, labour: DataFrame, state: str) -> DataFrame:
    """Latest income and labour estimates of a state on one row; a missing side is NULL."""
    here = F.col("entidad") == state
    jobs = _latest(labour.filter(here), "enoe_ano").withColumnsRenamed(
        {
            "trimestres_cargados": "enoe_trimestres_cargados",
            "ingreso_promedio_mensual": "ingreso_promedio_mensual_ocupado",
        }
    )
    return one_row("entidad", state, [_latest(income.filter(here), "enigh_ano"), jobs])


def state_wide(states: DataFrame, income: DataFrame, labour: DataFrame) -> DataFrame:
    """All states with four measures of their latest surveys."""
    order = [F.desc_nulls_last("ano_levantamiento")]
    jobs = labour.select("entidad", "ano_levantamiento", "tasa_informalidad", "tasa_desocupacion")
    money = income.select("entidad", "ano_levantamiento", "ingreso_corriente_mediana", "pct_gasto_alimentos")
    out = latest_join(states, jobs, "entidad", order).drop("ano_levantamiento")
    out = latest_join(out, money, "entidad", order).drop("ano_levantamiento")
    return out.withColumnRenamed("entidad", "cve_ent")
