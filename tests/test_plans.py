"""What the physical plans must look like on stored tables."""

import pytest
from pyspark.sql import functions as F

from demarca.operators import spatial
from demarca.operators.aggregate import best_category
from demarca.plans import establishments, incidence
from workbench.kit import Tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "registry")
    Tables(spark, small).registry.write.parquet(path)
    return spark.read.parquet(path)


def test_radius_filter_reaches_the_scan(stored):
    plan = plan_of(spatial.within_radius(stored.select("clee", "latitud", "longitud"), "latitud", "longitud", 19.0, -98.0, 10.0))
    assert "GreaterThanOrEqual(latitud" in plan and "LessThanOrEqual(longitud" in plan


def test_tile_bounds_reach_the_scan(stored):
    keep = F.col("entidad") == "16"
    plan = plan_of(spatial.one_tile(stored.select("clee", "entidad", "latitud", "longitud"), "clee", "longitud", "latitud", 9, 115, 227, keep))
    assert "EqualTo(entidad,16)" in plan and "GreaterThanOrEqual(latitud" in plan


def test_matrix_reads_two_columns_and_counts_before_joining(spark, small, stored):
    plan = plan_of(establishments.sector_grade_matrix(stored, Tables(spark, small).lag))
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "sector_actividad_id" in line)
    assert "ReadSchema: struct<area_geo:string,sector_actividad_id:string>" in scan
    assert plan.index("Join") < plan.index("partial_count(1)")


def test_live_crime_pushes_state_and_years(spark, small, tmp_path):
    t = Tables(spark, small)
    path = str(tmp_path / "crime")
    t.crime_long.write.parquet(path)
    long = spark.read.parquet(path)
    plan = plan_of(
        incidence.crime_summary_live(long, t.census_municipal, "16", 2000, 1998, incidence.CRIME_CATEGORIES)
    )
    assert "EqualTo(ano,2000)" in plan and "EqualTo(ano,1998)" in plan


def test_best_category_needs_no_window(stored):
    plan = plan_of(best_category(stored, ["area_geo"], "sector_actividad_id", F.count(F.lit(1)), ("top", "n")))
    assert "Window" not in plan and "partial_min" in plan
