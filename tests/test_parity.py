"""Every registered query against its independent SQL on the small driver tables."""

import pytest
from conftest import SMALL

from workbench.catalogue import ORACLE, QUERIES
from workbench.compare import connect, difference

WITHOUT_TWIN = {
    "kmeans_cluster_summary",
    "kmeans_cluster_members",
    "prevalence_model_by_tract",
}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_only_known_queries_lack_a_twin():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_TWIN


#: Plan nodes no query may contain: pairwise joins and row-at-a-time or batch Python.
UNWANTED = ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "Scan ExistingRDD"]


def unwanted(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [n for n in UNWANTED if n in plan]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal_to_twin(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    assert difference(df, duck, ORACLE[name]) is None
    assert unwanted(df) == []


@pytest.mark.parametrize("name", sorted(WITHOUT_TWIN))
def test_runs_without_twin(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.count() > 0
    assert unwanted(df) == []


def test_entry(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["entidad", "establecimientos", "modal_irs_grado", "pobreza_pct_promedio"]
    assert df.count() > 0
