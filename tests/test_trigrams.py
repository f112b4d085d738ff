"""Substring search by trigrams: the rows of a scan, from few of them."""

import random

import numpy as np
import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from demarca.operators.filters import name_contains
from demarca.sources import trigrams


@given(st.sets(st.integers(0, 65535), max_size=200))
def test_lists_round_trip(numbers):
    offsets = np.array(sorted(numbers), dtype=np.int64)
    assert trigrams.decoded(trigrams.coded(offsets)).tolist() == offsets.tolist()


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(6)
    made = [(n, "Farmacia " + "".join(rng.choices("abcdeé ÑxX.%_'", k=rng.randint(0, 14)))) for n in range(4000)]
    made += [(5000, None), (5001, ""), (5002, "ab"), (5003, "aXc"), (5004, "İstanbul straße"), (5005, "y" * 5000), (5006, "needle in a STACK"), (5006, "needle in a STACK")]
    return spark.createDataFrame(made, "id long, nombre string").withColumns({"gram": F.lit("clash"), "rows": F.lit(1)}).repartition(3)


@pytest.fixture(scope="module")
def path(spark, table, tmp_path_factory):
    spark.conf.set("parquet.block.size", "4096")
    path = str(tmp_path_factory.mktemp("trigrams") / "t")
    trigrams.write_index(table, path, "nombre", ["id"])
    return path


@pytest.mark.parametrize("text", ["farm", "FARMACIA ", "éñ", "abc", "axC", "ab", "", "x%_", "'", "needle in a stack", "zzzz", "yyyy", "i̇sta", "İSTA", "STRASSE", "a é"])
@pytest.mark.parametrize("chunk", [16, 6])
def test_equal_to_a_scan(spark, table, path, tmp_path, monkeypatch, text, chunk):
    if chunk != trigrams.CHUNK:
        if text not in ("farm", "abc", "axC"):
            return
        monkeypatch.setattr(trigrams, "CHUNK", chunk)
        path = str(tmp_path / "t")
        trigrams.write_index(table, path, "nombre", ["id"])
    want = rows(table.filter(name_contains(F.col("nombre"), text)))
    assert rows(trigrams.containing(spark, path, "nombre", text)) == want


def test_few_rows_are_candidates(spark, table, path):
    assert trigrams.candidates(spark, path, "stack").count() == 2
    assert trigrams.candidates(spark, path, "ab") is None
    found = trigrams.containing(spark, path, "nombre", "needle")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual({trigrams.ROW}" in plan


def test_an_empty_table(spark, table, tmp_path):
    trigrams.write_index(table.limit(0), str(tmp_path / "t"), "nombre", ["id"])
    assert trigrams.containing(spark, str(tmp_path / "t"), "nombre", "farm").count() == 0
