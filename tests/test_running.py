"""Running sums over stored parts, and group totals, against plain Python."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from demarca.sources import running


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    made = [("hot" if n % 3 else rng.choice(["a", "b", None]), rng.randint(0, 5), n, rng.choice([None, 1, -2, 7])) for n in range(3000)]
    return spark.createDataFrame(made, "g string, v int, id long, w long").repartition(5)


def brute(table, keys):
    out, groups = [], {}
    made = sorted((tuple(r) for r in table.collect()), key=lambda r: (r[1], r[2]))
    for r in made:
        groups.setdefault(r[0] if keys else 0, []).append(r)
    for own in groups.values():
        total, run = sum(r[3] or 0 for r in own), 0
        for r in own:
            run += r[3] or 0
            out.append((*r, run, total))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keys", [["g"], []])
def test_running_total(spark, table, tmp_path, keys):
    got = running.running_total_stored(table, keys, ["v", "id"], "w", str(tmp_path / "r"))
    assert got.columns == ["g", "v", "id", "w", "running", "running_total"]
    assert rows(got) == brute(table, keys)


def test_a_hot_group_lies_in_many_parts(spark, table, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts would be put together
    try:
        running.running_total_stored(table, ["g"], ["v", "id"], "w", str(tmp_path / "r"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    laid = spark.read.parquet(str(tmp_path / "r")).where("g = 'hot'")
    sizes = [r[1] for r in laid.groupBy(F.shiftright("_at", running.PLACE)).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.8 * sum(sizes)


def test_group_totals(table):
    want = {(r[0], r[2]): r[5] for r in brute(table, ["g"])}
    got = {(r.g, r.id): r.t for r in running.with_group_total(table, ["g"], "w", "t").collect()}
    assert got == want
    assert {r.t for r in running.with_group_total(table, [], "w", "t").collect()} == {sum(r.w or 0 for r in table.collect())}


def test_an_empty_table(table, tmp_path):
    assert running.running_total_stored(table.limit(0), ["g"], ["v", "id"], "w", str(tmp_path / "r")).collect() == []
    assert running.with_group_total(table.limit(0), ["g"], "w", "t").collect() == []
