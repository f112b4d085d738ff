"""Ranked tables: any page equals the sorted list, and few files are opened."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from demarca.operators import ordered
from demarca.sources import pages


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    made = [(rng.choice(["a", "é", "Z", "~", None]), n, str(n)) for n in range(3000)] + [("a", 5000 + n, "x") for n in range(1500)]
    return spark.createDataFrame(made, "s string, k long, v string").repartition(4).cache()


@pytest.fixture(scope="module")
def path(spark, table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ranked") / "t")
    pages.write_ranked(table, path, ["s", "k"], files=16)
    return path


def scanned(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().get("numOutputRows").get().value()


def in_order(table):
    return [tuple(r) for r in table.orderBy("s", "k").collect()]


def test_pages_equal_the_sorted_list(spark, table, path):
    want = in_order(table)
    assert pages.total(spark, path) == len(want) == 4500
    for number, size in ((1, 10), (7, 100), (45, 100), (46, 100), (2, 4000), (1, 5000), (4500, 1), (99, 99)):
        got = [tuple(r) for r in pages.page(spark, path, number, size).collect()]
        assert got == want[(number - 1) * size : number * size]
    with pytest.raises(ValueError):
        pages.page(spark, path, 0, 10)


def test_a_deep_page_opens_two_files_at_most(spark, path):
    for number in (1, 90, 301, 449):
        files = pages.page(spark, path, number, 10).inputFiles()
        assert 1 <= len(files) <= 2
    assert len(pages._files(spark, path)) >= 12


def test_rank_of_a_key(spark, table, path):
    want = [r[:2] for r in in_order(table)]
    for at in (0, 1, 700, 2222, 4499):
        assert pages.rank_of(spark, path, want[at]) == at
    assert pages.rank_of(spark, path, ("b", 0)) == sum(1 for s, _ in want if s is None or s.encode() < b"b")
    assert pages.rank_of(spark, path, (None, -1)) == 0
    assert pages.rank_of(spark, path, ("\U0010ffff", 0)) == 4500


def test_an_empty_table(spark, table, tmp_path):
    path = str(tmp_path / "none")
    pages.write_ranked(table.limit(0), path, ["k"])
    assert pages.total(spark, path) == 0 and pages.page(spark, path, 1, 10).count() == 0
    assert pages.rank_of(spark, path, [5]) == 0


IDS = ["x", "xa", "xab", "xabc", "xé", "xz\U0001f600", "y" * 40, *[f"x{n:05d}" for n in range(400)], *[f"x9{n}" for n in range(90)]]


@pytest.mark.parametrize("kind", ["string", "long"])
@pytest.mark.parametrize("n", [1, 7, 300, 10_000])
def test_smallest_per_group(spark, kind, n):
    rng = random.Random(n)
    ids = IDS if kind == "string" else [-(1 << 60), *range(-50, 350), 1 << 60, *range(10**15, 10**15 + 90)]
    made = [(g, i, rng.random()) for g in ("hot", None, "c") for i in ids if g == "hot" or rng.random() < 0.02]
    df = spark.createDataFrame(made, f"g string, i {kind}, v double").repartition(5)
    want = []
    for g in {r[0] for r in made}:
        own = sorted((r for r in made if r[0] == g), key=lambda r: r[1].encode() if kind == "string" else r[1])
        want += own[:n]
    assert rows(ordered.smallest_per_group(df, ["g"], "i", n)) == sorted(want, key=repr)


def test_a_hot_group(spark):
    df = spark.range(200_000).select(F.lit(1).alias("g"), F.concat(F.lit("id-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("i"))
    got = ordered.smallest_per_group(df, ["g"], "i", 50_000)
    assert got.agg(F.count("*"), F.max("i")).first() == (50_000, "id-000049999")
