import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from demarca.operators import ordered


def hot_data(n=4000, seed=5):
    """A third of all rows in one group, with repeated values, negatives, zero and a far outlier."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else f"g{r.randrange(6)}"
        v = r.choice([0, -5, 17, 17, r.randrange(-1000, 1000), 10**12 + r.randrange(50)])
        out.append((g, v, r.randrange(0, 4), i))
    return out


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(hot_data(), "g string, v long, w long, id long")


def test_weighted_percentiles_equal_brute_force(points):
    got = {
        r.g: (r.a, r.b, r.c)
        for r in ordered.weighted_percentiles(points, ["g"], "v", "w", {"a": "0.1", "b": "0.5", "c": "0.9"}).collect()
    }
    groups = {}
    for g, v, w, _ in hot_data():
        groups.setdefault(g, []).append((v, w))
    for g, items in groups.items():
        total, want = sum(w for _, w in items), []
        for tenths in (1, 5, 9):
            cum = 0
            for v, w in sorted(items):
                cum += w
                if w and cum * 10 >= total * tenths:
                    want.append(v)
                    break
        assert got[g] == tuple(want)


def test_quantiles_follow_linear_rule(points, spark):
    import numpy as np

    got = {r.g: (r.lo, r.hi, r.n) for r in ordered.quantiles(points, ["g"], "v", {"lo": (1, 3), "hi": (2, 3)}).collect()}
    groups = {}
    for g, v, _, _ in hot_data():
        groups.setdefault(g, []).append(v)
    for g, vals in groups.items():
        want = np.quantile(vals, [1 / 3, 2 / 3])
        assert got[g][2] == len(vals)
        assert np.allclose(got[g][:2], want, rtol=1e-9, atol=1e-6)


def test_quantiles_without_groups_and_empty(spark):
    one = spark.createDataFrame([(3.0,)], "v double")
    assert rows(ordered.quantiles(one, [], "v", {"m": (1, 2)})) == [(3.0, 1)]
    assert ordered.quantiles(one.filter("v > 5"), [], "v", {"m": (1, 2)}).count() == 0


def test_running_total_on_hot_values(points):
    got = {r.id: (r.running, r.running_total) for r in ordered.running_total(points, ["g"], "v", ["id"], "w").collect()}
    groups = {}
    for g, v, w, i in hot_data():
        groups.setdefault(g, []).append((v, i, w))
    for items in groups.values():
        total, cum = sum(w for _, _, w in items), 0
        for _, i, w in sorted(items):
            cum += w
            assert got[i] == (cum, total)


def test_top_per_group_salted_equals_plain(points):
    order = [F.desc("v"), F.asc("id")]
    plain = rows(ordered.top_per_group(points, ["g"], order, 7))
    salted = rows(ordered.top_per_group(points, ["g"], order, 7, salt=F.pmod(F.col("id"), F.lit(5))))
    assert plain == salted and len(plain) == 49


def test_latest_row_is_limited_before_the_shuffle(points):
    plan = ordered.latest_per_key(points, ["g"], [F.desc("v"), F.asc("id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_page_and_order_checks(points):
    assert [r.id for r in ordered.page(points, [F.asc("id")], 2, 10).collect()] == list(range(10, 20))
    with pytest.raises(ValueError):
        ordered.page(points, [F.asc("id")], 0, 10)
    with pytest.raises(ValueError):
        ordered.ranked_by(points, "nope", {"v": [F.asc("v")]}, 5)
    with pytest.raises(ValueError):
        ordered.ranked_by(points, "v", {"v": [F.asc("v")]}, 0)
    assert ordered.ranked_by(points, "v", {"v": [F.asc("v")]}).count() == points.count()


def test_running_total_without_groups(spark):
    df = spark.createDataFrame([(v, i, 1) for i, v in enumerate([5, 5, 1, 9, 5])], "v long, id long, w long")
    got = {r.id: (r.run, r.run_total) for r in ordered.running_total(df, [], "v", ["id"], "w", "run").collect()}
    assert got == {2: (1, 5), 0: (2, 5), 1: (3, 5), 4: (4, 5), 3: (5, 5)}


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_running_total_of_cut_ranges_cut_again(spark, levels, monkeypatch):
    """With few cut points per level, also a hot value and a hot group."""
    monkeypatch.setattr(ordered, "CUTS", 6)
    rows = [("a" if i % 3 else "b", 7 if i % 2 else i % 50, i, i % 5) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v long, id long, w long")
    got = {r.id: (r.run, r.run_total) for r in ordered.running_total(df, ["g"], "v", ["id"], "w", "run", levels).collect()}
    for g in "ab":
        total, own = 0, sorted((v, i, w) for h, v, i, w in rows if h == g)
        for _, i, w in own:
            total += w
            assert got[i] == (total, sum(x[2] for x in own))


@pytest.mark.parametrize("levels", [1, 2])
def test_running_total_keeps_a_hot_group_spread(spark, levels, monkeypatch):
    """Large groups, cut again too, beside small ones; rows meet their group's cut points without a shuffle by group."""
    monkeypatch.setattr(ordered, "CUTS", 8)
    monkeypatch.setattr(ordered, "RANGE_ROWS", 40)
    rows = [(i % 3 % 2 if i < 900 else i, i * 7919 % 300, i, i % 5) for i in range(950)]
    df = spark.createDataFrame(rows, "g long, v long, id long, w long").localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ordered.running_total(df, ["g"], "v", ["id"], "w", "run", levels)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.id: (r.run, r.run_total) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"SortMergeJoin(\(skew=true\))? \[g#\d+L?\]", plan)
    for g in {r[0] for r in rows}:
        own = sorted((v, i, w) for h, v, i, w in rows if h == g)
        cum, total = 0, sum(x[2] for x in own)
        for _, i, w in own:
            cum += w
            assert got[i] == (cum, total)


def test_pages_behind_a_key(points):
    """Walking key by key gives every row once, in order."""
    seen, after = [], None
    while got := [r.id for r in ordered.page_after(points, "id", after, 700).collect()]:
        seen, after = seen + got, got[-1]
    assert seen == sorted(r.id for r in points.collect())
    with pytest.raises(ValueError):
        ordered.page_after(points, "id", None, 0)
