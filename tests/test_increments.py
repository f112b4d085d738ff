"""Summaries that are refreshed by change: what is read, what is refused, and equality with a rebuild."""

import os
from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from demarca.sources import increments, sinks
from demarca.sources.increments import MissingSummary, StaleSummary, Summary

SIZES = Summary(
    "sizes",
    ("k",),
    lambda df, keys: df.groupBy(*keys).agg(F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")),
    {"s": "sum", "lo": "min", "hi": "max", "n": "sum"},
)
KIND = "p string, k string, v int"
FIRST = [("01", "a", 1), ("01", "b", 5), ("02", "a", -3), ("02", None, 7), ("x y/é", "a", 9), (None, "b", None)]


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "source")
    sinks.overwrite(spark.createDataFrame(FIRST, KIND), path, ["p"])
    return path


def spoil(path, units):
    """Overwrite the files of some units with as many zero bytes, with the times they had."""
    for folder, _, names in os.walk(path):
        if os.path.basename(folder) in units:
            for name in names:
                if name.endswith(".parquet"):
                    file = os.path.join(folder, name)
                    had = os.stat(file)
                    with open(file, "r+b") as f:
                        f.write(bytes(had.st_size))
                    os.utime(file, ns=(had.st_atime_ns, had.st_mtime_ns))


def test_first_refresh_equals_live(spark, source, tmp_path):
    done = increments.refresh(spark, SIZES, source, str(tmp_path))
    assert done.version == 1 and len(done.computed) == 4 and not done.dropped
    found = rows(increments.stored(spark, SIZES, source, str(tmp_path)))
    assert found == rows(increments.live(spark, SIZES, source))
    assert found == sorted([("a", 7, -3, 9, 3), ("b", 5, 5, 5, 2), (None, 7, 7, 7, 1)], key=repr)


def test_only_changed_units_are_read(spark, source, tmp_path):
    root = str(tmp_path)
    increments.refresh(spark, SIZES, source, root)
    sinks.replace_partition(spark.createDataFrame([("02", "c", 2)], KIND), source, ["p"])
    want = rows(increments.live(spark, SIZES, source))
    spoil(source, {"p=01", "p=__HIVE_DEFAULT_PARTITION__"})
    done = increments.refresh(spark, SIZES, source, root)
    assert done.computed == ["p=02"] and not done.dropped
    assert rows(increments.stored(spark, SIZES, source, root)) == want
    with pytest.raises(Exception, match="(?i)parquet"):
        increments.live(spark, SIZES, source).collect()


def test_nothing_is_written_when_nothing_changed(spark, source, tmp_path):
    increments.refresh(spark, SIZES, source, str(tmp_path))
    again = increments.refresh(spark, SIZES, source, str(tmp_path))
    assert again == increments.Refresh(1, [], [])
    assert os.listdir(tmp_path / "sizes" / "rows") == ["1"]


def test_units_that_are_gone_take_their_minimum_along(spark, source, tmp_path):
    root = str(tmp_path)
    increments.refresh(spark, SIZES, source, root)
    sinks.overwrite(spark.createDataFrame([r for r in FIRST if r[0] != "02"], KIND), source, ["p"])
    done = increments.refresh(spark, SIZES, source, root)
    assert done.dropped == ["p=02"]
    assert ("a", 10, 1, 9, 2) in rows(increments.stored(spark, SIZES, source, root))


def test_stale_and_missing_summaries_are_refused(spark, source, tmp_path):
    root = str(tmp_path)
    with pytest.raises(MissingSummary):
        increments.stored(spark, SIZES, source, root)
    assert rows(increments.stored_or_live(spark, SIZES, source, root)) == rows(increments.live(spark, SIZES, source))
    increments.refresh(spark, SIZES, source, root)
    sinks.replace_partition(spark.createDataFrame([("01", "z", 1)], KIND), source, ["p"])
    with pytest.raises(StaleSummary, match="p=01"):
        increments.stored(spark, SIZES, source, root)
    assert ("z", 1, 1, 1, 1) in rows(increments.stored_or_live(spark, SIZES, source, root))


def test_an_unfinished_refresh_changes_nothing(spark, source, tmp_path):
    root, commits = str(tmp_path), tmp_path / "sizes" / "commits"
    increments.refresh(spark, SIZES, source, root)
    (commits / "2.json").write_text('{"version": 2, "uni')
    want = rows(increments.live(spark, SIZES, source))
    assert rows(increments.stored(spark, SIZES, source, root)) == want
    sinks.replace_partition(spark.createDataFrame([("01", "z", 1)], KIND), source, ["p"])
    assert increments.refresh(spark, SIZES, source, root).version == 3

    def fails(merged):
        return merged.withColumn("bad", F.raise_error(F.lit("lost")))

    sinks.replace_partition(spark.createDataFrame([("01", "y", 1)], KIND), source, ["p"])
    with pytest.raises(Exception, match="lost"):
        increments.refresh(spark, replace(SIZES, finish=fails), source, root)
    with pytest.raises(StaleSummary):
        increments.stored(spark, SIZES, source, root)
    assert increments.refresh(spark, SIZES, source, root).computed == ["p=01"]


def test_two_refreshes_at_once_cannot_both_commit(spark, tmp_path):
    increments._commit(spark, str(tmp_path / "1.json"), {"version": 1})
    with pytest.raises(Exception, match="(?i)exist"):
        increments._commit(spark, str(tmp_path / "1.json"), {"version": 1})


def test_another_definition_is_built_anew(spark, source, tmp_path):
    increments.refresh(spark, SIZES, source, str(tmp_path))
    other = replace(SIZES, version="2")
    with pytest.raises(MissingSummary):
        increments.stored(spark, other, source, str(tmp_path))
    assert len(increments.refresh(spark, other, source, str(tmp_path)).computed) == 4


def test_files_as_units_of_a_table_that_grows(spark, tmp_path):
    source, root, by_file = str(tmp_path / "t"), str(tmp_path), replace(SIZES, unit="file")
    for n in range(3):
        spark.createDataFrame([("a", n)], "k string, v int").coalesce(1).write.mode("append").parquet(source)
        done = increments.refresh(spark, by_file, source, root)
        assert len(done.computed) == 1 and done.version == n + 1
    assert rows(increments.stored(spark, by_file, source, root)) == [("a", 3, 0, 2, 3)]
    assert increments.fingerprints(spark, source, "folder").keys() == {""}


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    source, root = str(tmp_path / "t"), str(tmp_path)
    spark.createDataFrame([], "k string, v int").write.parquet(source)
    increments.refresh(spark, SIZES, source, root)
    assert rows(increments.stored(spark, SIZES, source, root)) == []


def test_states_are_put_together_and_old_ones_removed(spark, source, tmp_path, monkeypatch):
    monkeypatch.setattr(increments, "MOST_FOLDERS", 2)
    root = str(tmp_path)
    for n in range(4):
        sinks.replace_partition(spark.createDataFrame([(f"0{n}", "a", 10 + n)], KIND), source, ["p"])
        increments.refresh(spark, SIZES, source, root)
        assert rows(increments.stored(spark, SIZES, source, root)) == rows(increments.live(spark, SIZES, source))
    removed = increments.vacuum(spark, SIZES, root)
    assert "rows/1" in removed and "commits/1.json" in removed and any(x.startswith("states/") for x in removed)
    assert rows(increments.stored(spark, SIZES, source, root)) == rows(increments.live(spark, SIZES, source))
    assert increments.refresh(spark, SIZES, source, root) == increments.Refresh(4)
