"""One JSON array read by many tasks: equal to the whole parse for any text and any split."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql.types import StringType, StructField, StructType

from demarca.sources import json_arrays, registry

KEYS = st.sampled_from(["a", "b", "{", "}", '"', "\\", "é", "k }{"])
TEXTS = st.text(alphabet='ab}{][",:\\ \n/é\U0001f600', max_size=12)
VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | TEXTS,
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(KEYS, inner, max_size=3),
    max_leaves=6,
)
OBJECTS = st.lists(st.dictionaries(KEYS, VALUES, max_size=4), max_size=12)


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "37b", "spark.sql.files.openCostInBytes": "1b"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def read(spark, path):
    return sorted((json.loads(r.value) for r in json_arrays.array_objects(spark, str(path)).collect()), key=repr)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=OBJECTS, indent=st.sampled_from([None, 0, 3]), ascii_only=st.booleans(), mark=st.booleans())
def test_equal_to_a_whole_parse(spark, small_splits, tmp_path, data, indent, ascii_only, mark):
    path = tmp_path / "x.json"
    text = json.dumps(data, indent=indent, ensure_ascii=ascii_only)
    path.write_bytes((b"\xef\xbb\xbf" if mark else b"") + b" \n" + text.encode() + b"\n ")
    assert read(spark, path) == sorted(data, key=repr)


def test_objects_longer_than_many_splits(spark, small_splits, tmp_path):
    data = [{"a": "x}" * 300}, {"b": [{"c": '{"'}] * 50}, {}, {"d": "}" * 400 + "\\"}]
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps([*data, {"file": k}]))
    assert json_arrays.pieces(spark, [str(tmp_path)]).rdd.getNumPartitions() > 30
    assert read(spark, tmp_path) == sorted(data * 3 + [{"file": k} for k in range(3)], key=repr)


def test_one_large_array_goes_to_many_tasks(spark, tmp_path):
    path = tmp_path / "large.json"
    with open(path, "w") as f:
        f.write("[" + ",\n".join(json.dumps({"CLEE": f"{n:020d}", "Nombre": 'a "b" {c}' * 8, "Id": str(n)}) for n in range(60_000)) + "]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        found = json_arrays.array_objects(spark, str(path))
        assert found.rdd.getNumPartitions() > 8
        rows = registry.read_registry(spark, str(path)).select("CLEE", "Nombre", "Id").distinct()
        whole = spark.read.schema(registry.text_schema(registry.REGISTRY)).option("multiLine", True).json(str(path))
        assert rows.count() == 60_000 and rows.exceptAll(whole.select("CLEE", "Nombre", "Id")).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_values_become_text(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text('[{"a": "1.50", "b": {"c": [1, "x"]}}, {"a": null, "z": 1}, {"b": true, "a": "t\\u00e9\\n}"}, {"a": 1.50}, {}]')
    schema = StructType([StructField(n, StringType()) for n in "ab"])
    got = sorted((tuple(r) for r in json_arrays.read_json_arrays(spark, str(path), schema).collect()), key=repr)
    none = (None, None)
    assert got == sorted([("1.50", '{"c":[1,"x"]}'), none, ("té\n}", "true"), ("1.5", None), none], key=repr)


@pytest.mark.parametrize(
    "text",
    ['{"a": 1}', '[{"a": 1}', '[{"a": "1}]', '[{"a": 1}] x', '[1, {"a": 1}]', '[{"a": 1}, "b"]', "[[{}]]", '[{"a": 1}]}}', "x[{}]", '[{"a": [1}]'],
)
def test_other_texts_raise(spark, small_splits, tmp_path, text):
    path = tmp_path / "x.json"
    path.write_text(text)
    with pytest.raises(Exception, match="array"):
        json_arrays.array_objects(spark, str(path)).collect()


def test_empty_array_and_empty_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(" [ ]\n")
    (tmp_path / "b.json").write_text("")
    assert read(spark, tmp_path) == []
