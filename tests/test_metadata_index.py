from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sagebrook.operators.metadata_index import MetadataIndex, scalars, variant_contains

ROWS = "id long, metadata string"


def contained(found, wanted):
    """The same by plain Python."""
    if isinstance(wanted, dict):
        return isinstance(found, dict) and all(k in found and contained(found[k], v) for k, v in wanted.items())
    if isinstance(wanted, list):
        return isinstance(found, list) and all(any(contained(x, v) for x in found) for v in wanted)
    return type(found) in (int, float) and found == wanted if type(wanted) in (int, float) else type(found) is type(wanted) and found == wanted


def made(n):
    rng = random.Random(6)
    pick = lambda *x: rng.choice(x)
    rows = [{"file": {"name": f"f{i // 40}", "lang": pick("en", "de", None), "page": pick(1, 2.0, "1")}, "tags": [pick("a", "b", 3, True) for _ in range(i % 4)], "parts": [{"k": pick("x", "y"), "n": pick(1, 2), "in": [[pick(1, 2)], "é"]} for _ in range(i % 3)]} for i in range(n)]
    return [(i, json.dumps(r, ensure_ascii=i % 2 == 0)) for i, r in enumerate(rows)] + [(n, None), (n + 1, ""), (n + 2, "not json"), (n + 3, "[1]"), (n + 4, "{}"), (n + 5, '{"tags": 3}'), (n + 6, '{"a.b": 1, "quo te": 2}')]


FILTERS = [
    {}, {"file": {}}, {"file": {"name": "f3"}}, {"file": {"name": "f3", "lang": "en"}}, {"file": {"page": 2}}, {"file": {"page": "1"}}, {"file": {"lang": None}}, {"tags": ["a"]}, {"tags": ["a", "b"]}, {"tags": [3]},
    {"tags": [True]}, {"tags": []}, {"tags": 3}, {"parts": [{"k": "x"}]}, {"parts": [{"k": "x", "n": 2}, {"k": "y"}]}, {"parts": [{"in": [[1]]}]}, {"parts": [{"in": ["é", [2]]}]}, {"nothing": 1}, {"file": "f3"}, {"a.b": 1}, {"quo te": 2},
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = made(400)
    return rows, MetadataIndex.build(spark, spark.createDataFrame(rows, ROWS), f"file://{tmp_path_factory.mktemp('metadata')}/m", part=50)


def test_containment(spark, stored):
    rows, index = stored

    def loaded(text):
        try:
            return json.loads(text or "")
        except ValueError:
            return None

    table = spark.createDataFrame(rows, ROWS).select("id", F.try_parse_json("metadata").alias("m")).cache()
    for wanted in FILTERS:
        want = sorted(i for i, t in rows if not wanted or contained(loaded(t), wanted))
        assert sorted(r.id for r in index.select(wanted).select("id").collect()) == want, wanted
        if wanted:
            assert sorted(r.id for r in table.where(variant_contains(F.col("m"), wanted)).collect()) == want, wanted


def test_parts_are_pruned(spark, stored):
    _, index = stored
    assert index.parts == 9
    for wanted, most in (({"file": {"name": "f3"}}, 2), ({"file": {"name": "f3", "lang": "en"}}, 2), ({"nothing": 1}, 0)):
        assert len(index.parts_of(wanted)) <= most
        rows = index.select(wanted)
        if most:
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [" in plan.replace("PartitionFilters: []", "")
            assert rows.select(F.input_file_name()).distinct().count() <= most
    assert index.parts_of({"tags": []}) is None


def test_alike_and_empty(spark, tmp_path):
    alike = spark.createDataFrame([(i, '{"a": {"b": 1}}') for i in range(200)], ROWS)
    index = MetadataIndex.build(spark, alike, f"file://{tmp_path}/a", part=50)
    assert index.select({"a": {"b": 1.0}}).count() == 200 and index.select({"a": {"b": 2}}).count() == 0
    none = MetadataIndex.build(spark, alike.limit(0), f"file://{tmp_path}/b")
    assert none.select({"a": 1}).collect() == [] and none.parts == 0
    assert sorted(scalars({"a": [1, {"b": None}], "c": True})) == [("a[]", "1.0"), ("a[].b", "null"), ("c", "true")]
