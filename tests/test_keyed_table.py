from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sagebrook.operators.catalog import upsert
from sagebrook.operators.keyed_table import KeyedTable


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def held(rows):
    return sorted(map(tuple, rows.collect()), key=repr)


@pytest.mark.parametrize("kind", ["string", "long"])
def test_changes_touch_their_buckets_only(spark, tmp_path, kind):
    schema = f"k {kind}, v long"
    named = (lambda i: i) if kind == "long" else (lambda i: f"ключ {i}")
    rows = [*((named(i % 40), i) for i in range(200)), (None, 7)]
    table = KeyedTable(spark, f"file://{tmp_path}/t", schema, "k", buckets=16)
    assert table.read().count() == 0 and table.read(named(1)).count() == 0
    table.append(spark.createDataFrame(rows, schema))
    assert held(table.read()) == sorted(rows, key=repr)
    assert held(table.read(named(3), None)) == sorted((r for r in rows if r[0] in (named(3), None)), key=repr)
    plan = table.read(named(3))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan.replace("isnotnull(_bucket", "_bucket")

    before, key = files(tmp_path / "t"), spark.createDataFrame([(named(3),)], f"k {kind}")
    bucket = table.read().where(F.col("k") == named(3)).select(table._bucket(F.col("k"))).first()[0]
    table.change(key, lambda old: old.where((F.col("k") != named(3)) | F.col("k").isNull()))
    rows = [r for r in rows if r[0] != named(3)]
    after = files(tmp_path / "t")
    assert held(table.read()) == sorted(rows, key=repr)
    changed = {f.split("/")[0] for f in before.keys() ^ after.keys()}
    assert changed == {f"_bucket={bucket}"} and all(before[f] == after[f] for f in before.keys() & after.keys())

    # All keys of a bucket go, and come back; what isn't to be changed can't be.
    others = table.read().where(table._bucket(F.col("k")) == bucket).select("k").distinct().union(key).checkpoint()
    gone = {r.k for r in others.collect()}
    table.change(others, lambda old: old.limit(0))
    assert held(table.read()) == sorted((r for r in rows if r[0] not in gone), key=repr) and not (tmp_path / f"t/_bucket={bucket}").exists()
    table.change(key, lambda old: upsert(old, spark.createDataFrame([(named(3), 1)], schema), "k"))
    assert held(table.read(named(3))) == [(named(3), 1)]
    with pytest.raises(ValueError):
        table.change(key, lambda old: old.union(spark.createDataFrame([(named(i), 1) for i in range(40)], schema)))
    assert held(table.read(named(3))) == [(named(3), 1)]


def test_empty(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k long, v long", "k")
    nothing = spark.createDataFrame([], "k long, v long")
    table.change(nothing, lambda old: old)
    table.append(nothing)
    assert table.read().count() == 0
