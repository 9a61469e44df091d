"""Stored rows with JSON metadata, and an index of what their parts hold.

``rows`` has the metadata as VARIANT in ``parts`` folders, sorted by the metadata's text, so that alike
ones are together. ``values`` says which parts hold a scalar value under a path (``file.lang``, with
``[]`` for the elements of an array), in buckets of path and value. A containment filter is taken apart
into such pairs; only parts that hold all of them are read, and there every row is held against the
whole filter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial, reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a part, and buckets of values for each 64 parts.
PART, BUCKETS = 50_000, 8


def variant_contains(found: Column, wanted: object) -> Column:
    """Whether a VARIANT contains a value: an object one with all the wanted parts, an array one that
    has for each wanted element one which contains it, and a scalar an equal one of the same kind.
    Never null."""
    if isinstance(wanted, dict):
        is_object = F.coalesce(F.to_json(found).startswith("{"), F.lit(False))
        return reduce(and_, [variant_contains(F.try_variant_get(found, f'$["{k}"]', "variant"), v) for k, v in wanted.items()], is_object)
    if isinstance(wanted, (list, tuple)):
        each = F.try_variant_get(found, "$", "array<variant>")
        is_array = F.coalesce(F.to_json(found).startswith("["), F.lit(False))
        return reduce(and_, [F.coalesce(F.exists(each, partial(_contains, v)), F.lit(False)) for v in wanted], is_array)
    text = F.to_json(found)
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
        return F.coalesce(~text.startswith('"') & (text.try_cast("double") == float(wanted)), F.lit(False))
    return F.coalesce(text == json.dumps(wanted, ensure_ascii=False, separators=(",", ":")), F.lit(False))


def _contains(wanted: object, found: Column) -> Column:
    return variant_contains(found, wanted)


def scalars(value: object, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, value) of all scalars of a JSON value; equal numbers are written alike."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from scalars(v, f"{path}.{k}" if path else k)
    elif isinstance(value, (list, tuple)):
        for v in value:
            yield from scalars(v, f"{path}[]")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        yield path, repr(float(value))
    else:
        yield path, json.dumps(value, ensure_ascii=False)


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (part, path, value) of each batch; what isn't JSON has none."""
    for batch in batches:
        found = set()
        for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist(), strict=True):
            try:
                found.update((part, *x) for x in scalars(json.loads(text or "null")))
            except (ValueError, OverflowError, RecursionError):
                continue
        columns = list(zip(*sorted(found), strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string()), strict=True)], names=["part", "path", "value"])


def _bucket(path: Column, value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path, value), F.lit(buckets)).cast("int")


class MetadataIndex:
    """Rows in a folder, to be selected by what their metadata contain."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        about = spark.read.schema("parts int, buckets int").parquet(f"{folder}/about").first()
        self.parts, self.buckets = about.parts, about.buckets
        self.schema = spark.read.parquet(f"{folder}/rows").schema if self.parts else None

    @classmethod
    def build(cls, spark: SparkSession, rows: DataFrame, folder: str, part: int = PART) -> MetadataIndex:
        """Store ``rows`` (metadata, a JSON text, and any other columns but ``part``) in a new folder.
        Metadata that is null or isn't JSON becomes null and is contained in no filter but an empty one."""
        total = rows.count()
        parts = -(-total // part)
        buckets = max(1, BUCKETS * -(-parts // 64))
        if parts:
            # Ranges of the text and of a hash, so that rows that are all alike are many parts, too.
            order = [F.substring("metadata", 1, 200), F.xxhash64(*[c for c in rows.columns])]
            dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions("metadata").withColumn("part", F.spark_partition_id())
            stored = dealt.withColumn("text", F.col("metadata")).withColumn("metadata", F.try_parse_json("metadata"))
            stored.write.partitionBy("part").parquet(f"{folder}/rows")
            read = spark.read.parquet(f"{folder}/rows").select("part", "text")
            found = read.mapInArrow(_values, "part int, path string, value string").distinct().withColumn("bucket", _bucket(F.col("path"), F.col("value"), buckets))
            found.repartition("bucket").sortWithinPartitions("bucket", "path", "value").write.partitionBy("bucket").parquet(f"{folder}/values")
        spark.createDataFrame([(parts, buckets)], "parts int, buckets int").coalesce(1).write.parquet(f"{folder}/about")
        return cls(spark, folder)

    def parts_of(self, wanted: dict[str, object]) -> list[int] | None:
        """Parts that hold all scalars of a filter; None if it has none. No more than there are parts."""
        pairs = sorted(set(scalars(wanted)))
        if not pairs:
            return None
        asked = self.spark.createDataFrame(pairs, "path string, value string").withColumn("bucket", _bucket(F.col("path"), F.col("value"), self.buckets))
        buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]
        values = self.spark.read.schema("part int, path string, value string, bucket int").parquet(f"{self.folder}/values").where(F.col("bucket").isin(buckets))
        held = values.join(F.broadcast(asked.select("path", "value")), ["path", "value"]).groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") == len(pairs))
        return sorted(r.part for r in held.select("part").collect())

    def select(self, wanted: dict[str, object]) -> DataFrame:
        """The rows whose metadata contain the filter, metadata as VARIANT; an empty one leaves out nothing."""
        if not self.parts:
            return self.spark.createDataFrame([], "metadata variant")
        rows = self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows")
        if not wanted:
            return rows.drop("part", "text")
        parts = self.parts_of(wanted)
        rows = rows if parts is None else rows.where(F.col("part").isin(parts)) if parts else rows.where(F.lit(False))
        return rows.where(variant_contains(F.col("metadata"), wanted)).drop("part", "text")
