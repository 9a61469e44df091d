"""Stored collections of vectors, and changes to stored tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .metadata_index import variant_contains

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def valid_name(name: str) -> str:
    """The name, if it is fit to stand in SQL; else an error."""
    if not _NAME.fullmatch(name or ""):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def collection_name(size: int, project_id: int) -> str:
    return f"collection_{size}_{project_id}"


class Collections:
    """All collections as one Parquet table, partitioned by embedding size and project, so that
    reading one reads only its files."""

    PARTS = ("embedding_size", "project_id")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _all(self) -> DataFrame:
        from ..schema import COLLECTION

        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = hadoop.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop)
        return self.spark.read.schema(COLLECTION).parquet(self.path) if there else self.spark.createDataFrame([], COLLECTION)

    def read(self, size: int, project_id: int) -> DataFrame:
        return self._all().where((F.col("embedding_size") == size) & (F.col("project_id") == project_id))

    def exists(self, size: int, project_id: int) -> bool:
        return not self.read(size, project_id).isEmpty()

    def names(self) -> DataFrame:
        rows = self._all().select(*self.PARTS).distinct()
        return rows.select(F.concat_ws("_", F.lit("collection"), *self.PARTS).alias("name"), *self.PARTS)

    def info(self, size: int, project_id: int) -> dict | None:
        n = self.read(size, project_id).count()
        return {"name": collection_name(size, project_id), "records": n} if n else None

    def insert(self, rows: DataFrame, size: int, project_id: int, *, reset: bool = False) -> None:
        """Append (or put in place of what is there) rows (id, text, vector, metadata, chunk_id).
        Every vector must have the collection's size; null metadata become an empty object."""
        wrong = rows.where("vector is null or chunk_id is null" + f" or size(vector) <> {int(size)}")
        if not wrong.isEmpty():
            raise ValueError("vectors without a record, or of another size")
        out = rows.select(
            F.col("id").cast("long"), "text", F.col("vector").cast("array<float>").alias("vector"), F.coalesce("metadata", F.lit("{}")).alias("metadata"),
            F.col("chunk_id").cast("long").alias("chunk_id"), F.lit(size).alias("embedding_size"), F.lit(project_id).cast("long").alias("project_id"),
        )
        writer = out.write.partitionBy(*self.PARTS).option("partitionOverwriteMode", "dynamic")
        writer.mode("overwrite" if reset else "append").parquet(self.path)

    def drop(self, size: int, project_id: int) -> None:
        part = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/embedding_size={size}/project_id={project_id}")
        part.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(part, True)

    def indexed_ids(self, size: int, project_id: int) -> DataFrame:
        return self.read(size, project_id).where("chunk_id is not null").select("chunk_id").distinct()


#: Kinds of stores; whatever has the methods of Collections can be added.
STORES: dict[str, type] = {"parquet": Collections}


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and those of ``rows`` whose keys it hasn't; the first of repeated ones by all columns."""
    new = rows.select(table.columns).dropDuplicates(keys)
    return table.unionByName(new.join(table.select(keys), keys, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows`` put in: their non-null values replace those of the same key."""
    new = rows.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in rows.columns if c != key])
    both = table.join(new, key, "full_outer")
    return both.select(*[F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in both.columns else F.col(c) for c in table.columns])


def updated(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    """``table`` with the values set where the condition holds."""
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def without(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


def page(table: DataFrame, order: str, number: int, size: int) -> DataFrame:
    """One page of a table in an order; pages count from 1."""
    return table.orderBy(order).offset((number - 1) * size).limit(size)


def contains(text: Column, wanted: dict[str, object]) -> Column:
    """Whether a JSON object contains the wanted one: of an object every part, of an array every
    element, of anything else the same value of the same kind. What isn't JSON contains nothing; an
    empty filter leaves out nothing."""
    if not wanted:
        return F.lit(True)
    return variant_contains(F.try_parse_json(text), wanted)


def lookup(table: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key."""
    return table.where(F.col(key) == F.lit(value))


def order_range(chunks: DataFrame, first: int, last: int) -> DataFrame:
    """The chunks (asset_id, chunk_order, ...) of each asset from one order to another, both included."""
    return chunks.where(F.col("chunk_order").between(first, last))


def file_totals(chunks: DataFrame, *files: str) -> DataFrame:
    """(files, chunks, characters): what each file has come to, of chunks with a text."""
    return chunks.groupBy(*files).agg(F.count("text").alias("chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))


def store(name: str | None, spark: SparkSession, path: str) -> Collections | None:
    """A store of vectors by the name of its kind; None if there is no such kind."""
    made = STORES.get((name or "").lower())
    return made(spark, path) if made else None


def upload_signal(file_type: Column, size: Column, types: list[str], most_mb: int) -> Column:
    return F.when(~file_type.isin(types) | file_type.isNull(), "file_type_not_supported").when(size > most_mb * 1048576, "file_size_exceeded").otherwise("file_validated_success")


def coverage(assets: DataFrame, chunks: DataFrame, indexed: DataFrame) -> DataFrame:
    """(project_id, chunk_count, asset_count, indexed_count, pending_count, fully_indexed) of assets
    (project_id, asset_id), chunks (project_id, asset_id, chunk_id) and indexed (asset_id)."""
    a = assets.join(indexed.select("asset_id").distinct().withColumn("_i", F.lit(1)), "asset_id", "left")
    a = a.groupBy("project_id").agg(F.count("*").alias("asset_count"), F.count("_i").alias("indexed_count"))
    c = chunks.groupBy("project_id").agg(F.count("chunk_id").alias("chunk_count"))
    rows = a.join(c, "project_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    rows = rows.withColumn("pending_count", F.greatest(F.lit(0), F.col("asset_count") - F.col("indexed_count")))
    rows = rows.withColumn("fully_indexed", (F.col("asset_count") > 0) & (F.col("indexed_count") >= F.col("asset_count")))
    return rows.select("project_id", "chunk_count", "asset_count", "indexed_count", "pending_count", "fully_indexed")


def fingerprint(asset_id: Column, asset_name: Column) -> Column:
    """An aggregate over a project's assets: changes when assets come or go."""
    parts = F.array_sort(F.collect_list(F.concat(asset_id.cast("string"), F.lit(":"), asset_name)))
    return F.when(F.count("*") == 0, "empty").otherwise(F.substring(F.sha2(F.array_join(parts, "|"), 256), 1, 16))
