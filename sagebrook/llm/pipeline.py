"""A training corpus from ``documents``: five stages, each applying one operator to all that the
stage before it kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents, whatever they
are. Rows are judged one by one, by their own texts, also those that share a doc_id or have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, minhash, mixing, pii, quality
from .common import Workspace, small


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts are judged like
    any others; of an empty table none are left."""
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _keyed(ws: Workspace, docs: DataFrame) -> DataFrame:
    """(doc, row): the rows of ``docs`` as structs, saved with a key of their own."""
    return ws.save(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")


def _texts(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))


def _without(keyed: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of (doc, row) but for those in a saved table (row)."""
    return keyed.join(small(dropped), "row", "left_anti").select("doc.*")


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id, one without a
    doc_id only if no other is there. Null and wordless texts have no duplicates and stay."""
    ws = Workspace(spark, "unique")
    keyed = _keyed(ws, docs)
    found = ws.save(minhash.near_duplicates(spark, _texts(keyed)).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), "components")
    groups = ws.save(found.where("row <> group").select("group").distinct(), "groups")
    members = found.join(small(groups), "group").join(keyed.select("row", F.col("doc.doc_id").cast("long").alias("doc_id")), "row")
    members = ws.save(members, "members")
    kept = members.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("kept")).select(F.col("kept.row").alias("row"))
    return _without(keyed, ws.save(members.select("row").join(kept, "row", "left_anti"), "dropped"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; null and wordless texts hold none."""
    ws = Workspace(spark, "uncontaminated")
    keyed = _keyed(ws, docs)
    found = decontaminate.contained_items(spark, _texts(keyed), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(keyed, ws.save(found.select(F.col("doc_id").alias("row")).distinct(), "dropped"))


def private_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts masked and n_chars as it is then."""
    return pii.masked(spark, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document: (doc_id, size, source_size, target, taken)."""
    return mixing.mix(spark, docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", unique),
    ("benchmark decontamination", uncontaminated),
    ("PII", private_data_masked),
    ("mixing sources", mixed),
]

#: The classifier and the random transfers of the mix can't be written as SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows of ``documents``. What a stage has read goes when its rows are saved."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name.split()[0])
        ws.keep_only(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
