"""Queries on files, collections, stored tables and their statistics, and their SQL. What is stored is
derived from the given tables, under a folder of its own in the shared one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog, state
from .operators.keyed_table import KeyedTable
from .operators.metadata_index import MetadataIndex
from .registry import query, table
from .session import own_folder
from .sources import files


@query("""SELECT 'c_custkey: ' || c_custkey::VARCHAR || E'\\nc_name: ' || trim(c_name) || E'\\nc_mktsegment: ' || trim(c_mktsegment) AS text, 'csv' AS source_type FROM customer""")
def csv_records(spark: SparkSession, d: str) -> DataFrame:
    folder = own_folder(spark, "files")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(folder)
    return files.with_metadata(files.load_csv(spark, folder)).select("text", "source_type")


@query("SELECT source, 'txt' AS source_type, max(doc_id)::VARCHAR AS text FROM documents WHERE source IS NOT NULL GROUP BY source")
def text_records(spark: SparkSession, d: str) -> DataFrame:
    """A .txt file for each source."""
    folder = own_folder(spark, "files")
    rows = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.max("doc_id").cast("string").alias("text"))
    rows.write.partitionBy("source").text(folder)
    found = files.with_metadata(files.load_text(spark, folder))
    return found.select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "source_type", F.btrim("text", F.lit("\n")).alias("text"))


@query("SELECT 'csv' AS source_type, count(*) AS records FROM nation UNION ALL SELECT 'txt', count(DISTINCT r_regionkey) FROM region")
def files_by_extension(spark: SparkSession, d: str) -> DataFrame:
    folder = own_folder(spark, "files")
    table(spark, d, "nation").write.option("header", True).csv(f"{folder}/nation")
    table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("text")).write.partitionBy("r_regionkey").text(f"{folder}/region")
    table(spark, d, "region").write.json(f"{folder}/other")
    return files.with_metadata(files.load(spark, folder)).groupBy("source_type").agg(F.count("*").alias("records"))


def _collections(spark: SparkSession, d: str) -> catalog.Collections:
    """The vectors of even and of odd labels as two projects' collections, and a third that is dropped."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("").alias("text"), F.col("embedding").alias("vector"), F.lit(None).cast("string").alias("metadata"), F.col("vec_id").alias("chunk_id"), "label")
    size = rows.agg(F.max(F.size("vector"))).first()[0]
    made = catalog.store("parquet", spark, own_folder(spark, "collections"))
    for project in (0, 1, 2):
        made.insert(rows.where(F.col("label") % 2 == project % 2).drop("label"), size, project)
    made.drop(size, 2)
    return made


@query("SELECT DISTINCT 'collection_' || len(embedding)::VARCHAR || '_' || (label % 2)::VARCHAR AS name, len(embedding)::INT AS embedding_size, (label % 2)::BIGINT AS project_id FROM embeddings")
def list_collections(spark: SparkSession, d: str) -> DataFrame:
    return _collections(spark, d).names()


@query("SELECT label % 2 AS project, count(*) AS records, count(DISTINCT vec_id) AS ids FROM embeddings GROUP BY ALL")
def collection_info(spark: SparkSession, d: str) -> DataFrame:
    made = _collections(spark, d)
    names = [(r.embedding_size, r.project_id) for r in made.names().collect()]  # the two of them
    rows = [(project, made.info(size, project)["records"], made.indexed_ids(size, project).count()) for size, project in names if made.exists(size, project)]
    return spark.createDataFrame(rows, "project long, records long, ids long")


@query("SELECT conv_id, turn, role FROM conversations WHERE turn BETWEEN 2 AND 5")
def chunk_order_range(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("asset_id"), F.col("turn").alias("chunk_order"), "role")
    return catalog.order_range(rows, 2, 5).select(F.col("asset_id").alias("conv_id"), F.col("chunk_order").alias("turn"), "role")


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)")
def chunk_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return catalog.lookup(rows, "doc_id", rows.agg(F.max("doc_id")).first()[0])


@query("SELECT conv_id, count(text) AS chunks, coalesce(sum(length(text)), 0)::BIGINT AS characters FROM conversations GROUP BY conv_id")
def file_totals(spark: SparkSession, d: str) -> DataFrame:
    return catalog.file_totals(table(spark, d, "conversations"), "conv_id")


@query("SELECT event_type, user_id % 5 AS project, count(*) AS total FROM events GROUP BY ALL")
def retrieval_counter(spark: SparkSession, d: str) -> DataFrame:
    return state.counter(table(spark, d, "events").withColumn("project", F.col("user_id") % 5), "event_type", "project")


@query("SELECT event_type IN ('error', 'signup') AS without_context, count(*) AS total FROM events GROUP BY ALL")
def outcome_counter(spark: SparkSession, d: str) -> DataFrame:
    return state.counter(table(spark, d, "events").withColumn("without_context", F.col("event_type").isin("error", "signup")), "without_context")


@query("""
WITH m AS (SELECT user_id, event_type, round(avg(value), 6) AS cost FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT user_id, event_type AS setting, cost FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cost, event_type) = 1""")
def best_setting(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest of each user's kinds of events, by what they cost on average."""
    measured = table(spark, d, "events").where("value is not null").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("cost"))
    return state.best_setting(measured, F.col("event_type"), F.col("cost"), "user_id")


@query("""
SELECT event_id AS execution_id, CASE WHEN user_id % 3 = 0 THEN 'SUCCESS' ELSE 'STARTED' END AS status FROM events""")
def task_status(spark: SparkSession, d: str) -> DataFrame:
    begun = table(spark, d, "events").select(F.col("event_id").alias("execution_id"), F.lit("index").alias("task_name"), "user_id", F.lit("STARTED").alias("status"), F.lit(None).cast("string").alias("result"), F.col("ts").cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"))
    begun = begun.withColumn("updated_at", F.col("started_at"))
    later = F.col("started_at") + F.make_dt_interval(secs=F.lit(5))
    ended = begun.where("user_id % 3 = 0").withColumns({"status": F.lit("SUCCESS"), "completed_at": later, "updated_at": later})
    return state.statuses(begun.unionByName(ended)).select("execution_id", "status")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id <> (SELECT min(conv_id) FROM conversations)")
def clear_chat(spark: SparkSession, d: str) -> DataFrame:
    chat = table(spark, d, "conversations").withColumn("session_id", F.col("conv_id").cast("string"))
    first = chat.agg(F.min("conv_id")).first()[0]
    return state.cleared(chat, str(first)).select("conv_id", "turn")


@query("SELECT conv_id, turn, role, CASE WHEN conv_id % 50 = 1 THEN 'forgotten' ELSE text END AS text FROM conversations WHERE conv_id IS NULL OR conv_id % 50 <> 0")
def chats_changed(spark: SparkSession, d: str) -> DataFrame:
    """Of stored chats some are cleared and others overwritten, in their buckets only."""
    chats = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    stored = KeyedTable(spark, own_folder(spark, "chats"), "conv_id long, turn long, role string, text string", "conv_id")
    stored.append(chats)
    gone, told = (chats.where(f"conv_id % 50 = {n}").select("conv_id").distinct() for n in (0, 1))
    stored.change(gone, lambda old: old.join(gone, "conv_id", "left_anti"))
    stored.change(told, lambda old: old.withColumn("text", F.when(F.col("conv_id") % 50 == 1, "forgotten").otherwise(F.col("text"))))
    return stored.read()


@query("""
SELECT doc_id FROM documents WHERE source = 'src1' AND lang = 'en' AND doc_id % 3 = 1""")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    """A text, a number within an object, and an element of an array; a number isn't its text."""
    own = F.to_json(F.struct("source", F.struct((F.col("doc_id") % 3).alias("rest"), (F.col("doc_id") % 3).cast("string").alias("text")).alias("of"), F.array(F.lit("x"), "lang").alias("tags")))
    held = catalog.contains(own, {"source": "src1", "of": {"rest": 1, "text": "1"}, "tags": ["en"]}) & ~catalog.contains(own, {"of": {"text": 1}})
    return table(spark, d, "documents").where(held).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source = 'src1' AND lang = 'en' AND doc_id % 7 = 3")
def metadata_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows by two levels of objects and an object within an array, read from the parts that
    can hold them."""
    kinds = F.array(*[F.struct(F.lit(n).alias("of"), (F.col("doc_id") % n).alias("rest")) for n in (5, 7)])
    own = F.to_json(F.struct(F.struct("source", F.struct("lang").alias("said")).alias("file"), kinds.alias("kinds")))
    rows = table(spark, d, "documents").select("doc_id", own.alias("metadata"))
    stored = MetadataIndex.build(spark, rows, own_folder(spark, "metadata"), part=max(50, rows.count() // 64))
    return stored.select({"file": {"source": "src1", "said": {"lang": "en"}}, "kinds": [{"of": 7, "rest": 3}]}).select("doc_id")


@query("SELECT DISTINCT s_name AS name, s_suppkey AS id FROM supplier ORDER BY name, id LIMIT 20")
def projects_by_name(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")).distinct()
    return catalog.page(rows.withColumn("_o", F.struct("name", "id")), "_o", 1, 20).drop("_o")
