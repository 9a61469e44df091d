"""Incremental work as streams: indexing what is new, the newest state of tasks, and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import own_folder


def index_new(spark: SparkSession, source: str, schema, target: str, key: str, prepare=lambda df: df) -> DataFrame:
    """Append the rows of new files under ``source`` to ``target`` that aren't there yet by ``key``,
    and return the target. Each batch is taken once: the stream's checkpoint says which files are
    done, and the anti-join leaves out what a batch that was cut short had stored."""

    def store(batch: DataFrame, _: int) -> None:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(target)
        there = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop)
        new = prepare(batch).dropDuplicates([key])
        if there:
            new = new.join(spark.read.parquet(target).select(key), key, "left_anti")
        new.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{target}-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


def retained_counts(spark: SparkSession, source: str, schema, at: str, by: str, now: Column, seconds: int) -> DataFrame:
    """(by, kept, expired): per group how many rows of a stream the retention keeps, as a complete
    streaming aggregation written to a table of the last state."""
    rows = spark.readStream.schema(schema).parquet(source).withColumn("_old", F.col(at).cast("timestamp") < now - F.make_dt_interval(secs=F.lit(seconds)))
    counts = rows.groupBy(by).agg(F.count(F.when(~F.col("_old"), 1)).alias("kept"), F.count(F.when(F.col("_old"), 1)).alias("expired"))
    folder = own_folder(spark, "stream")

    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state")

    counts.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/state")
