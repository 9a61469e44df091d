"""Streams with a state and timers for each key, from files to a table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Microseconds.
SECOND = 1_000_000


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, as timers want it."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def named(key: Any) -> dict[str, Any]:
    """A key as columns of an output row."""
    return {f"_k{i}": k for i, k in enumerate(key)}


def by_key(spark: SparkSession, source: str, schema, target: str, by: list[str], at: str, columns: dict[str, Column], processor: StatefulProcessor, output: str, late: str, files: int) -> tuple[DataFrame, list]:
    """Rows of new files under ``source`` as (key, _us: the time ``at`` in microseconds, columns) through
    ``processor``, whose rows (key, output) are appended to ``target`` once, whatever fails; and the
    progress of this call's batches. Rows without a time, or ``late`` behind the newest row of the
    batches before, are dropped. A null key is a key."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    names = [f"_k{i}" for i in range(len(by))]
    time = F.col(at).cast("timestamp")
    rows = rows.select(*[F.col(k).alias(n) for n, k in zip(names, by, strict=True)], time.alias("_at"), F.unix_micros(time).alias("_us"), *[c.alias(n) for n, c in columns.items()])
    types = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    timed = rows.where("_at is not null").withWatermark("_at", late).groupBy(*names)
    out = timed.transformWithState(processor, f"{types}, {output}", "append", "EventTime").withColumnsRenamed(dict(zip(names, by, strict=True)))
    with rocks_state(spark):
        stream = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target}-progress").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(out.schema).parquet(target), list(stream.recentProgress)
