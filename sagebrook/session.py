"""Sessions, settings and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Defaults of all operators; fixed values where a result depends on them."""

    chunk_size: int = 800
    chunk_overlap: int = 120
    candidates: int = 30
    rrf_k: int = 60
    rerank_top: int = 5
    rerank_chars: int = 1024
    context_chars: int = 12_000
    index_threshold: int = 100
    insert_batch: int = 100
    task_time_limit: int = 1200
    retention_seconds: int = 86_400
    default_language: str = "en"


#: Bytes of a batch that a Python worker gets, whose rows may be texts of any length.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def session(name: str = "sagebrook", **conf: str) -> SparkSession:
    """A session with what the engine relies on: UTC, adaptive plans, the last value of a repeated
    map key."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        _BATCH: str(BATCH_BYTES),
    }
    return SparkSession.builder.appName(name).config(map=base | conf).getOrCreate()


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """The session, able to checkpoint: to the cluster's folder, or, where none is named, as in
    tests on one machine, to a temporary one. Python workers get batches of BATCH_BYTES at most, or
    less where the session says so."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's, or, on one machine only, a
    temporary one. On a cluster that would lose data, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
