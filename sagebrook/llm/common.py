"""What the operators of this subpackage share: tables in the cluster's shared folder, broadcasts
behind a check of their size, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of narrow columns (ids, digests, counts) up to which a side is broadcast; some 50 MB at most.
BROADCAST_ROWS = 500_000

#: ``[^\x20\x09-\x0D]+`` in Java's syntax.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one is
    made and set on one machine; on a cluster that would lose data, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Bytes of a batch that a Python worker gets, whose rows may be texts of any length.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Python workers of the session get batches of BATCH_BYTES at most, or less where it says so."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


class Workspace:
    """Tables written under a folder of their own in the shared folder. They cut lineage, survive
    the loss of any executor, and are read again instead of being computed again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._saved: list[str] = []

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.folder}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "table", **options: str) -> DataFrame:
        path = self.path(name)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        self._saved.append(path)
        return out

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
        self._saved.remove(path)

    def drop(self, *saved: DataFrame) -> None:
        """Delete saved tables that nothing reads any more."""
        for df in saved:
            self._delete(df._workspace_path)

    def keep_only(self, *saved: DataFrame) -> None:
        """Delete all saved tables but these, which are all that results still read."""
        kept = {df._workspace_path for df in saved}
        for path in [p for p in self._saved if p not in kept]:
            self._delete(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the query that wrote them has ended; for queries whose results are
    saved, which is all that is read later."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before or "false")


def small(saved: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A saved table of narrow columns, marked for broadcast if it has no more than so many rows;
    else unchanged, and joins shuffle."""
    return F.broadcast(saved) if saved.count() <= rows else saved


def least_hashes(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of a saved table of narrow columns whose keys have the least hashes. Hashes are
    even over their range, so a bound on them leaves some two times n rows to be sorted, however
    many there are; if it should leave fewer than n, these are all that is taken."""
    total = df.count()
    hashed = F.shiftrightunsigned(F.xxhash64(key), 1)
    if total > 4 * n:
        df = df.where(hashed < int(2**63 * (2 * n / total)))
    return df.orderBy(hashed, key).limit(n)


#: Rows of one key from which on a join keeps them where they are.
HEAVY = 10_000


def joined(rows: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of a saved table (key, n, ...), one row for each key, where n is the
    number of rows with that key. Keys of very many rows don't meet in one task: they are looked up
    in a broadcast, which holds a row for HEAVY rows or more. A small table is broadcast whole."""
    if saved.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(saved), key)
    heavy = saved.where(F.col("n") >= HEAVY)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(saved.where(F.col("n") < HEAVY), key)
    return rows.join(F.broadcast(heavy), key).unionByName(light)


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two columns of one orderable type), where
    component is the smallest node that can be reached.

    Alternates large-star and small-star steps, in which every node passes the smallest node it
    knows to its larger, then to its smaller neighbours; the number of rounds grows with the
    logarithm of the longest chain, and is 0 for edges that are stars around their smallest nodes.
    Edges are saved after each step.
    """
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = ws.save(edges, "edges")
    while not _stars(edges):
        # Large star: u's larger neighbours are attached to the smallest node u knows.
        both = edges.union(edges.select("v", "u"))
        least = ws.save(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        large = joined(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = ws.save(large.distinct(), "large")
        # Small star: u and its smaller neighbours are attached to the smallest of them.
        low = ws.save(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        rest = joined(large, low.where("n > 1"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = ws.save(rest.union(low.select("u", "m")).distinct(), "edges")
        ws.drop(edges, least, large, low)
        edges = after
    roots = edges.select("v").distinct()
    return ws.save(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v")), "components")


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or hangs = 1 and holds = 1").isEmpty()
