"""Tables in buckets of a key, of which a change rewrites only what it touches."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept

_BUCKET = "_bucket"


class KeyedTable:
    """A Parquet table of a schema, partitioned by buckets of a string or integer key. Reading some
    keys reads their buckets' files; files of other buckets keep their names whatever is changed.
    A null key is in the bucket of the empty string. The number of buckets is the table's for good."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _folder(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), where

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(self.buckets)).cast("int")

    def _rows(self) -> DataFrame:
        system, where = self._folder(self.path)
        schema = f"{self.schema}, {_BUCKET} int"
        return self.spark.read.schema(schema).parquet(self.path) if system.exists(where) else self.spark.createDataFrame([], schema)

    def read(self, *keys: object) -> DataFrame:
        """Rows of the keys, or all rows if none is given."""
        rows = self._rows()
        if keys:
            wanted = sorted({zlib.crc32(("" if k is None else str(k)).encode()) % self.buckets for k in keys})
            among = F.coalesce(F.col(self.key).isin([k for k in keys if k is not None]), F.lit(False))
            rows = rows.where(F.col(_BUCKET).isin(wanted) & (among | F.col(self.key).isNull() if None in keys else among))
        return rows.drop(_BUCKET)

    def append(self, rows: DataFrame) -> None:
        """Rows are dealt to their buckets first, so that a bucket gets files by its size, not one of
        every task."""
        rows.withColumn(_BUCKET, self._bucket(F.col(self.key))).hint("rebalance", _BUCKET).write.mode("append").partitionBy(_BUCKET).parquet(self.path)

    def change(self, keys: DataFrame, new: Callable[[DataFrame], DataFrame]) -> None:
        """Put what ``new`` makes of the rows of some buckets, those that the keys (a table with the
        key's column) lie in, in their place. It has to hand on the rows of other keys, and may add
        rows of these keys only. Files are written aside and moved in as a whole by the commit; a change that
        was cut short can be made again. Buckets without rows lose their folder afterwards."""
        touched = sorted(r.b for r in keys.select(self._bucket(F.col(self.key)).alias("b")).distinct().collect())
        old = self._rows()
        out = new(old.where(F.col(_BUCKET).isin(touched)).drop(_BUCKET)).select(*[c for c in old.columns if c != _BUCKET])
        out = kept(out.withColumn(_BUCKET, self._bucket(F.col(self.key))))
        filled = {r[0] for r in out.select(_BUCKET).distinct().collect()}
        if not filled <= set(touched):
            raise ValueError("rows of keys that weren't to be changed")
        out.hint("rebalance", _BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(self.path)
        for bucket in set(touched) - filled:
            system, where = self._folder(f"{self.path}/{_BUCKET}={bucket}")
            system.delete(where, True)
