"""Retention as a stream: what hasn't been heard of for some time leaves the state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .keyed import SECOND, by_key, named


class Keeper(StatefulProcessor):
    """State of a key: its first and newest time and the number of its rows. A timer stands behind
    the time up to which it is kept; then its state is cleared."""

    def __init__(self, seconds: int):
        self.kept = seconds * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first long, last long, n long")

    def _until(self, last: int) -> int:
        """The first millisecond at which the key has expired."""
        return (last + self.kept) // 1000 + 1

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first, last, n = self.seen.get() if self.seen.exists() else (None, None, 0)
        before = self._until(last) if n else None
        for at in sorted(r["_us"] for r in rows):
            if n and at > last + self.kept:
                yield Row(**named(key), first_at=first, last_at=last, n=n)
                n = 0
            first, last, n = (min(first, at), max(last, at), n + 1) if n else (at, at, 1)
        if (after := self._until(last)) != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(after)
        self.seen.update((first, last, n))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        first, last, n = self.seen.get()
        if self._until(last) == expiredTimerInfo.getExpiryTimeInMs():
            self.seen.clear()
            yield Row(**named(key), first_at=first, last_at=last, n=n)

    def close(self) -> None:
        pass


def expired(spark: SparkSession, source: str, schema, target: str, by: list[str], *, at: str, seconds: int, late: str = "10 minutes", files: int = 1000) -> tuple[DataFrame, list]:
    """(by, first_at, last_at, n): each key of the rows of new files under ``source`` that no row has
    named for more than ``seconds``, with its first and last time and the number of its rows since it
    came (again), appended to ``target`` as it expires; and the progress of this call's batches, with
    the size of the state. Called again, it goes on from where it was.

    The state holds no key for longer than ``seconds`` behind the watermark, so its size depends on
    how many keys that time has, not on the length of the stream. A key expires when a later row of
    it comes or when the watermark has passed it, with the same result. Times of one key are sorted in
    one Python worker, those of a batch of ``files`` files at a time. Rows that are ``late`` behind the
    newest row of the batches before are dropped, as are rows without a time. A null key is a key."""
    out, progress = by_key(spark, source, schema, target, by, at, {}, Keeper(seconds), "first_at long, last_at long, n long", late, files)
    return out.select(*by, F.timestamp_micros("first_at").alias("first_at"), F.timestamp_micros("last_at").alias("last_at"), "n"), progress
