"""The gate of tasks as a stream: which requests run follows from a state kept for each task."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .keyed import SECOND, by_key, named

UNDER_WAY = ("PENDING", "STARTED", "RETRY")


class Gate(StatefulProcessor):
    """State of a task: its status, when what is under way began, and the row that began it. A timer
    stands at the time from which that counts as stuck."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, began long, id long")

    def _due(self, began: int) -> int:
        """In microseconds: as ``should_execute``, in whole seconds."""
        return (began // SECOND + self.wait + 1) * SECOND

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        status, began, of = self.last.get() if self.last.exists() else (None, None, None)
        before = self._due(began) if status in UNDER_WAY else None
        for row in sorted(rows, key=lambda r: (r["_us"], r["_id"] is not None, r["_id"] or 0)):
            at, id_, said = row["_us"], row["_id"], row["_status"]
            if status in UNDER_WAY and at >= self._due(began):
                yield Row(**named(key), id=of, at=self._due(began), decision="stuck")
                status = "STUCK"
            if said is not None:
                status = said
            elif status == "SUCCESS" or status in UNDER_WAY:
                yield Row(**named(key), id=id_, at=at, decision="skip")
                continue
            else:
                status = "STARTED"
                yield Row(**named(key), id=id_, at=at, decision="run")
            if status in UNDER_WAY:
                began, of = at, id_
        after = self._due(began) if status in UNDER_WAY else None
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before // 1000)
            if after is not None:
                self.handle.registerTimer(after // 1000)
        self.last.update((status, began, of))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        status, began, of = self.last.get()
        if status in UNDER_WAY and self._due(began) // 1000 == expiredTimerInfo.getExpiryTimeInMs():
            self.last.update(("STUCK", began, of))
            yield Row(**named(key), id=of, at=self._due(began), decision="stuck")

    def close(self) -> None:
        pass


def decided(spark: SparkSession, source: str, schema, target: str, by: list[str], *, id: str, at: str, status: str, wait: int, late: str = "10 minutes", files: int = 1000) -> DataFrame:
    """(by, id, at, decision): what becomes of the rows of new files under ``source``, appended to
    ``target``, which is returned; called again, it goes on from where it was.

    A row whose status is null asks to run the task of its ``by``: that is ``run``, which starts it,
    unless it has succeeded or is under way; then it is ``skip``. Other rows report a status; one
    that says that the task is under way counts its time anew. What has been under way for more than
    ``wait`` seconds (see ``state.stuck_after``) is ``stuck``, once, with the id of the row that began
    it and the time from which it counts so, whether another row of the task comes or the watermark
    passes that time; a later request runs.

    Rows of a task go by time and id within a batch, of ``files`` files at most, and one task's rows
    of a batch are sorted in one Python worker. Rows that are ``late`` behind the newest row of the
    batches before are dropped, as are rows without a time. A null key is a key."""
    columns = {"_id": F.col(id).cast("long"), "_status": F.col(status)}
    out, _ = by_key(spark, source, schema, target, by, at, columns, Gate(wait), "id long, at long, decision string", late, files)
    return out.select(*by, "id", F.timestamp_micros("at").alias("at"), "decision")
