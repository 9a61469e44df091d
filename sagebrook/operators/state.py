"""Task ledger, retention, chat history and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

#: Upper bounds of latency buckets in seconds; fixed values.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def args_hash(task_name: Column, args: dict[str, Column]) -> Column:
    """SHA-256 of the arguments and the task's name as JSON with sorted keys. Values are columns of
    JSON text (``json_text`` makes it of strings)."""
    every = sorted((args | {"task_name": json_text(task_name)}).items())
    parts = [p for i, (k, v) in enumerate(every) for p in (F.lit(f'{", " if i else ""}"{k}": '), F.coalesce(v.cast("string"), F.lit("null")))]
    return F.sha2(F.concat(F.lit("{"), *parts, F.lit("}")), 256)


def json_text(text: Column) -> Column:
    """A string as JSON in ASCII: everything beyond is escaped as UTF-16 units."""
    quoted = F.to_json(F.struct(text.alias("x")))
    body = F.regexp_replace(F.substring(quoted, 6, 1 << 30), r"\}$", "")
    units = F.transform(F.split(body, ""), lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.concat(F.lit("\\u"), F.lower(F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "(....)(....)", "$1\\\\u$2")))))
    return F.when(text.isNotNull(), F.array_join(units, ""))


def latest(ledger: DataFrame, keys: list[str], by: str, *ties: str) -> DataFrame:
    """The row with the greatest ``by`` of each key; of equal ones that with the greatest ``ties``,
    and then the greatest of all other columns that can be compared."""
    rest = [c for c in ledger.columns if c not in (*keys, by, *ties) and not isinstance(ledger.schema[c].dataType, (MapType, VariantType))]
    at = Window.partitionBy(*keys).orderBy(F.desc(by), *[F.desc(c) for c in (*ties, *rest)])
    return ledger.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def stuck_after(time_limit: int) -> int:
    return min(120, max(90, time_limit // 5))


def should_execute(status: Column, started_at: Column, now: Column, time_limit: int = 1200) -> Column:
    """Whether a task runs, given its last record: not after success; while under way only if it
    started so long ago that it must be stuck (a start that isn't known doesn't count as long)."""
    waited = F.unix_micros(now) - F.unix_micros(started_at)  # parts of a second count
    return (
        F.when(status.isNull(), True)
        .when(status == "SUCCESS", False)
        .when(status.isin("PENDING", "STARTED", "RETRY"), F.coalesce(waited > stuck_after(time_limit) * 1_000_000, F.lit(False)))
        .otherwise(True)
    )


def with_status(ledger: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """``ledger`` with the statuses and results of ``updates`` (execution_id, status, result)."""
    new = updates.select("execution_id", F.col("status").alias("_s"), F.col("result").alias("_r"))
    rows = ledger.join(new, "execution_id", "left")
    done = F.col("_s").isin("SUCCESS", "FAILURE")
    rows = rows.withColumn("completed_at", F.when(done, now).otherwise(F.col("completed_at")))
    rows = rows.withColumn("status", F.coalesce("_s", "status")).withColumn("result", F.coalesce("_r", "result"))
    return rows.select(ledger.columns)


def retained(ledger: DataFrame, at: str, now: Column, seconds: int) -> DataFrame:
    """Rows that aren't older than the retention time."""
    return ledger.where(F.col(at) >= now - F.make_dt_interval(secs=F.lit(seconds)))


def last_messages(chat: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last n messages of each session, with their place from the oldest on."""
    back = Window.partitionBy(by).orderBy(F.desc(order))
    rows = chat.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= n).drop("_n")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.asc(order))))


def history(chat: DataFrame, by: str, order: str, mode: str, follow_up: Column, *, turns: int = 4, user: str = "user") -> DataFrame:
    """The earlier messages that go with a question: none (minimal), all (full), the last user turns
    (user_only), or, as auto, the last two user turns if ``follow_up``."""
    if mode == "full":
        return chat
    if mode == "minimal":
        return chat.limit(0)
    rows = chat.where(F.col("role") == user)
    if mode != "user_only":
        rows, turns = rows.where(follow_up), 2
    at = Window.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= turns).drop("_n")


def counter(rows: DataFrame, *labels: str) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count("*").alias("total"))


def histogram(rows: DataFrame, value: Column, *labels: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """For each label and upper bound the number of values up to it (the last bound is infinite),
    with the sum and number of all."""
    counts = [F.count(F.when(value <= b, 1)) for b in bounds]
    wide = rows.where(value.isNotNull()).groupBy(*labels).agg(F.array(*counts, F.count("*")).alias("_c"), F.sum(value).alias("total"), F.count("*").alias("n"))
    names = F.array(*[F.lit(str(b)) for b in bounds], F.lit("+Inf"))
    each = wide.select(*labels, "total", "n", F.explode(F.arrays_zip(names.alias("le"), F.col("_c").alias("cumulative"))).alias("_b"))
    return each.select(*labels, F.col("_b.le").alias("le"), F.col("_b.cumulative").alias("cumulative"), "total", "n")


def best_setting(measured: DataFrame, setting: Column, cost: Column, *by: str) -> DataFrame:
    """(by, setting, cost): of each group's measured settings the cheapest; of equal ones the least."""
    best = F.min(F.struct(cost.alias("cost"), setting.alias("setting")))
    return measured.groupBy(*by).agg(best.alias("best")).select(*by, F.col("best.setting").alias("setting"), F.col("best.cost").alias("cost"))


def statuses(ledger: DataFrame) -> DataFrame:
    """(execution_id, task_name, status, result, started_at, completed_at): each task as it is now."""
    rows = latest(ledger, ["execution_id"], "updated_at")
    return rows.select("execution_id", "task_name", "status", "result", "started_at", "completed_at")


def cleared(chat: DataFrame, session_id: str) -> DataFrame:
    """A chat without one session."""
    return chat.where(~F.coalesce(F.col("session_id") == session_id, F.lit(False)))
