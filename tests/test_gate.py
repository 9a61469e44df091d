from __future__ import annotations

import random
from datetime import datetime, timedelta

from sagebrook.streaming import gate, retention

SCHEMA = "task string, args long, n long, at timestamp, status string, id string"
START = datetime(2024, 1, 1)
WAIT = 100


def made(n=300, seed=3):
    rng, at, rows = random.Random(seed), START, []
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 0.4, 7, 30, 90]))
        status = rng.choice([None, None, None, None, "FAILURE", "RETRY", "PENDING", "REVOKED", *["SUCCESS"] * (rng.random() < 0.3)])
        rows.append((rng.choice(["a", "b", None]), rng.choice([1, 2]), i, at, status, "x"))
    return rows


def expected(rows, last):
    """Row by row, in order of time; ``last`` is how far the watermark comes."""
    out, state = [], {}

    def overdue(key, at):
        status, began, of = state.get(key, (None, None, None))
        if status in gate.UNDER_WAY:
            due = began.replace(microsecond=0) + timedelta(seconds=WAIT + 1)
            if at >= due:
                out.append((*key, of, due, "stuck"))
                state[key] = ("STUCK", began, of)

    for task, args, n, at, status, _ in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[3], r[2])):
        key = (task, args)
        overdue(key, at)
        now = state.get(key, (None, None, None))
        if status is None:
            run = now[0] not in ("SUCCESS", *gate.UNDER_WAY)
            out.append((*key, n, at, "run" if run else "skip"))
            if run:
                state[key] = ("STARTED", at, n)
        else:
            state[key] = (status, at, n) if status in gate.UNDER_WAY else (status, *now[1:])
    for key in list(state):
        overdue(key, last)
    return sorted(out, key=repr)


def decided(spark, folder, wait=WAIT):
    out = gate.decided(spark, f"{folder}/in/*", spark.createDataFrame([], SCHEMA).schema, f"{folder}/out", ["task", "args"], id="n", at="at", status="status", wait=wait, late="60 seconds")
    return sorted(map(tuple, out.collect()), key=repr)


def test_restarts_equal_the_plain_rules(spark, tmp_path):
    """Three parts, each taken by a stream that goes on from the checkpoint; rows in any order within
    a part, one late row and one without a time, repeated calls without new rows."""
    rows = made()
    last = rows[-1][3] - timedelta(seconds=60)
    for i, part in enumerate((rows[:120], rows[120:130], rows[130:])):
        part = part[::-1]
        if i == 2:
            part = [*part, ("a", 1, 999, START, None, "late"), ("a", 1, 998, None, None, "no time")]
        spark.createDataFrame(part, SCHEMA).coalesce(2).write.parquet(f"file://{tmp_path}/in/{i}")
        found = decided(spark, f"file://{tmp_path}")
    want = expected(rows, last)
    assert found == want and decided(spark, f"file://{tmp_path}") == want
    assert {w[-1] for w in want} == {"run", "skip", "stuck"}


def test_nothing_and_one_batch(spark, tmp_path):
    rows = made(80, 5)
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/in/0")
    assert decided(spark, f"file://{tmp_path}") == []
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/in/1")
    assert decided(spark, f"file://{tmp_path}") == expected(rows, rows[-1][3] - timedelta(seconds=60))


def test_what_is_not_heard_of_expires(spark, tmp_path):
    """The state stays small however long the stream is, whatever comes late; against plain rules."""
    rng, rows, sizes, found = random.Random(4), [], [], []
    for i in range(6):
        part = [(k, START + timedelta(seconds=1000 * i + rng.randrange(1000))) for k in [*range(20 * i, 20 * i + 20), *rng.choices(range(20 * i + 20), k=15), None]]
        rows += part
        late = [(999, START), (1, None)] if i == 4 else []
        spark.createDataFrame([*part[::-1], *late], "k long, at timestamp").coalesce(2).write.parquet(f"file://{tmp_path}/in/{i}")
        out, progress = retention.expired(spark, f"file://{tmp_path}/in/*", spark.createDataFrame([], "k long, at timestamp").schema, f"file://{tmp_path}/out", ["k"], at="at", seconds=700, late="900 seconds")
        sizes.append(progress[-1]["stateOperators"][0]["numRowsTotal"])
        found = sorted(map(tuple, out.collect()), key=repr)
    want, alive = [], {}
    for k, at in sorted(rows, key=lambda r: r[1]):
        if k in alive and at > alive[k][1] + timedelta(seconds=700):
            want.append((k, *alive.pop(k)))
        first, _, n = alive.get(k, (at, at, 0))
        alive[k] = (first, at, n + 1)
    last = max(at for _, at in rows) - timedelta(seconds=900)
    want += [(k, *v) for k, v in alive.items() if v[1] + timedelta(seconds=700) < last]
    assert found == sorted(want, key=repr) and len(want) > 100
    assert max(sizes[3:]) <= 1.5 * max(sizes[:3])  # 121 keys in all
