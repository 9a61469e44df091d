"""Rows of a query and of its SQL, in a form that can be compared."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "tolist"):
        value = value.tolist()
    return [plain(v) for v in value] if isinstance(value, list) else value


def rows(columns: list[str], data) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def by_sql(sql: str, sf_dir: str) -> tuple[list[str], list[str]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    names = list(found.columns)
    return sorted(names), rows(names, found.fetchall())


def by_spark(df) -> tuple[list[str], list[str]]:
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])
