"""Comparing a Spark query with its plain-SQL counterpart."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from tablegauge.plans.oracle import SOURCES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in SOURCES:
        connection.execute(
            f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(frame, connection, sql: str) -> str | None:
    """What differs between the two results, or None."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = _bag(names, cursor.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} instead of {sorted(names)}"
    actual = _bag(frame.columns, [tuple(row) for row in frame.collect()])
    if actual == expected:
        return None
    extra, missing = actual - expected, expected - actual
    return (
        f"{sum(actual.values())} rows instead of {sum(expected.values())};\n"
        f"  only here: {list(extra)[:3]}\n  only there: {list(missing)[:3]}"
    )
