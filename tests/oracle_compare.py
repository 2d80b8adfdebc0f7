"""Compares a query with its SQL by value, whatever the row order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 10 ** 9 else str(value)
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    return value


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(flat, key=repr)


def spark_result(df):
    return normalise(df.columns, [tuple(r) for r in df.collect()])


def sql_result(connection, sql):
    cursor = connection.execute(sql)
    return normalise([d[0] for d in cursor.description], cursor.fetchall())
