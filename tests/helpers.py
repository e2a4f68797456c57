"""Comparing a query's rows with what DuckDB gives for its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def duck(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def rows_of(frame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted((tuple(_plain(r[n]) for n in names) for r in frame.collect()), key=repr)


def rows_of_sql(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in result.fetchall()), key=repr)


def _plain(value):
    return round(value, 9) if isinstance(value, float) else value
