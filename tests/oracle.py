"""Comparison of a query's rows with those of its SQL counterpart."""

from __future__ import annotations

import collections
import pathlib

import duckdb

TESTDATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in pathlib.Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def multiset(columns: list[str], rows) -> tuple[list[str], collections.Counter]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    counted = collections.Counter(tuple(row[i] for i in order) for row in rows)
    return [columns[i] for i in order], counted


def expected(sf_dir: str, sql: str):
    result = connect(sf_dir).sql(sql)
    return multiset(result.columns, result.fetchall())


def actual(frame):
    return multiset(frame.columns, [tuple(row) for row in frame.collect()])
