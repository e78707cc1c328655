"""Run a registered query in Spark and its SQL in DuckDB, and compare."""

from __future__ import annotations

import datetime as dt

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row):
    return tuple((value is not None, str(type(value)), value) for value in row)


def _value(value):
    return value.date() if isinstance(value, dt.datetime) else value


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(_value(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked, key=_key)


def spark_rows(df):
    return rows_by_name(df.columns, df.collect())


def duck_rows(con, sql):
    result = con.execute(sql)
    return rows_by_name([d[0] for d in result.description], result.fetchall())
