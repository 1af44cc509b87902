"""Compare a Spark result with SQL on DuckDB, whatever the order of rows and columns."""

from __future__ import annotations

import datetime as dt
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (dt.date, decimal.Decimal)):
        return str(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def spark_rows(df):
    return sorted(df.columns), _rows(df.columns, [tuple(row) for row in df.collect()])


def sql_rows(con, sql):
    relation = con.sql(sql)
    return sorted(relation.columns), _rows(relation.columns, relation.fetchall())


# Spark and DuckDB names of the same type.
TYPE_NAMES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP",
    "date": "DATE",
}


def spark_types(df):
    return {name: TYPE_NAMES.get(kind, kind) for name, kind in df.dtypes}


def sql_types(con, sql):
    relation = con.sql(sql)
    return dict(zip(relation.columns, map(str, relation.types)))
