"""Compare a Spark result with its DuckDB oracle, ignoring row and column order."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = ("orders", "lineitem")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = [tuple(_plain(row[k]) for k in order) for row in rows]
    return [columns[k] for k in order], sorted(plain, key=repr)


def spark_rows(df):
    return canonical(df.columns, [tuple(row) for row in df.collect()])


def oracle_rows(con, sql):
    cursor = con.execute(sql)
    return canonical([d[0] for d in cursor.description], cursor.fetchall())


def duck_types(con, sql):
    return {d[0]: str(d[1]) for d in con.execute(sql).description}
