"""Run a registered query in Spark and its SQL in DuckDB and compare rows, order aside."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{TESTDATA}/sf{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else the first difference."""
    mine = [tuple(r) for r in spark_df.collect()]
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(spark_df.columns) != sorted(columns):
        return f"columns {sorted(set(spark_df.columns) ^ set(columns))[:10]}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    names = sorted(columns)
    for a, b in zip(_rows(spark_df.columns, mine), _rows(columns, theirs)):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            bad = [(n, x, y) for n, x, y in zip(names, a, b) if x != y or type(x) is not type(y)]
            return f"{len(bad)} cells differ, first {bad[:4]} in {a[:3]}"
    return None
