"""Comparison of a query with its SQL on the test tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

import __spark_entry__

DATA = "/root/testdata/sf0.01"


def connection(where=DATA):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in sorted(Path(where).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (float, decimal.Decimal)):
        return None if math.isnan(value) else round(float(value), 6)
    if isinstance(value, datetime.date):
        return str(value).removesuffix("+00:00")
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in found), key=repr)


def compare(spark, name, where=DATA):
    """(columns agree, rows of Spark, rows of SQL)."""
    df = __spark_entry__.queries()[name](spark, where)
    got = rows(df.columns, df.collect())
    con = connection(where)
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    return sorted(df.columns) == sorted(names), got, rows(names, found.fetchall())
