"""Compares a registered query with its DuckDB SQL on one folder of tables."""

import datetime
import decimal
import os

import duckdb


def value(x):
    if isinstance(x, datetime.datetime):
        return str(x)[:19]
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 5) + 0.0
    return x


def rows(got, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(value(r[k]) for k in order) for r in got), key=lambda r: tuple((x is None, str(x)) for x in r))


def connect(folder):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{folder}/{t}'")
    return con


def same(df, sql, con):
    want = con.sql(sql)
    expected, columns = want.fetchall(), want.columns
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(expected, columns)
