"""Comparison of a query with its SQL in DuckDB."""

import math
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{t}')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return [columns[k] for k in order], sorted((tuple(clean(r[k]) for k in order) for r in data), key=repr)


def assert_same(df, connection, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = connection.execute(sql)
    want = rows([d[0] for d in found.description], found.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
