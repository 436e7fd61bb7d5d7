"""Rows of a query and of its SQL twin, as sorted text."""

import os

import duckdb


def connection(folder):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for name in os.listdir(folder):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return c


def rows(records):
    def plain(v):
        return float(v) + 0.0 if isinstance(v, float) else v

    return sorted(repr(tuple(plain(v) for v in r)) for r in records)


def spark_rows(df):
    names = sorted(df.columns)
    return names, rows(tuple(r) for r in df.select(*names).collect())


def duck_rows(c, sql):
    got = c.sql(sql)
    names = sorted(got.columns)
    order = [got.columns.index(n) for n in names]
    return names, rows(tuple(r[k] for k in order) for r in got.fetchall())
