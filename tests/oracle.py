"""Compares a query with its DuckDB oracle."""

import os

SF = "/root/testdata/sf0.001"


def connection(sf=SF):
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(sf):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return c


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(repr(round(r[k], 5) if isinstance(r[k], float) else r[k]) for k in order) for r in rows)


def compare(spark, query, sql, sf=SF):
    df = query(spark, sf)
    expected = connection(sf).sql(sql)
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows_of(df.collect(), df.columns) == rows_of(expected.fetchall(), expected.columns)
