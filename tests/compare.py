"""Compares a query with its SQL on the driver's tables."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v) for v in r))
    return sorted(out, key=str)


def same(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    want, got = con.sql(sql).df(), query(spark, sf).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got) == rows(want)
