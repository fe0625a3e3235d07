"""Compares a query with its DuckDB SQL: same columns, same rows whatever their order."""

import glob
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def connection(folder=FOLDER):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and v != v):
        return "None"
    if hasattr(v, "tolist"):
        v = v.tolist()
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(_cell, r)) for r in df.itertuples(index=False, name=None))


def assert_same(spark, query, sql, con, folder=FOLDER):
    got, want = rows(query(spark, folder).toPandas()), rows(con.execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
