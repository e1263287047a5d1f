"""Runs an oracle's SQL in DuckDB over the test tables and compares it with a query's rows."""

import glob
import os

import duckdb


def rows(sql, sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def same(df, sql, sf):
    names, want = rows(sql, sf)
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    got = sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))
    assert got == sorted(str(tuple(w[i] for i in at)) for w in want)
    assert got
