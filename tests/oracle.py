"""Runs SQL in DuckDB over the test tables and compares its rows with a query's."""

import glob
import os

import duckdb


def _plain(v):
    return float(v) if type(v).__name__ in ("Decimal", "float32", "float64") else v


def compare(df, sql, sf):
    """None if the rows agree, else what differs."""
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(names)} and {sorted(df.columns)}"
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    want = sorted(repr(tuple(_plain(w[i]) for i in at)) for w in cur.fetchall())
    got = sorted(repr(tuple(_plain(r[c]) for c in cols)) for r in df.collect())
    if not got:
        return "no rows"
    return None if got == want else f"{len(got)} and {len(want)} rows; first: {[x for x in got if x not in set(want)][:2]} {[x for x in want if x not in set(got)][:2]}"[:1500]
