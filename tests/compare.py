"""Compare a Spark result with DuckDB's: same columns, same rows in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def differences(df, con, sql) -> list[str]:
    have_cols, have = normal([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    want_cols, want = normal(cur.fetchall(), [d[0] for d in cur.description])
    if have_cols != want_cols:
        return [f"columns {have_cols} != {want_cols}"]
    if len(have) != len(want):
        return [f"{len(have)} rows != {len(want)}"]
    bad = [(h, w) for h, w in zip(have, want) if h != w or [type(x) for x in h] != [type(x) for x in w]]
    return [f"{len(bad)} rows differ, first {str(bad[0])[:1500]}"] if bad else []
