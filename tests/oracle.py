"""Compare registered queries with their SQL on DuckDB: names, row counts, values."""

from __future__ import annotations

import datetime
import decimal
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return int(f) if f == int(f) else round(f, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([names[i] for i in order]), sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)


def compare(spark, sf_dir: str, name: str, fn, sql: str, con) -> dict:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    out = {"name": name, "spark_s": round(t1 - t0, 2), "duck_s": round(time.time() - t1, 2), "rows": len(got[1])}
    out["ok"] = got == want
    if not out["ok"]:
        a, b = set(got[1]), set(want[1])
        out["why"] = f"cols {got[0]} vs {want[0]}; rows {len(got[1])} vs {len(want[1])}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"
    return out
