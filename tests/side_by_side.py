"""Runs a query in Spark and its SQL in DuckDB and compares the rows.

``python tests/side_by_side.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str, tables: list[str] = TABLES):
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value



def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1.01e-6 * max(1.0, abs(a), abs(b))
    return a == b


def compare(spark, con, query, sql, sf_dir: str) -> str:
    """'' when equal, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    if sorted(cols) != names:
        return f"columns differ: {names} / {sorted(cols)}"
    at = [cols.index(c) for c in names]
    raw = cur.fetchall()
    want = [tuple(plain(r[i]) for i in at) for r in raw]
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    order = lambda r: tuple((v is None, str(type(v)), v) for v in r)
    got.sort(key=order)
    want.sort(key=order)
    for g, w in zip(got, want):
        if not all(same(a, b) for a, b in zip(g, w)):
            return f"row differs on {[n for n, a, b in zip(names, g, w) if not same(a, b)]}:\n  {g}\n  {w}"
    return ""


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from txrisk.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = duck(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if argv[1:] and not any(name.startswith(a) for a in argv[1:]):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, query, sqls[name], sf_dir)
                status = "ok" if not problem else "DIFF " + problem
            else:
                status = f"rows {query(spark, sf_dir).count()}"
        except Exception as error:  # report every query, then fail
            status = "ERROR " + str(error)[:1500]
        failed += status.startswith(("DIFF", "ERROR"))
        print(f"{name:32s} {time.time() - start:6.2f}s {status}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
