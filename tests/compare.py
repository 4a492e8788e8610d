"""Runs registered queries in Spark and their SQL in the checking engine, and compares.

    python tests/compare.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def checker(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "∅"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0) if v != int(v) else str(int(v))
    return str(v.tolist() if hasattr(v, "tolist") else v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in records)


def compare(spark, con, q, sf_dir: str) -> str:
    df = q.run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if q.sql is None:
        return f"rows only ({len(got)})"
    cur = con.execute(q.sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"MISMATCH columns {sorted(df.columns)} / {sorted(names)}"
    if got == want:
        return f"ok ({len(got)})" if got else "EMPTY"
    a, b = set(got) - set(want), set(want) - set(got)
    return f"MISMATCH {len(got)} / {len(want)} rows\n   spark {sorted(a)[:3]}\n   check {sorted(b)[:3]}"


def main() -> int:
    from joblattice.plans.catalog import QUERIES
    from joblattice.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark, con = local_session("8"), checker(args.sf)
    bad = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            said = compare(spark, con, QUERIES[name], args.sf)
        except Exception as e:  # noqa: BLE001 - the report goes on to the next query
            said = "ERROR " + str(e)[:700]
        bad += said.startswith(("MISMATCH", "ERROR", "EMPTY"))
        print(f"{name}: {said} {time.time() - start:.1f}s", flush=True)
    print(f"{bad} bad")
    return bool(bad)


if __name__ == "__main__":
    raise SystemExit(main())
