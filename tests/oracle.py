"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows.

    python -m tests.oracle [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import glob
import math
import os
import time
from collections import Counter

import duckdb

DATA = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def compare(spark, con, query, statement, sf_dir: str) -> list[str]:
    """Differences between both results; empty when they match."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    cur = con.execute(statement)
    found = [c[0] for c in cur.description]
    if sorted(found) != names:
        return [f"columns {names} against {sorted(found)}"]
    at = [found.index(n) for n in names]
    theirs = [tuple(_plain(r[i]) for i in at) for r in cur.fetchall()]
    a, b = Counter(ours), Counter(theirs)
    if a == b:
        return []
    out = [f"rows {len(ours)} against {len(theirs)}; columns {names}"]
    out += [f"only ours: {str(r)[:400]}" for r in list((a - b).elements())[:3]]
    out += [f"only sql:  {str(r)[:400]}" for r in list((b - a).elements())[:3]]
    return out


def main() -> None:
    import __spark_entry__ as entry
    from accordance.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf_dir = f"{DATA}/sf{args.sf}"
    spark = local_session("8")
    con = connect(sf_dir)
    queries, statements = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            if name in statements:
                diff = compare(spark, con, queries[name], statements[name], sf_dir)
            else:
                diff = []
                print(f"{name}: {queries[name](spark, sf_dir).count()} rows, no SQL")
        except Exception as e:  # noqa: BLE001
            diff = [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name} {time.time() - start:.1f}s", flush=True)
        for line in diff:
            print("     ", line)
    print("failed:", bad)


if __name__ == "__main__":
    main()
