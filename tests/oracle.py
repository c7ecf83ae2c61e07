"""Compare registered queries with their DuckDB statements, value by value.

    python tests/oracle.py [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from wardlens.catalog.bindings import BASE  # noqa: E402
from wardlens.session import local_session  # noqa: E402


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(rows) > 0, f"{len(rows)} rows, no statement, {took:.1f}s"
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(theirs_names):
        return False, f"columns {sorted(df.columns)} against {sorted(theirs_names)}"
    a, b = _sorted_rows(df.columns, rows), _sorted_rows(theirs_names, theirs)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return False, f"{len(a)} against {len(b)} rows\n   spark {only_a}\n   duck  {only_b}"
    return True, f"{len(rows)} rows equal, {took:.1f}s"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    names = [
        n for n in entry.queries() if not args.names or any(n.startswith(p) for p in args.names)
    ]
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, note, flush=True)
    print(f"{len(names) - bad}/{len(names)} good")
    return bad


if __name__ == "__main__":
    sys.exit(main())
