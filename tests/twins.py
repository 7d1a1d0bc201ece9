"""Run queries and their SQL twins side by side.

    python tests/twins.py [--sf 0.001] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DATA = os.environ.get("FOLIANT_TESTDATA", "/root/testdata")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else float(value) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def sort_key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=sort_key)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    from foliant.plans.catalog import QUERIES, SQL

    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if name not in SQL:
        return True, f"{name}: rows-only {len(rows)} rows, spark {t1 - t0:.2f}s"
    rel = con.execute(SQL[name])
    cols = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    expected = rel.fetchall()
    t2 = time.time()
    a = normal(df.columns, rows)
    b = normal(cols, expected)
    note = f"{len(rows)} rows, spark {t1 - t0:.2f}s, duckdb {t2 - t1:.2f}s"
    if a[0] != b[0]:
        return False, f"{name}: columns {a[0]} vs {b[0]}"
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if KINDS.get(kinds[c], kinds[c]) != t}
    if a[1] != b[1]:
        diff = [(x, y) for x, y in zip(a[1], b[1], strict=False) if x != y][:2]
        return False, f"{name}: {len(a[1])} vs {len(b[1])} rows; first differences {str(diff)[:900]}"
    return not odd, f"{name}: {note}" + (f" TYPES {odd}" if odd else "")


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.001")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from foliant.plans.catalog import QUERIES
    from foliant.session import local_session

    spark = local_session(cores=8)
    sf_dir = f"{DATA}/sf{args.sf}"
    con = duck(sf_dir)
    failed = 0
    for name in args.names or QUERIES:
        try:
            ok, text = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, text = False, f"{name}: {type(error).__name__} {str(error)[:700]}"
        failed += not ok
        print("ok  " if ok else "FAIL", text, flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
