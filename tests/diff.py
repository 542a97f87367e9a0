"""Compare registered queries with their SQL in DuckDB, order-insensitively."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def duck(data_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{data_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


FAMILY = {"TINYINT": "int8", "SMALLINT": "int16", "INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "double",
          "VARCHAR": "string", "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "timestamp", "HUGEINT": "hugeint"}
SPARK = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "double": "double",
         "string": "string", "boolean": "bool", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp"}


def compare(spark, con, fn, sql, data_dir):
    start = time.time()
    df = fn(spark, data_dir)
    types = {f.name: SPARK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    got = bag(df.columns, rows)
    if sql is None:
        return len(rows), took, None if rows else "no rows"
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    want_types = {r[0]: FAMILY.get(r[1], r[1]) for r in described}
    if sorted(types) != sorted(want_types):
        return len(rows), took, f"columns {sorted(types)} != {sorted(want_types)}"
    off = {n: (types[n], want_types[n]) for n in types if types[n] != want_types[n]}
    want = bag([r[0] for r in described], con.execute(sql).fetchall())
    if got != want:
        extra, lack = list((got - want).items())[:3], list((want - got).items())[:3]
        return len(rows), took, f"rows {sum(got.values())}/{sum(want.values())} only spark {extra} only sql {lack} cols {sorted(types)}"
    if off:
        return len(rows), took, f"types {off}"
    if not rows:
        return 0, took, "no rows"
    return len(rows), took, None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from cubeloom.session import local_session

    only = sys.argv[1:]
    spark = local_session(8)
    con = duck(DATA)
    sqls = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if only and not any(name.startswith(o.rstrip("*")) if o.endswith("*") else name == o for o in only):
            continue
        try:
            n, took, problem = compare(spark, con, fn, sqls.get(name), DATA)
        except Exception as exc:  # noqa: BLE001
            n, took, problem = -1, 0, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:28s} rows={n} {took:.2f}s {'' if sqls.get(name) else '(rows only)'} {problem or ''}", flush=True)
    print("failed", bad)
