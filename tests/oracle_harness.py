"""Run registered queries in Spark and their SQL in DuckDB; compare rows, schema names and values.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "item"):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(_norm(None if x is pd.NA or (isinstance(x, float) and math.isnan(x)) else x) for x in rec))
    return cols, sorted(out)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(spdf), spark_s=round(t1 - t0, 2))
    dpdf = con.execute(sql).df()
    c1, r1 = rows_of(spdf)
    c2, r2 = rows_of(dpdf)
    ok = c1 == c2 and r1 == r2
    info = dict(name=name, ok=ok, rows=len(r1), oracle_rows=len(r2), spark_s=round(t1 - t0, 2))
    if not ok:
        info["cols"] = (c1, c2) if c1 != c2 else None
        diff1 = [r for r in r1 if r not in set(r2)][:3]
        diff2 = [r for r in r2 if r not in set(r1)][:3]
        info["spark_only"] = diff1
        info["oracle_only"] = diff2
    return info


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from txrisk.session import local_session
    import __spark_entry__ as E

    spark = local_session(8, 8)
    con = duck(sf_dir)
    qs = E.queries()
    sqls = E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            info = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as exc:  # report and go on
            info = dict(name=name, ok=False, error=repr(exc)[:800])
        if info.get("ok") is False:
            bad += 1
        print(info, flush=True)
    print(f"mismatches: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
