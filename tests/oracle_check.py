"""Run registered queries against their DuckDB oracle (driver-style check).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return ("~null",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("num", round(v, 6))
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("num", float(v))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return ("list", tuple(norm(x) for x in v))
    return ("str", str(v))


def rows_of(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(rows, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(spdf), spark_s=round(t1 - t0, 2))
    dpdf = con.execute(sql).df()
    t2 = time.time()
    sc, sr = rows_of(spdf)
    dc, dr = rows_of(dpdf)
    res = dict(name=name, rows=len(sr), oracle_rows=len(dr), spark_s=round(t1 - t0, 2), duck_s=round(t2 - t1, 2))
    if sc != dc:
        res.update(ok=False, why=f"columns {sc} vs {dc}")
    elif len(sr) != len(dr):
        res.update(ok=False, why="row count")
    else:
        bad = [(a, b) for a, b in zip(sr, dr) if a != b]
        res.update(ok=not bad, why=(f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else ""))
    return res


def main():
    from vigil.session import build_session
    import __spark_entry__ as E
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, orc.get(name), sf_dir)
        except Exception as e:  # report and continue
            r = dict(name=name, ok=False, why=f"{type(e).__name__}: {str(e)[:400]}")
        bad += r.get("ok") is False
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
