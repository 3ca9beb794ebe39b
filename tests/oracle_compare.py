"""Run registered queries on Spark and their DuckDB oracle side by side.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Prints one line per query: name, rows, match flags.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = list(sdf.columns)
    t1 = time.time()
    if sql is None:
        return dict(name=name, rows=len(srows), oracle=None, secs=round(t1 - t0, 2))
    rel = con.sql(sql)
    dcols = list(rel.columns)
    drows = rel.fetchall()
    ok_cols = sorted(scols) == sorted(dcols)
    ok_rows = len(srows) == len(drows)
    ok_vals = ok_cols and canon(srows, scols) == canon(drows, dcols)
    res = dict(name=name, rows=len(srows), oracle_rows=len(drows), cols=ok_cols, values=ok_vals, secs=round(t1 - t0, 2))
    if not ok_vals:
        res["spark_cols"] = scols
        res["duck_cols"] = dcols
        if ok_cols:
            a, b = canon(srows, scols), canon(drows, dcols)
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            res["first_diffs"] = diff
    return res


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as entry
    from raresift.session import build_session

    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and continue
            r = dict(name=name, error=f"{type(e).__name__}: {str(e)[:400]}")
        if r.get("error") or (r.get("oracle") is not None and False) or r.get("values") is False:
            bad += 1
        print(r, flush=True)
    print(f"# failures: {bad}")


if __name__ == "__main__":
    main()
