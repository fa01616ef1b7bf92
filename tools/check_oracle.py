"""Run registered queries and their SQL oracle side by side.

    python tools/check_oracle.py [sf_dir] [query ...]

Compares row count, sorted column names and an order-insensitive hash of
the rows (values normalised: floats rounded to 6 places, NaN/None equal).
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from pagequality.plans import ORACLE_SQL, QUERIES  # noqa: E402
from pagequality.session import local_session  # noqa: E402
from pagequality.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{round(v, 6):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    hs = sorted(hashlib.sha1("\x1f".join(norm(r[i]) for i in order).encode()).hexdigest() for r in rows)
    return hashlib.sha1("".join(hs).encode()).hexdigest(), hs


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ok = 0
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name:24s} SPARK ERROR {str(e)[:300]}")
            continue
        t1 = time.time()
        sql = ORACLE_SQL.get(name)
        if sql is None:
            print(f"{name:24s} rows={len(srows)} (no oracle) spark={t1 - t0:.1f}s")
            continue
        try:
            cur = con.execute(sql)
            orows = cur.fetchall()
            ocols = [d[0] for d in cur.description]
        except Exception as e:  # noqa: BLE001
            print(f"{name:24s} SQL ERROR {str(e)[:300]}")
            continue
        t2 = time.time()
        same_cols = sorted(scols) == sorted(ocols)
        hs, shs = digest(srows, scols)
        ho, ohs = digest(orows, ocols)
        good = same_cols and len(srows) == len(orows) and hs == ho
        ok += good
        print(f"{name:24s} {'OK ' if good else 'BAD'} rows={len(srows)}/{len(orows)} cols={'=' if same_cols else (sorted(scols), sorted(ocols))} "
              f"spark={t1 - t0:.1f}s sql={t2 - t1:.1f}s")
        if not good and same_cols:
            order_s = sorted(range(len(scols)), key=lambda i: scols[i])
            order_o = sorted(range(len(ocols)), key=lambda i: ocols[i])
            ss = {tuple(norm(r[i]) for i in order_s) for r in srows}
            oo = {tuple(norm(r[i]) for i in order_o) for r in orows}
            cols = [scols[i] for i in order_s]
            print("   columns:", cols)
            for r in list(ss - oo)[:3]:
                print("   spark only:", [x[:120] for x in r])
            for r in list(oo - ss)[:3]:
                print("   sql only:  ", [x[:120] for x in r])
    print(f"{ok}/{len(names)} match")


if __name__ == "__main__":
    main()
