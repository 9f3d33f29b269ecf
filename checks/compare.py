"""Runs registered queries beside their SQL oracles and compares the rows.

python -m checks.compare [--sf DIR] [--time] [name prefix ...]"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time
import traceback

import duckdb

from carlake.session import local_session
from checks import all_queries
from checks.registry import ORACLES, QUERIES, TABLES, Tables


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr(tuple(plain(r[i]) for i in order)) for r in rows))


def main(argv=None) -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("--spark-only", action="store_true")
    p.add_argument("names", nargs="*")
    a = p.parse_args(argv)
    all_queries()
    names = [n for n in QUERIES if not a.names or any(n.startswith(x) for x in a.names)]
    spark = local_session("8", 8, "12g")
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    bad = 0
    for n in names:
        try:
            t0 = time.time()
            df = QUERIES[n](Tables(spark, a.sf))
            got = [tuple(r) for r in df.collect()]
            t1 = time.time()
            cols = df.columns
            if a.spark_only or n not in ORACLES:
                print(f"rows  {n}: {len(got)} rows, spark {t1 - t0:.1f}s", flush=True)
                continue
            rel = db.execute(ORACLES[n])
            dcols = [d[0] for d in rel.description]
            dtypes = {d[0]: str(d[1]) for d in rel.description}
            want = rel.fetchall()
            t2 = time.time()
            if sorted(cols) != sorted(dcols):
                bad += 1
                print(f"FAIL  {n}: columns {sorted(cols)} / {sorted(dcols)}", flush=True)
                continue
            g, w = rows_of(cols, got), rows_of(dcols, want)
            if g == w:
                few = "" if len(set(g)) > 1 or len(g) <= 1 else "  (all rows equal)"
                huge = [c for c, k in dtypes.items() if "HUGEINT" in k or "DECIMAL" in k or "INT128" in k]
                print(f"ok    {n}: {len(g)} rows, spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s{few} {huge or ''}", flush=True)
            else:
                bad += 1
                gs, ws = set(g), set(w)
                print(f"FAIL  {n}: {len(g)} / {len(w)} rows", flush=True)
                print("   spark only :", [x[:600] for x in sorted(gs - ws)[:2]])
                print("   duckdb only:", [x[:600] for x in sorted(ws - gs)[:2]], flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {n}: {type(e).__name__} {str(e)[:700]}", flush=True)
            if "-v" in sys.argv:
                traceback.print_exc()
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
