"""Compare registered queries with their SQL on one scale factor: check_oracle.py [sf_dir] [names...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

import workloads
from fieldspark.plans.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return str(v)
        return f"{v:.9g}" if v else "0"
    if isinstance(v, bool):
        return str(v)
    if type(v).__name__ == "Decimal":
        return f"{float(v):.9g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, int):
        return f"{float(v):.9g}" if v else "0"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = workloads.load()
    names = argv[1:] or list(queries)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name not in oracles:
                print(f"rows {name} {len(got)} {took:.2f}s", flush=True)
                continue
            cur = con.execute(oracles[name])
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            if sorted(cols) != sorted(df.columns):
                bad += 1
                print(f"BAD  {name} columns {sorted(df.columns)} != {sorted(cols)}", flush=True)
                continue
            a, b = rows(df.columns, got), rows(cols, want)
            if a == b:
                print(f"ok   {name} {len(got)} {took:.2f}s", flush=True)
            else:
                bad += 1
                extra = [x for x in a if x not in set(b)][:3]
                missing = [x for x in b if x not in set(a)][:3]
                print(f"BAD  {name} {len(a)} vs {len(b)}\n  spark {extra}\n  sql   {missing}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name} {type(e).__name__} {str(e)[:600]}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
