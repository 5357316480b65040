"""Run registered queries against their DuckDB text: python tests/oracle_check.py [sf] [names...]."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if v != v else v
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return tuple(sorted((k, canon(x)) for k, x in v.asDict().items()))
    return v


def compare(spark_df, con, text: str) -> str:
    cols = sorted(spark_df.columns)
    mine = [tuple(canon(r[c]) for c in cols) for r in spark_df.collect()]
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"COLUMNS spark={cols} oracle={sorted(names)}"
    order = [names.index(c) for c in cols]
    theirs = [tuple(canon(r[i]) for i in order) for r in cur.fetchall()]
    if len(mine) != len(theirs):
        return f"ROWS spark={len(mine)} oracle={len(theirs)}"
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    a, b = sorted(mine, key=repr), sorted(theirs, key=repr)
    left, right = set(map(repr, a)), set(map(repr, b))
    if left == right:
        return f"ok rows={len(mine)}"
    only_a = sorted(left - right)[:2]
    only_b = sorted(right - left)[:2]
    return f"VALUES differ={len(left - right)}/{len(a)} cols={cols}\n    spark  {only_a}\n    oracle {only_b}"


def main() -> int:
    import __spark_entry__ as entry
    from navstead.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session(8)
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    bad = 0
    for n in chosen:
        t0 = time.time()
        try:
            df = queries[n](spark, sf_dir)
            if n in oracles:
                verdict = compare(df, con, oracles[n])
            else:
                verdict = f"rows-only rows={len(df.collect())}"
        except Exception as exc:  # noqa: BLE001 - report every query
            verdict = f"ERROR {type(exc).__name__} {str(exc)[:1500]}"
        bad += not (verdict.startswith("ok") or verdict.startswith("rows-only"))
        print(f"{n:42s} {time.time() - t0:6.2f}s  {verdict}", flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} fine")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
