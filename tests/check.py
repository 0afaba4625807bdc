"""Run registered queries next to their SQL and compare rows: ``python tests/check.py [-s sf] [names...]``."""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 2**53 else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple(str(x) for x in r))


def compare(spark, con, name, query, sf_dir):
    """(message or None, spark seconds, check seconds, rows)."""
    t = time.time()
    df = query(spark, sf_dir)
    rows = df.collect()
    mine = rows_of(df.columns, rows)
    t_spark, t = time.time() - t, time.time()
    if query.sql is None:
        return None, t_spark, 0.0, len(rows)
    cur = con.execute(query.sql)
    theirs = rows_of([c[0] for c in cur.description], cur.fetchall())
    t_sql = time.time() - t
    message = None
    if mine[0] != theirs[0]:
        message = f"columns {mine[0]} != {theirs[0]}"
    elif mine[1] != theirs[1]:
        a, b = mine[1], theirs[1]
        sa, sb = set(map(str, a)), set(map(str, b))
        extra, missing = [x for x in a if str(x) not in sb][:3], [x for x in b if str(x) not in sa][:3]
        message = f"rows {len(a)} vs {len(b)}; only spark {extra}; only sql {missing}"
    return message, t_spark, t_sql, len(rows)


def main():
    from terrafold.plans.catalog import QUERIES
    from terrafold.session import build_session

    args = sys.argv[1:]
    sf = "0.01"
    if "-s" in args:
        i = args.index("-s")
        sf = args[i + 1]
        args = args[:i] + args[i + 2 :]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    names = [n for n in QUERIES if not args or any(n == a or n.startswith(a.rstrip("*")) and a.endswith("*") for a in args)]
    bad = 0
    for n in names:
        try:
            message, ts, tq, rows = compare(spark, con, n, QUERIES[n], sf_dir)
        except Exception as e:  # noqa: BLE001
            message, ts, tq, rows = f"{type(e).__name__}: {str(e)[:1500]}", 0, 0, -1
        flag = "ok  " if message is None else "FAIL"
        bad += message is not None
        print(f"{flag} {n:34s} rows={rows:<7d} spark={ts:6.2f}s sql={tq:6.2f}s{'' if QUERIES[n].sql else '  (rows only)'} {message or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
