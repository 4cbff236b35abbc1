"""Run registered queries in Spark and their SQL in DuckDB and compare all rows.

Usage: python tests/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def plain(value):
    """Comparable form of a cell: exact, except that NaN equals NULL."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0 if value != 0 else 0.0)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}" if not isinstance(value, str) else value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, sf_dir: str, name: str, build, sql: str | None, con) -> tuple[bool, str]:
    start = time.time()
    df = build(spark, sf_dir)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, f"rows={len(got[1])} spark={took:.2f}s (no SQL)"
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = table_of(names, cur.fetchall())
    duck_took = time.time() - start
    note = f"rows={len(got[1])} spark={took:.2f}s duckdb={duck_took:.2f}s"
    if got[0] != want[0]:
        return False, f"{note}\n   columns {got[0]}\n   expected {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return False, f"{note} expected_rows={len(want[1])}\n   only spark {sorted(a - b)[:3]}\n   only sql   {sorted(b - a)[:3]}"
    return True, note if got[1] else note + " EMPTY"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from gyrespark.session import build_session

    args = sys.argv[1:]
    sf_dir = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    wanted = [a for a in args if "/" not in a]
    spark = build_session("compare", "local[8]", 8, "12g")
    spark.sparkContext.setLogLevel("OFF")
    con, sql = duck(sf_dir), oracle_sql()
    bad = 0
    for name, build in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note = compare(spark, sf_dir, name, build, sql.get(name), con)
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
    print("failed:", bad)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
