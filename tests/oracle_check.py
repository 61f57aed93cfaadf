"""Runs registered queries next to their SQL twin and compares the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return ("f", round(v, 6))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("f", round(float(v), 6))
    if isinstance(v, (dt.datetime, dt.date)):
        return ("t", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(norm(x) for x in v))
    return ("s" if v is not None else "n", str(v))


def rows_of(cols: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, fn, sql: str | None):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = f"spark {time.time() - t0:.1f}s "
    if sql is None:
        return True, len(got), took + "rows only"
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, len(got), f"columns {got_cols} / {want_cols}"
    if got != want:
        sg, sw = set(got), set(want)
        a, b = [x for x in got if x not in sw][:3], [x for x in want if x not in sg][:3]
        return False, len(got), f"rows {len(got)}/{len(want)}; spark only {a}; sql only {b}"
    return True, len(got), took


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from termloom.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in qs:
        if argv and not any(a == name or (a.endswith("*") and name.startswith(a[:-1])) for a in argv):
            continue
        t0 = time.time()
        try:
            ok, n, msg = compare(spark, con, sf, qs[name], sqls.get(name))
        except Exception as e:  # noqa: BLE001
            ok, n, msg = False, -1, f"{type(e).__name__}: {str(e)[:1200]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {n:8d} {time.time() - t0:6.1f}s {msg[:1500]}", flush=True)
    print(f"failed: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
