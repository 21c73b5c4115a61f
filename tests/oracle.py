"""Runs a registered query and its SQL side by side: python tests/oracle.py NAME... [--sf sf0.01]."""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("GRAPHLOOM_TESTDATA", "/root/testdata")


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(f"{DATA}/{sf}")):
        p = f"{DATA}/{sf}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def compare(spark, con, name, q, sql, sf):
    """Text of the first difference, empty when both agree."""
    df = q(spark, f"{DATA}/{sf}")
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "", len(got)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(cols)}", len(got)
    if got != want:
        a, b = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
        return f"{len(got)} rows against {len(want)}: only here {a}, only there {b}", len(got)
    return "", len(got)


if __name__ == "__main__":
    import __spark_entry__ as e

    args = sys.argv[1:]
    sf = "sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i : i + 2]
    qs, sqls = e.queries(), e.oracle_sql()
    names = [n for n in qs if any(n.startswith(a) for a in args)] if args else list(qs)
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            why, k = compare(spark, con, n, qs[n], sqls.get(n), sf)
        except Exception as x:
            why, k = f"{type(x).__name__}: {str(x)[:600]}", -1
        bad += bool(why)
        print(f"{'FAIL' if why else 'ok' if n in sqls else 'rows'} {n} {k} rows {time.time() - t:.1f}s {why}", flush=True)
    print("failed:", bad)
