"""Run registered queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import os
import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from fieldloom.plans import registry  # noqa: E402


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoints-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    text = lambda v: repr(float(v)) if isinstance(v, float) else repr(v)
    return sorted(tuple(text(row[k]) for k in order) for row in rows)


def compare(spark, con, sf, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf)
    rows = [tuple(x) for x in df.collect()]
    t1 = time.time()
    msg = f"spark {len(rows)} rows {t1 - t0:.1f}s"
    bad = [c for c in df.columns if df.columns.count(c) > 1]
    if bad:
        return False, f"duplicate columns {bad}"
    nonfinite = any(isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) for row in rows for v in row)
    if nonfinite:
        msg += " NONFINITE"
    if sql is None:
        return bool(rows), msg + " (rows only)"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    expect = res.fetchall()
    msg += f", duckdb {len(expect)} rows {time.time() - t1:.1f}s"
    if sorted(cols) != sorted(df.columns):
        return False, msg + f" columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = norm(rows, df.columns), norm(expect, cols)
    if a == b:
        types = dict(df.dtypes)
        return bool(rows), msg
    only_a = list(set(a) - set(b))[:3]
    only_b = list(set(b) - set(a))[:3]
    nd = len(set(a) - set(b))
    return False, msg + f"\n  cols {sorted(cols)}\n  differing {nd}\n  spark {sorted(only_a)}\n  duck  {sorted(only_b)}"


def main(argv):
    sf = argv[0]
    picks = argv[1:]
    q, o = registry.load()
    spark, con = session(), duck(sf)
    fails = []
    for name in q:
        if picks and not any(name.startswith(p) for p in picks):
            continue
        try:
            ok, msg = compare(spark, con, sf, name, q[name], o.get(name))
        except Exception as e:  # report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        print(("ok  " if ok else "FAIL"), name, msg, flush=True)
        if not ok:
            fails.append(name)
    print("failed:", fails)


if __name__ == "__main__":
    main(sys.argv[1:])
