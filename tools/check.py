"""Run queries against their SQL cross-checks: ``check.py [sf_dir] [query ...]``."""

from __future__ import annotations

import importlib
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
from pyspark.sql import SparkSession

from veilframe.plans.derived import TABLES


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows), [columns[i] for i in order]


def compare(spark, con, sf_dir, fn, sql):
    started = time.time()
    df = fn(spark, sf_dir)
    ours, names = rows_of(df.columns, df.collect())
    took = time.time() - started
    if sql is None:
        return f"rows only: {len(ours)}", took
    started = time.time()
    got = con.sql(sql)
    theirs, other = rows_of(got.columns, got.fetchall())
    if names != other:
        return f"COLUMNS {names} / {other}", took
    if ours == theirs:
        return f"ok {len(ours)} (sql {time.time() - started:.1f}s)" + ("" if ours else " EMPTY"), took
    only_ours, only_theirs = set(ours) - set(theirs), set(theirs) - set(ours)
    return (f"DIFFER {len(ours)} / {len(theirs)}\n   spark: {sorted(only_ours)[:4]}\n   sql:   {sorted(only_theirs)[:4]}"), took


def main(sf_dir="/root/testdata/sf0.001", *names):
    modules = [n for n in names if n.endswith(".")]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = {}
    if modules:
        for m in modules:
            found.update(importlib.import_module(f"veilframe.plans.{m[:-1]}").QUERIES)
    else:
        from veilframe.plans.catalog import ORACLES, QUERIES
        found = {n: (f, ORACLES.get(n)) for n, f in QUERIES.items()}
    wanted = [n for n in names if not n.endswith(".")]
    bad = 0
    for n, (fn, sql) in found.items():
        if wanted and n not in wanted:
            continue
        try:
            verdict, took = compare(spark, con, sf_dir, fn, sql)
        except Exception as e:  # report and go on with the next query
            verdict, took = f"ERROR {type(e).__name__}: {str(e)[:600]}", 0
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{n:28s} {took:6.1f}s {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
