"""Compare registered queries with their SQL twins in DuckDB. Run: python -m tests.oracle [sf] [name...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf: str, name: str, fn, sql):
    df = fn(spark, sf)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), "rows only"
    cur = connect(sf).execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return len(got), f"columns {got_cols} != {want_cols}"
    if got != want:
        extra = [r for r in got if r not in want][:2] if len(got) < 5000 else []
        missing = [r for r in want if r not in got][:2] if len(want) < 5000 else []
        diff = next(((a, b) for a, b in zip(got, want) if a != b), None)
        return len(got), f"rows {len(got)} vs {len(want)}; extra {str(extra)[:600]}; missing {str(missing)[:600]}; diff {str(diff)[:600]}"
    return len(got), "ok"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            count, verdict = compare(spark, sf, name, fn, sqls.get(name))
        except Exception:
            count, verdict = -1, "error " + traceback.format_exc()[-1800:]
        bad += verdict not in ("ok", "rows only")
        print(f"{name:28s} {count:7d} {time.time() - started:6.1f}s {verdict}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
