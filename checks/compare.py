"""Run registered queries against their DuckDB statements and compare the results.

    python checks/compare.py [data folder] [query ...]
"""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if hasattr(v, "as_tuple"):
        return "decimal:" + str(v)
    return repr(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, folder):
    """None when both results are equal, else a short text on the first difference."""
    df = fn(spark, folder)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = _rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(names)}", len(got)
    if got != want:
        a = [r for r in got if r not in set(want)][:2]
        b = [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} <> {len(want)}; only Spark {str(a)[:700]}; only DuckDB {str(b)[:700]}", len(got)
    kinds = {"VARCHAR": "string", "BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean"}
    types = {n: kinds.get(str(d[1]), str(d[1])) for n, d in zip(names, cur.description)}
    odd = {n: (t, types[n]) for n, t in df.dtypes if types[n] != t}
    return (f"types {odd}" if odd else None), len(got)


def main():
    from corpuscope.queries import QUERIES
    from oracle import SQL
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark, con = session(), connect(folder)
    bad = 0
    for name, fn in QUERIES.items():
        if name not in SQL or (only and name not in only):
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, fn, SQL[name], folder)
        except Exception as e:  # report and go on with the next query
            problem, n = f"error {str(e)[:500]}", -1
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {name:28s} {n:7d} {time.time() - start:6.1f}s {problem or ''}", flush=True)
    print("without SQL:", [n for n in QUERIES if n not in SQL])
    print("bad:", bad)


if __name__ == "__main__":
    main()
