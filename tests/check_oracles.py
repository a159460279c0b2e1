"""Compare registered queries with their SQL oracles in DuckDB.

    python -m tests.check_oracles [--sf DIR] [--module NAME] [query ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from importlib import import_module

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return type(v).__name__ + ":" + str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None when equal, else a short description of the difference."""
    got_cols = df.columns
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    a, b = normal(got_cols, got), normal(want_cols, want)
    if a == b:
        return None if a else "EMPTY RESULT"
    only_a, only_b = list(set(a) - set(b))[:3], list(set(b) - set(a))[:3]
    return f"rows {len(a)} != {len(b)}; spark {only_a} duckdb {only_b}"


def session(cpus=8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("--module")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    if a.module:
        m = import_module(f"catalog.{a.module}")
        queries, sql = m.QUERIES, m.SQL
    else:
        from catalog import all_queries, all_sql

        queries, sql = all_queries(), all_sql()
    from corpuscope.plans.lineage import ensure_shared_dir

    spark, con = session(), connect(a.sf)
    ensure_shared_dir(spark)
    bad = 0
    for name in a.names or queries:
        t = time.time()
        try:
            df = queries[name](spark, a.sf)
            if name in sql:
                diff = compare(df, con, sql[name])
                mark = "ok" if diff is None else "DIFF " + diff[:900]
            else:
                n = len(df.collect())
                mark = f"rows {n}" if n else "DIFF no rows"
        except Exception as e:  # report and go on
            mark = "ERROR " + str(e)[:900]
        bad += mark.startswith(("DIFF", "ERROR"))
        print(f"{name}: {mark} ({time.time() - t:.1f}s)", flush=True)
    print("failures:", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
