"""Compares a query with its SQL in DuckDB on the same tables, as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable", ignore_index=True)


def difference(spark, name: str, run, sql: str, sf_dir: str) -> str:
    """Empty if both agree."""
    got = canonical(run(spark, sf_dir).toPandas())
    want = canonical(connect(sf_dir).sql(sql).df())
    if list(got.columns) != list(want.columns):
        return f"{name}: columns {list(got.columns)} and {list(want.columns)}"
    if len(got) != len(want):
        return f"{name}: {len(got)} rows and {len(want)}"
    for c in got.columns:
        a, b = got[c], want[c]
        if a.dtype.kind != b.dtype.kind and not ({a.dtype.kind, b.dtype.kind} <= set("iuf") and a.isna().equals(b.isna())):
            return f"{name}.{c}: {a.dtype} and {b.dtype}"
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = same.idxmin()
            return f"{name}.{c}: {(~same).sum()} of {len(a)} values differ, as {a[i]!r} and {b[i]!r}"
    return ""


def main() -> int:
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[1:] or [q for q in queries if not q.startswith(("op", "pipeline"))]:
        t = time.time()
        try:
            if name in oracles:
                said = difference(spark, name, queries[name], oracles[name], sf_dir)
            else:
                said, n = "", len(queries[name](spark, sf_dir).toPandas())
                print(f"   {name}: {n} rows, no SQL")
        except Exception as e:
            said = f"{name}: {type(e).__name__} {str(e)[:400]}" if "DEBUG" not in os.environ else traceback.format_exc()
        if said:
            bad += 1
            print("BAD", said, flush=True)
        if time.time() - t > 5:
            print(f"   {name} took {time.time() - t:.1f} s")
    print("bad", bad, "of", len(sys.argv[1:]) or len(queries))
    return bad


if __name__ == "__main__":
    sys.exit(main())
