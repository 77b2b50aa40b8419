"""Compare every registered query with its SQL: python tests/check_oracles.py [sf] [name ...]"""

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]")
        df[c] = df[c].map(lambda v: "<null>" if v is None or v is pd.NaT or v != v else repr(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark, con, sf_dir, name):
    t0 = time.time()
    got = entry.queries()[name](spark, sf_dir).toPandas()
    t1 = time.time()
    cur = con.execute(entry.oracle_sql()[name])
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description])
    t2 = time.time()
    assert sorted(got.columns) == sorted(want.columns), (list(got.columns), list(want.columns))
    got = pd.DataFrame(got.astype(object).values.tolist(), columns=got.columns)
    a, b = canonical(got), canonical(want)
    problem = ""
    if len(a) != len(b):
        problem = f"rows {len(a)} vs {len(b)}"
    if not a.equals(b):
        both = a.merge(b, how="outer", indicator=True)
        diff = both[both["_merge"] != "both"].head(6)
        problem += "\n" + diff.to_string(max_colwidth=120)
    return len(a), t1 - t0, t2 - t1, problem


if __name__ == "__main__":
    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or entry.oracle_sql():
        try:
            n, ts, td, problem = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            n, ts, td, problem = 0, 0, 0, f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(problem)
        print(f"{'BAD' if problem else 'ok '} {name:26s} rows={n} spark={ts:.1f}s duckdb={td:.1f}s {problem}", flush=True)
    print("mismatches:", bad)
