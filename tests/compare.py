"""Compare registered queries with their SQL: python tests/compare.py [sf] [names...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            path = f"{sf}/{f}" if os.path.isfile(f"{sf}/{f}") else f"{sf}/{f}/*.parquet"
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: ("nan" if math.isnan(v) else round(v, 5) + 0.0) if isinstance(v, float) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, run, sql, sf):
    """None if equal, else what differs."""
    df = run(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    want = rows_of(columns, cur.fetchall())
    if got == want:
        return None
    return f"{len(got)} and {len(want)} rows; only here {[r for r in got if r not in set(want)][:3]}; only in SQL {[r for r in want if r not in set(got)][:3]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from quern.plans import catalogue

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name in sys.argv[2:] or catalogue.QUERIES:
        begun = time.time()
        try:
            said = compare(spark, con, name, catalogue.QUERIES[name], catalogue.ORACLES.get(name), sf)
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok ' if said is None else 'BAD'} {name} {time.time() - begun:.1f}s {'' if name in catalogue.ORACLES else 'rows only '}{said or ''}", flush=True)
