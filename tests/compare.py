"""Runs queries in Spark and their SQL in DuckDB and compares the rows. python tests/compare.py SF_DIR [NAME...]"""

import glob
import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {Path(p).stem} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def rows_of(names, rows):
    """Rows with columns by name, floats rounded, in order."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(names), sorted(tuple(value(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """None if both agree, else a text."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    res = con.execute(sql)
    want = rows_of([d[0] for d in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return f"{len(got[1])} and {len(want[1])} rows; only Spark: {sorted(a)[:3]}; only SQL: {sorted(b)[:3]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, sql = duck(sf_dir), entry.oracle_sql()
    for name, q in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            if name in sql:
                said = compare(spark, con, name, q, sql[name], sf_dir) or "same"
            else:
                said = f"no SQL, {q(spark, sf_dir).count()} rows"
        except Exception as e:
            said = f"FAILED {str(e)[:600]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
