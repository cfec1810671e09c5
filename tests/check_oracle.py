"""Run named queries and their SQL side by side: python tests/check_oracle.py [folder] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    df = entry.queries()[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"rows only: {len(got[1])}"
    cursor = con.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got == want:
        return True, f"{len(got[1])} rows"
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    extra = [r for r in got[1] if r not in set(want[1])][:3]
    missing = [r for r in want[1] if r not in set(got[1])][:3]
    return False, f"rows {len(got[1])} vs {len(want[1])}\n   spark only {extra}\n   sql only   {missing}"


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            good, note = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            good, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not good
        print("ok  " if good else "FAIL", name, f"{time.time() - start:.1f}s", note, flush=True)
    print(f"{len(names) - bad}/{len(names)} good")
