"""Compare registered queries with their SQL on DuckDB: ``python -m tests.oracle SF [NAME...]``."""

import math
import sys
import time
from datetime import date, datetime

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores=8, partitions=8):
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("freshet-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, date):
        return datetime(v.year, v.month, v.day).isoformat()
    return repr(v)


def compare(spark, con, fn, sql, sf_dir):
    """Differences between the two results, as text; empty where they agree."""
    df = fn(spark, sf_dir)
    order = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in order) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != order:
        return f"columns {order} != {sorted(names)}"
    raw = result.fetchall()
    at = [names.index(c) for c in order]
    want = sorted(tuple(_plain(r[k]) for k in at) for r in raw)
    if got == want:
        return ""
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(got)} rows != {len(want)} rows, {len(wrong)} differ, first {order}: {wrong[:3]}"


def main(sf, *names):
    from __spark_entry__ import oracle_sql, queries

    sf_dir = f"/root/testdata/{sf}"
    spark, con = session(), connect(sf_dir)
    oracles = oracle_sql()
    for name, fn in queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            if name in oracles:
                said = compare(spark, con, fn, oracles[name], sf_dir) or "ok"
            else:
                said = f"{fn(spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001  (report and go on with the next query)
            said = f"ERROR {str(e)[:600]}"
        print(f"{name:26s} {time.time() - began:6.2f}s  {said}", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
