"""Run queries and their SQL side by side: python tests/compare.py SF_DIR [NAME...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frames(spark, name, sf_dir, q, o):
    got = q[name](spark, sf_dir).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return got, con.execute(o[name]).df() if name in o else None


def same(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} {sorted(b.columns)}"
    key = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    x, y = key(a), key(b)
    return "" if x == y else f"{len(x)} and {len(y)} rows; only left {list(set(x) - set(y))[:2]}; only right {list(set(y) - set(x))[:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    q, o = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or q:
        t = time.time()
        try:
            a, b = frames(spark, name, sys.argv[1], q, o)
            print(name, len(a), "no SQL" if b is None else same(a, b) or "same", f"{time.time() - t:.1f} s", flush=True)
            if b is None:
                print(a.head(3).to_string()[:600])
        except Exception as x:
            print(name, "FAILED", str(x)[:1500], flush=True)
