"""Runs queries beside their SQL and compares: python tests/check_oracle.py SF_DIR [NAME...]"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, pd.Timestamp):
            return str(v.date())
        if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
            return bool(v)
        if isinstance(v, (int, float)) or hasattr(v, "item"):
            return float(v)
        return str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(cell(v) for v in row) for row in df.itertuples(index=False)), key=repr)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> str:
    t = time.time()
    got = query(spark, sf_dir).toPandas()
    t1 = time.time()
    want = con.execute(sql).fetch_df()
    t2 = time.time()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if a == b:
        return f"ok {len(a)} rows, {t1 - t:.1f} s, SQL {t2 - t1:.1f} s"
    x, y = set(a) - set(b), set(b) - set(a)
    return f"differ: {len(a)} and {len(b)} rows, {len(x)} and {len(y)} apart, {sorted(x, key=repr)[:2]} {sorted(y, key=repr)[:2]} ({sorted(got.columns)})"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries = connect(sys.argv[1]), entry.queries()
    for name, sql in entry.oracle_sql().items():
        if len(sys.argv) < 3 or name in sys.argv[2:]:
            try:
                print(name, compare(spark, con, sys.argv[1], name, queries[name], sql), flush=True)
            except Exception as e:
                print(name, "ERROR", type(e).__name__, str(e)[:400].replace("\n", " "), flush=True)
