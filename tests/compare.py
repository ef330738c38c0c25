"""Run queries beside their SQL on the same tables: python -m tests.compare [folder] [query ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
            return bool(v)
        if hasattr(v, "item"):
            v = v.item()
        if type(v).__name__ == "Decimal":
            v = float(v)
        return round(v, 9) if isinstance(v, float) else v

    df = df[sorted(df.columns)]
    return sorted((tuple(cell(v) for v in r) for r in df.itertuples(index=False)), key=repr)


def differences(spark, folder: str, f, sql: str, con) -> str | None:
    got, want = f(spark, folder).toPandas(), con.execute(sql).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if a == b:
        return None
    only = [x for x in a if x not in b][:2], [x for x in b if x not in a][:2]
    return f"rows {len(a)} {len(b)}: {only}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from shutterlake.session import local_session

    folder, names = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"), sys.argv[2:]
    spark, con, sqls, bad = local_session(8), connect(folder), e.oracle_sql(), 0
    for name, f in e.queries().items():
        if name in sqls and (not names or name in names):
            t = time.time()
            try:
                d = differences(spark, folder, f, sqls[name], con)
            except Exception as x:
                d = str(x)[:500]
            bad += d is not None
            if d:
                print(name, round(time.time() - t, 1), d, flush=True)
    print("differing:", bad, "of", len(sqls))
