"""Run named queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c] + 0.0
    return df.sort_values(list(df.columns), ignore_index=True)


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None when both frames hold the same rows, else what differs."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    a, b = canonical(left), canonical(right)
    for c in a.columns:
        if (a[c].dtype.kind in "iu") != (b[c].dtype.kind in "iu"):
            return f"type of {c}: {a[c].dtype} != {b[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            at = same.idxmin()
            return f"{c}: {(~same).sum()} rows, first\n{a.loc[at].to_dict()}\n{b.loc[at].to_dict()}"
    return None


def session(cores: int = 8, shuffle: int = 8, shared: str | None = None):
    from pyspark.sql import SparkSession

    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("compare")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    import __spark_entry__ as entry

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    con, spark = connect(sf_dir), session()
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        t0 = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            t1 = time.time()
            if name in oracles:
                want = con.sql(oracles[name]).df()
                result = difference(got, want) or "ok"
            else:
                result = "rows only"
        except Exception as err:  # report and go on
            t1 = time.time()
            result, got = f"error {type(err).__name__}: {str(err)[:1500]}", []
        if result not in ("ok", "rows only"):
            bad.append(name)
        print(f"{name:28s} rows={len(got):7d} spark={t1 - t0:6.2f}s sql={time.time() - t1:6.2f}s {result}", flush=True)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
