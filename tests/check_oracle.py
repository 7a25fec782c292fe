"""Run registered queries and their SQL side by side: python tests/check_oracle.py FOLDER [name ...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _normal(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows[sorted(rows.columns)].copy()
    for name in rows.columns:
        if pd.api.types.is_datetime64_any_dtype(rows[name]):
            rows[name] = rows[name].astype("datetime64[us]")
    return rows.sort_values(list(rows.columns), ignore_index=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if both hold the same rows (doubles exactly), else a short description."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    got, want = _normal(got), _normal(want)
    for name in got.columns:
        if str(got[name].dtype) != str(want[name].dtype):
            return f"{name}: {got[name].dtype} != {want[name].dtype}"
        same = (got[name] == want[name]) | (got[name].isna() & want[name].isna())
        if not same.all():
            row = (~same).idxmax()
            return f"{name}: {(~same).sum()} differ, first {got.loc[row].to_dict()} != {want.loc[row].to_dict()}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from ratemill.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql, bad = connect(folder), oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        got = query(spark, folder).toPandas()
        took = time.time() - start
        if name not in sql:
            print(f"{name:24} {took:6.2f}s rows {len(got)} (no SQL)", flush=True)
            continue
        start = time.time()
        problem = difference(got, connection.execute(sql[name]).df())
        bad += problem is not None
        print(f"{name:24} {took:6.2f}s sql {time.time() - start:5.2f}s rows {len(got):7} {problem or 'ok'}", flush=True)
    print("mismatches:", bad)
