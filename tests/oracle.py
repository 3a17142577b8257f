"""Runs a query and its SQL and compares the rows."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    """Nulls as None, numbers rounded and whole ones as integers: columns with nulls come as floats from one side."""
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, float):
        v = round(float(v), 9)
        return str(int(v)) if v.is_integer() else v
    return str(v)


def plain(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(value, r)) for r in df.astype(object).itertuples(index=False)), key=repr)


def same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
