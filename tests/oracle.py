"""Compare a DataFrame with the rows of DuckDB SQL over the same tables."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir, **own):
    con = duckdb.connect()
    for name in TABLES:
        if name in own:
            con.register(name, own[name])
        elif os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, (float, np.floating)) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    return float(v) if isinstance(v, (float, np.floating)) else v


def rows(df: pd.DataFrame) -> list[str]:
    columns = sorted(df.columns)
    # Pandas makes floats of whole numbers with nulls: compare them as whole numbers.
    whole = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v
    return sorted(repr(tuple(whole(plain(v)) for v in r)) for r in df[columns].astype(object).itertuples(index=False, name=None))


def same(spark_df, con, sql):
    got, want = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
