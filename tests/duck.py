"""Queries against DuckDB: rows as sorted tuples of text, floats to six digits."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _text(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return "null"
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return f"{float(v):.6g}"
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(_text(v) for v in r) for r in df.itertuples(index=False))
