"""Compare a query's rows with its SQL run by DuckDB on the same Parquet tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd

DATA = Path(os.environ.get("READLOOM_TESTDATA", "/root/testdata/sf0.01"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con.execute(sql).df()


def rows(df: pd.DataFrame) -> list[str]:
    cell = lambda v: "null" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted("|".join(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))
