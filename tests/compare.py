"""Order-insensitive comparison of a query's result with its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, (str, bool)):
        return str(v)
    if hasattr(v, "isoformat"):
        t = pd.Timestamp(v)
        return (t.tz_convert(None) if t.tzinfo else t).isoformat()
    try:
        return repr(round(float(v), 5))
    except (TypeError, ValueError):
        return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))
