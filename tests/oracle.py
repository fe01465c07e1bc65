"""Local stand-in for the driver's correctness gate: run a registered Spark
query and its DuckDB oracle on the same Parquet tables and compare names,
row count and values (order-insensitive)."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import pandas as pd

from sinistra.sources.claims import TABLES


def duck(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).df()


def _cell(v, digits):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, digits)
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        return pd.Timestamp(v).tz_localize(None).isoformat() if getattr(v, "tzinfo", None) else pd.Timestamp(v).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _cell(v.item(), digits)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    return v


def canon(pdf: pd.DataFrame, digits: int = 6) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = [tuple(_cell(v, digits) for v in r) for r in pdf[cols].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame, rel: float = 1e-9) -> str | None:
    """None when equal, else a short reason."""
    a, b = sorted(spark_pdf.columns), sorted(duck_pdf.columns)
    if a != b:
        return f"columns differ: spark={a} duck={b}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows differ: spark={len(spark_pdf)} duck={len(duck_pdf)}"
    ra, rb = canon(spark_pdf, 12), canon(duck_pdf, 12)
    for x, y in zip(ra, rb):
        for c, u, v in zip(a, x, y):
            if u is None or v is None:
                if u is not v and not (u is None and v is None):
                    return f"null mismatch in {c}: {u!r} vs {v!r}"
                continue
            if isinstance(u, float) and isinstance(v, float):
                if abs(u - v) > rel * max(1.0, abs(u), abs(v)):
                    return f"value mismatch in {c}: {u!r} vs {v!r}"
            elif u != v:
                return f"value mismatch in {c}: {u!r} vs {v!r}"
    return None
