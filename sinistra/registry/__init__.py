"""Registered queries: key -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)``, reads the given tables and returns a
DataFrame; the oracle SQL runs in DuckDB over the same Parquet tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.claims import with_claims


@dataclass(frozen=True)
class Entry:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: str | None = None, claims: bool = True):
    """Decorator: register ``fn(spark, sf_dir)`` under ``key``. ``sql`` is a
    query over the ``claims`` view (prefixed with its CTE unless
    ``claims=False``)."""

    def deco(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate key {key}")
        full = None if sql is None else (with_claims(sql) if claims else sql)
        REGISTRY[key] = Entry(key, fn, full)
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    from . import (  # noqa: F401
        q_sources, q_casting, q_filters, q_joins, q_aggregates, q_windows, q_scalars, q_binning,
        q_tests, q_domain, q_temporal, q_models, q_charts, q_suites,
    )
    return REGISTRY
