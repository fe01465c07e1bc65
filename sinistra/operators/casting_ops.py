"""Schema-shaping operators: type promotion, sparse-column removal and
conforming a table to the claim schema. Decisions that change the schema
come from one aggregate (a handful of counts per column)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casting import to_double, to_timestamp_any

# Name fragments that mark a date column.
DATE_NAME_HINTS = ("date", "time", "timestamp")


def promote_numeric(df: DataFrame, cols: Sequence[str] | None = None, min_share: float | None = None,
                    protect: Sequence[str] = ()) -> DataFrame:
    """Text columns become double when every non-null value parses
    (``min_share=None``) or when the parsed share of all rows exceeds
    ``min_share``. Protected id columns are never promoted."""
    cand = [c for c in (cols or [c for c, t in df.dtypes if t == "string"]) if c not in protect]
    if not cand:
        return df
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cand)],
                 *[F.count(to_double(F.trim(F.col(c)))).alias(f"p{i}") for i, c in enumerate(cand)]).first()
    rows = one["_rows"]
    promote = set()
    for i, c in enumerate(cand):
        if min_share is None:
            if one[f"n{i}"] > 0 and one[f"p{i}"] == one[f"n{i}"]:
                promote.add(c)
        elif rows and one[f"p{i}"] / rows > min_share:
            promote.add(c)
    return df.select(*[to_double(F.trim(F.col(c))).alias(c) if c in promote else F.col(f"`{c}`") for c in df.columns])


def promote_dates_by_name(df: DataFrame, hints: Sequence[str] = DATE_NAME_HINTS) -> DataFrame:
    """Text columns whose name contains a date hint become timestamps."""
    out = []
    for c, t in df.dtypes:
        if t == "string" and any(h in c.lower() for h in hints):
            out.append(to_timestamp_any(c).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def drop_sparse_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Drop columns whose null share exceeds ``threshold`` (one count agg)."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    rows = one["_rows"] or 0
    drop = [c for i, c in enumerate(df.columns) if rows and (rows - one[f"n{i}"]) / rows > threshold]
    return df.drop(*drop)


def conform_schema(df: DataFrame, renames: Mapping[str, str], defaults: Mapping[str, object],
                   types: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rename matched columns, add missing business columns with a default,
    cast with ``try_cast``. Returns the table and a report of the share of
    non-null values each cast lost."""
    d = df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})
    for c, v in defaults.items():
        if c not in d.columns:
            d = d.withColumn(c, F.lit(v))
    before = {c: F.col(c) for c in types if c in d.columns}
    rep = d.agg(*[F.count(x).alias(f"b_{c}") for c, x in before.items()],
                *[F.count(x.try_cast(types[c])).alias(f"a_{c}") for c, x in before.items()])
    parts = [F.struct(F.lit(c).alias("variable"), F.lit(types[c]).alias("type"),
                      F.col(f"b_{c}").cast("bigint").alias("non_null_before"),
                      F.col(f"a_{c}").cast("bigint").alias("non_null_after"),
                      F.try_divide((F.col(f"b_{c}") - F.col(f"a_{c}")) * 1.0, F.col(f"b_{c}")).alias("lost_share"))
             for c in before]
    report = rep.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
    table = d.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in d.columns])
    return table, report
