"""Quality and business filters, with an audit computed in one pass.

Every filter is a predicate Column first (so the audit can count all steps
in a single aggregate) and a ``DataFrame -> DataFrame`` function second.
Filters on plain columns reach the Parquet scan as pushed filters; the
boolean readers stay codegen'd expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casting import boolify, to_double
from . import ranks

# Statuses of a closed claim.
CLOSED_STATUSES = ["clos", "fermé", "closed"]


def dtype_of(df: DataFrame, c: str) -> str:
    return dict(df.dtypes)[c]


# ---- predicates -----------------------------------------------------------

def p_valid_claim(df: DataFrame, flag: str = "est_dans_sin_cluster") -> Column:
    return boolify(flag, dtype_of(df, flag))


def p_closed(status: str = "statut_sinistre", values: Sequence[str] = CLOSED_STATUSES) -> Column:
    return F.coalesce(F.lower(F.col(status)).isin(list(values)), F.lit(False))


NUMERIC_TYPES = ("double", "float", "int", "bigint", "smallint", "tinyint")


def num_col(df: DataFrame | None, c: str) -> Column:
    """A numeric column as is (so range predicates reach the Parquet scan;
    NaN sorts above every value, so an upper bound already excludes it),
    text through ``try_cast``."""
    kind = dict(df.dtypes).get(c, "").split("(")[0] if df is not None else ""
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return F.col(c)
    return F.col(c).cast("double") if kind in NUMERIC_TYPES else to_double(c)


def p_amount_range(target: str = "montant_charge_brut", lo: float = 10, hi: float = 500000,
                   df: DataFrame | None = None) -> Column:
    x = num_col(df, target)
    # no coalesce: a null predicate already drops the row, and a bare
    # comparison is what the Parquet reader can push down
    return (x >= lo) & (x <= hi)


def p_geocoded(df: DataFrame, flag: str = "geocoding_validity") -> Column:
    return boolify(flag, dtype_of(df, flag))


def p_date_range(date: str, start: str, end: str) -> Column:
    """start <= date <= end; the end bound is midnight of the end day."""
    d = F.col(date).cast("timestamp_ntz")
    s = F.lit(start).cast("timestamp_ntz")
    e = F.lit(end).cast("timestamp_ntz")
    return (d >= s) & (d <= e)


def p_risk_types(col: str, values: Sequence[str]) -> Column:
    return F.col(col).isin(list(values))


def p_range(col: str, lo: float | None = None, hi: float | None = None,
            lo_strict: bool = False, hi_strict: bool = False, df: DataFrame | None = None) -> Column:
    x = num_col(df, col)
    floating = df is not None and dict(df.dtypes).get(col) in ("double", "float")
    cond = x.isNotNull() & ~F.isnan(x) if floating and hi is None else x.isNotNull()
    if lo is not None:
        cond = cond & ((x > lo) if lo_strict else (x >= lo))
    if hi is not None:
        cond = cond & ((x < hi) if hi_strict else (x <= hi))
    return cond


# ---- filters --------------------------------------------------------------

def filter_valid_claim(df, flag="est_dans_sin_cluster"):
    return df.where(p_valid_claim(df, flag))


def filter_closed(df, status="statut_sinistre", max_levels=1000):
    """Rows of a closed status, whatever its case. Where the column has at most
    ``max_levels`` statuses, those that are closed are looked up first, so that
    the filter is a list that the Parquet reader can push down."""
    spelled = df.where(p_closed(status)).select(status).distinct().limit(max_levels + 1).collect()
    if len(spelled) > max_levels:
        return df.where(p_closed(status))
    return df.where(F.col(status).isin([r[0] for r in spelled]))


def building_age_bounds(year: str, ref_year: int, lo: float, hi: float, df: DataFrame | None = None) -> Column:
    """lo <= ref_year - year <= hi, written as bounds on the year."""
    return p_range(year, ref_year - hi, ref_year - lo, df=df)


def filter_amount_range(df, target="montant_charge_brut", lo=10, hi=500000):
    return df.where(p_amount_range(target, lo, hi, df))


def filter_geocoded(df, flag="geocoding_validity"):
    return df.where(p_geocoded(df, flag))


def filter_date_range(df, date="date_sinistre", start="2018-01-01", end="2025-12-31"):
    return df.where(p_date_range(date, start, end))


def filter_risk_types(df, col="risque_rga_gcl", values=("faible", "moyen", "fort", "maximal")):
    return df.where(p_risk_types(col, values))


def filter_surface_range(df, col="surface_police", lo=10, hi=1000):
    return df.where(p_range(col, lo, hi, df=df))


def drop_null_target(df, target="montant_charge_brut"):
    return df.na.drop(subset=[target])


def dedup_claims(df: DataFrame, keys: Sequence[str] = ("police", "cod_sin"),
                 order_by: Sequence[str] = ()) -> DataFrame:
    """Keep the first row per key, first by ``order_by`` (then by the other
    columns, so the choice is deterministic); null keys equal each other.

    Written as ``groupBy(keys).agg(min(struct))`` rather than a row_number
    window: the aggregate combines map-side, so a key holding a third of the
    rows is reduced inside each task before the shuffle.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order = [c for c in order_by if c in rest] + [c for c in rest if c not in order_by]
    if not rest:
        return df.dropDuplicates(keys)
    packed = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_first"))
    return packed.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order]).select(*df.columns)


def filter_extreme_iqr(df: DataFrame, target: str) -> DataFrame:
    """If any value lies outside Q1-1.5 IQR .. Q3+1.5 IQR, keep only rows within
    Q1-3 IQR .. Q3+3 IQR (null targets fall out); else keep all rows."""
    q1, q3 = ranks.quantile_values(df, target, [0.25, 0.75])
    if q1 is None:
        return df
    iqr = q3 - q1
    x = F.col(target)
    any_out = df.where((x < q1 - 1.5 * iqr) | (x > q3 + 1.5 * iqr)).limit(1).count() > 0
    if not any_out:
        return df
    return df.where(F.coalesce((x >= q1 - 3 * iqr) & (x <= q3 + 3 * iqr), F.lit(False)))


def having_min_count(grouped: DataFrame, k: int, count_col: str = "n") -> DataFrame:
    return grouped.where(F.col(count_col) >= k)


# ---- audit ------------------------------------------------------------------

def filter_audit(df: DataFrame, steps: Sequence[tuple[str, Column]],
                 dedup_keys: Sequence[str] | None = None) -> DataFrame:
    """Rows removed / remaining / retention for each cumulative step, from the
    true input count (every step is logged, including those that remove
    nothing). All predicate steps are counted by one aggregate; the final
    dedup step (if any) by a distinct-key count over the surviving rows."""
    cum = F.lit(True)
    aggs = [F.count(F.lit(1)).alias("s0")]
    for i, (_, p) in enumerate(steps, 1):
        cum = cum & p
        aggs.append(F.count(F.when(cum, F.lit(1))).alias(f"s{i}"))
    counts = df.agg(*aggs)
    names = ["input"] + [s[0] for s in steps]
    if dedup_keys:
        kept = df.where(cum).select(*dedup_keys).distinct().agg(F.count(F.lit(1)).alias(f"s{len(steps) + 1}"))
        counts = counts.crossJoin(kept)
        names.append("dedup")
    stack = ", ".join(f"{i}, '{n}', cast(s{i} as bigint)" for i, n in enumerate(names))
    long = counts.selectExpr(f"stack({len(names)}, {stack}) as (step, filter, remaining)", "s0")
    # the step table has one row per step: a window over it is bounded
    prev = F.lag("remaining").over(Window.orderBy("step"))
    return long.select(
        "step",
        "filter",
        F.coalesce(prev - F.col("remaining"), F.lit(0)).cast("bigint").alias("removed"),
        "remaining",
        F.round(F.try_divide(F.col("remaining") * 100.0, prev), 1).alias("retention"),
        F.round(F.try_divide(F.col("remaining") * 100.0, F.col("s0")), 1).alias("overall_retention"),
    )
