"""Distributed order statistics: ranks, exact quantiles, group summaries.

Quantiles, trimmed means and group summaries come from bracket selection
(:mod:`selection`), rank tests from the rank table below. Nothing here uses an
unpartitioned window or Spark's exact ``percentile`` (which keeps every distinct
value of a group in one aggregation buffer). The rank table:

1. ``groupBy(keys, value).count()`` - map-side combined, so a value that holds
   a third of the rows shrinks to one row per task before the shuffle;
2. ``percentile_approx`` edges over those distinct rows (a bounded list of
   at most ``DEFAULT_MAX_BUCKETS`` doubles, fetched once and inlined as a
   literal, so the plan does not embed its input twice) give each row a
   deterministic value bucket (binary search in a SQL lambda);
3. bucket totals (|keys| x buckets rows) -> running offsets per key;
4. a window partitioned by (keys, bucket), ordered by value, adds the counts
   of smaller values inside the bucket.

The result has one row per (keys, value): ``cnt`` (rows with that value),
``before`` (rows of the same keys with a smaller value) and ``n`` (rows of the
keys). Average ranks are then plain expressions over it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import selection

DEFAULT_MAX_BUCKETS = 4096

def _n_buckets(df: DataFrame, buckets: int | None) -> int:
    if buckets:
        return int(buckets)
    try:
        p = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover - conf always set in a session
        p = 200
    return max(4, min(DEFAULT_MAX_BUCKETS, 2 * p))


def _bucket_expr(value: str, edges: str, n_edges: int) -> Column:
    """Number of edges strictly below ``value`` (lower bound), by binary search."""
    steps = max(1, math.ceil(math.log2(n_edges + 1)) + 1)
    return F.expr(
        f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', size({edges})), "
        f"(acc, i) -> if(acc.lo < acc.hi, "
        f"if({edges}[cast((acc.lo + acc.hi) div 2 as int)] < `{value}`, "
        f"named_struct('lo', cast((acc.lo + acc.hi) div 2 as int) + 1, 'hi', acc.hi), "
        f"named_struct('lo', acc.lo, 'hi', cast((acc.lo + acc.hi) div 2 as int))), acc), "
        f"acc -> acc.lo)"
    )


def _key_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on bucket and keys, null keys equal to each other."""
    if not keys:
        return left.join(right, "_b")
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_b").alias("_r_b"),
                     *[c for c in right.columns if c not in keys and c != "_b"])
    cond = [left["_b"] == F.col("_r_b")] + [left[k].eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(r, cond).drop("_r_b", *[f"_r_{k}" for k in keys])


def with_value_range(counts: DataFrame, df: DataFrame, value: str, buckets: int | None = None) -> DataFrame:
    """Adds ``_b``, the range of ``value``: ranges end at approximate quantiles
    of ``df``, a bounded list fetched once and inlined."""
    nb = _n_buckets(df, buckets)
    edges = df.agg(F.percentile_approx(value, [i / nb for i in range(1, nb)], min(10000, 100 * nb))).first()[0]
    edges = sorted({float(e) for e in (edges or []) if e is not None})
    if not edges:
        return counts.withColumn("_b", F.lit(0))
    arr = F.array(*[F.lit(e) for e in edges])
    return counts.withColumn("_edges", arr).withColumn("_b", _bucket_expr(value, "_edges", len(edges))).drop("_edges")


def cumulative_counts(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    by: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """One row per (keys, value[, by]) with ``cnt``, ``t`` (rows with that value
    across all ``by`` levels), ``before`` (rows of the keys with a smaller
    value) and ``n`` (rows of the keys). Null values are left out.

    ``by`` splits the counts of a value by a second column (the sample of a
    rank test) without changing the ranking, which stays over all levels.

    The value range is cut into buckets (their number follows the shuffle
    partitions unless given) at approximate quantile edges, so no task sorts
    more than its share of a group.
    """
    keys = list(keys)
    grp = keys + [value] + ([by] if by else [])
    nn = df.where(F.col(value).isNotNull())
    vc = nn.groupBy(*grp).agg(F.count(F.lit(1)).alias("cnt"))
    vb = with_value_range(vc, nn, value, buckets)
    bt = vb.groupBy(*keys, "_b").agg(F.sum("cnt").alias("_bt"), F.sum(F.col("cnt") * F.col(value)).alias("_bs"))
    wk = Window.partitionBy(*keys).orderBy("_b")
    bt = bt.select(
        *keys,
        "_b",
        F.coalesce(F.sum("_bt").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_bt").over(Window.partitionBy(*keys)).alias("n"),
        F.sum("_bs").over(Window.partitionBy(*keys)).alias("s1"),
    )
    j = _key_join(vb, bt, keys)
    w = Window.partitionBy(*keys, "_b").orderBy(value)
    incl = F.sum("cnt").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    t = F.sum("cnt").over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return j.select(
        *grp,
        "cnt",
        t.alias("t"),
        (F.col("_off") + incl - t).alias("before"),
        "n",
        "s1",
    )


def average_rank() -> Column:
    """Average rank of the value on a ``cumulative_counts`` row (ties share)."""
    return F.col("before") + (F.col("t") + F.lit(1)) / 2.0


def _frame(df: DataFrame, keys: Sequence[str], rows: list[tuple], cols: str) -> DataFrame:
    """A small result as a table: the keys with their types, then ``cols``."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields]
    return df.sparkSession.createDataFrame(rows, ", ".join([*kinds, cols]))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    names: Sequence[str] | None = None,
    buckets: int | None = None,
    parts: bool = False,
) -> DataFrame:
    """Linear-interpolated quantiles (pandas default, DuckDB ``quantile_cont``)
    per group of ``keys``; one row per group with values, one column per
    probability. With ``parts`` also the two order statistics and the fraction
    behind each quantile (``<name>__a``, ``<name>__b``, ``<name>__f``) and the
    group's non-null count ``n``: a monotone map of the values (a clip) maps
    the order statistics, so derived quantiles stay exact. ``buckets`` asks for
    the rank table with that many value ranges instead."""
    keys = list(keys)
    names = list(names) if names else [f"q{round(p * 100, 6):g}" for p in probs]
    if buckets:
        return _ranked_quantiles(df, value, probs, keys, names, parts, buckets)
    marks = [selection.Quantile(name, float(p)) for name, p in zip(names, probs)]
    found = selection.select(df, [value], keys, marks, moments=False)
    if found is None:
        return _ranked_quantiles(df, value, probs, keys, names, parts)
    cols = [f"`{n}` double" for n in names]
    if parts:
        cols += ["n bigint"] + [f"`{n}__{x}` double" for n in names for x in "abf"]
    rows = []
    for s in found:
        if s.n or not keys:
            more = [s.n] + [x for n in names for x in s.marks.get(n, (None, None, None))] if parts else []
            rows.append((*s.keys, *[s.quantile(n) for n in names], *more))
    return _frame(df, keys, rows, ", ".join(cols))


def _ranked_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: list[str], names: list[str], parts: bool = False,
                      buckets: int | None = None) -> DataFrame:
    """``exact_quantiles`` from the rank table, for very many groups."""
    cc = cumulative_counts(df, value, keys, buckets=buckets)
    hit = []
    aggs = []
    nm1 = F.col("n") - 1
    for i, (p, name) in enumerate(zip(probs, names)):
        h = nm1 * F.lit(float(p))
        lo = F.floor(h)
        hi = F.least(lo + 1, nm1)
        has_lo = (F.col("before") <= lo) & (lo < F.col("before") + F.col("cnt"))
        has_hi = (F.col("before") <= hi) & (hi < F.col("before") + F.col("cnt"))
        hit += [has_lo, has_hi]
        cc = cc.withColumn(f"_lo{i}", F.when(has_lo, F.col(value))).withColumn(
            f"_hi{i}", F.when(has_hi, F.col(value))
        ).withColumn(f"_fr{i}", h - lo)
        aggs.append((name, f"_lo{i}", f"_hi{i}", f"_fr{i}"))
    cond = hit[0]
    for c in hit[1:]:
        cond = cond | c
    red = cc.where(cond).groupBy(*keys).agg(
        *[F.max(lo).alias(lo) for _, lo, _, _ in aggs],
        *[F.max(hi).alias(hi) for _, _, hi, _ in aggs],
        *[F.max(fr).alias(fr) for _, _, _, fr in aggs],
        F.max("n").alias("_n"),
    )
    extra = []
    if parts:
        extra = [F.col("_n").alias("n")] + [c for name, lo, hi, fr in aggs for c in (
            F.col(lo).alias(f"{name}__a"), F.col(hi).alias(f"{name}__b"), F.col(fr).alias(f"{name}__f"))]
    return red.select(
        *keys,
        *[(F.col(lo) + F.col(fr) * (F.col(hi) - F.col(lo))).alias(name) for name, lo, hi, fr in aggs],
        *extra,
    )


def trim_counts(lower: float, upper: float, min_n: int):
    """Sizes of the sorted head that a trimmed mean leaves out and ends at:
    positions [int(lower*n), max(int(upper*n), 1)); all rows below ``min_n``."""
    start = lambda n: math.floor(n * lower) if n >= min_n else 0
    end = lambda n: max(math.floor(n * upper), 1) if n >= min_n else n
    return start, end


def trimmed_means(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    lower: float = 0.05,
    upper: float = 0.95,
    min_n: int = 20,
    name: str = "trimmed_mean",
) -> DataFrame:
    """Mean of sorted positions [int(lower*n), max(int(upper*n), 1)) per group;
    plain mean below ``min_n`` rows."""
    return group_summary(df, value, keys, (), {}, name, trim=(lower, upper, min_n))


def quantile_values(df: DataFrame, value: str, probs: Sequence[float]) -> list:
    """Exact global quantiles as Python floats (a fence of ``len(probs)``
    values, computed by the distributed plan above and fetched once)."""
    marks = [selection.Quantile(f"_q{i}", float(p)) for i, p in enumerate(probs)]
    (found,) = selection.select(df, [value], (), marks, moments=False)
    return [found.quantile(m.name) for m in marks]


def lit_or_null(v) -> Column:
    return F.lit(v).cast("double") if v is not None else F.lit(None).cast("double")


MOMENT_MEASURES = ("count", "mean", "std", "var", "min", "max", "sum", "skew", "kurt", "cv", "std_pop")


def group_summary(df: DataFrame, value: str, keys: Sequence[str] = (), measures: Sequence[str] = ("count", "mean", "std"),
                  quantiles: dict | None = None, trimmed: str | None = None,
                  trim: tuple[float, float, int] = (0.05, 0.95, 20)) -> DataFrame:
    """Moments, exact quantiles and trimmed mean of ``value`` per key group
    with values, by bracket selection (two scans, see :mod:`selection`)."""
    keys = list(keys)
    marks = [selection.Quantile(name, float(p)) for name, p in (quantiles or {}).items()]
    start, end = trim_counts(*trim)
    if trimmed:
        marks += [selection.SumOfSmallest("_head", trim[0], start), selection.SumOfSmallest("_upto", trim[1], end)]
    found = selection.select(df, [value], keys, marks, moments=any(m not in ("count", "sum", "min", "max") for m in measures))
    if found is None:
        return _ranked_summary(df, value, keys, measures, quantiles, trimmed, trim)
    rows = []
    for s in found:
        if s.n or not keys:
            row = [s.measure(m) for m in measures] + [s.quantile(q) for q in (quantiles or {})]
            if trimmed:
                many = end(s.n) - start(s.n)
                row.append((s.marks["_upto"] - s.marks["_head"]) / many if s.n and many > 0 else None)
            rows.append((*s.keys, *row))
    cols = [f"`{m}` {'bigint' if m == 'count' else 'double'}" for m in measures] + [f"`{q}` double" for q in (quantiles or {})]
    return _frame(df, keys, rows, ", ".join(cols + ([f"`{trimmed}` double"] if trimmed else [])))


def _ranked_summary(df: DataFrame, value: str, keys: list[str], measures: Sequence[str], quantiles: dict | None,
                    trimmed: str | None, trim: tuple[float, float, int]) -> DataFrame:
    """``group_summary`` from one rank table and one final aggregate, for very
    many groups.

    Moments are two-pass over the (value, count) rows: the per-key mean comes
    from the window stage, central sums from the final aggregate (exact
    variance, no cancellation)."""
    cc = cumulative_counts(df, value, keys)
    v, c = F.col(value), F.col("cnt")
    n = F.col("n")
    mean = F.col("s1") / n
    dv = v - mean
    aggs = [F.first("n").alias("_n"), F.first("s1").alias("_s1"), F.sum(c * dv * dv).alias("_m2"),
            F.sum(c * dv * dv * dv).alias("_m3"), F.sum(c * dv * dv * dv * dv).alias("_m4"),
            F.min(v).alias("_min"), F.max(v).alias("_max")]
    picks = []
    for i, (name, p) in enumerate((quantiles or {}).items()):
        h = (n - 1) * F.lit(float(p))
        lo = F.floor(h)
        hi = F.least(lo + 1, n - 1)
        has_lo = (F.col("before") <= lo) & (lo < F.col("before") + c)
        has_hi = (F.col("before") <= hi) & (hi < F.col("before") + c)
        aggs += [F.max(F.when(has_lo, v)).alias(f"_lo{i}"), F.max(F.when(has_hi, v)).alias(f"_hi{i}"),
                 F.max(h - lo).alias(f"_fr{i}")]
        picks.append((name, i))
    if trimmed:
        lower, upper, min_n = trim
        a = F.when(n >= min_n, F.floor(n * lower)).otherwise(F.lit(0))
        b = F.when(n >= min_n, F.greatest(F.floor(n * upper), F.lit(1))).otherwise(n)
        ov = F.greatest(F.least(b, F.col("before") + c) - F.greatest(a, F.col("before")), F.lit(0))
        aggs += [F.sum(v * ov).alias("_tw"), F.sum(ov).alias("_tn")]
    r = cc.groupBy(*keys).agg(*aggs)
    nn = F.col("_n").cast("double")
    m2, m3, m4 = F.col("_m2"), F.col("_m3"), F.col("_m4")
    var = F.when(nn >= 2, m2 / (nn - 1))
    # a constant group has skewness and excess kurtosis 0 (pandas), not null
    g1 = F.when(m2 > 0, F.sqrt(nn) * m3 / F.pow(m2, 1.5)).otherwise(F.lit(0.0))
    g2 = F.when(m2 > 0, nn * m4 / (m2 * m2) - 3).otherwise(F.lit(-6.0) / (nn + 1))
    expr = {
        "count": F.col("_n"),
        "sum": F.col("_s1"),
        "mean": F.col("_s1") / nn,
        "var": var,
        "std": F.sqrt(var),
        "std_pop": F.sqrt(m2 / nn),
        "min": F.col("_min"),
        "max": F.col("_max"),
        "skew": F.when(nn >= 3, g1 * F.sqrt(nn * (nn - 1)) / (nn - 2)),
        "kurt": F.when(nn >= 4, (nn - 1) / ((nn - 2) * (nn - 3)) * ((nn + 1) * g2 + 6)),
        "cv": F.try_divide(F.sqrt(var), F.col("_s1") / nn),
        "jarque_bera": F.when(m2 > 0, nn / 6 * (nn * m3 * m3 / (m2 * m2 * m2) + (nn * m4 / (m2 * m2) - 3) * (nn * m4 / (m2 * m2) - 3) / 4)),
    }
    out = [*keys, *[expr[m].alias(m) for m in measures]]
    out += [(F.col(f"_lo{i}") + F.col(f"_fr{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(name) for name, i in picks]
    if trimmed:
        out.append(F.try_divide(F.col("_tw"), F.col("_tn")).alias(trimmed))
    return r.select(*out)
