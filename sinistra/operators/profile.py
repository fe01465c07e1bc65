"""Table profiles: describe, missing values, dictionaries, overviews.

Design rule: moment statistics of all columns come from ONE wide aggregate
(no data expansion), reshaped with ``stack`` on the one-row result; exact
quantiles of all columns come from bracket selection over all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casting import to_double
from . import ranks, selection
from .summary import join_keys, modes

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if t.split("(")[0] in NUMERIC and c not in exclude]


def text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and c not in exclude]


def _stacked(one: DataFrame, cols: Sequence[str], stats: Sequence[str], var: str = "variable") -> DataFrame:
    """One-row wide result ``{stat}__{i}`` -> one row per column."""
    parts = []
    for i, c in enumerate(cols):
        parts.append(F.struct(F.lit(c).alias(var), *[F.col(f"{s}__{i}").alias(s) for s in stats]))
    return one.select(F.explode(F.array(*parts)).alias("_r")).select("_r.*")


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: dict[str, float]) -> dict[str, selection.Selected]:
    """Exact quantiles of many columns by bracket selection over all of them at
    once: column -> ``Selected`` (quantiles, order statistics, count)."""
    marks = [selection.Quantile(name, p) for name, p in probs.items()]
    typed = df.select(*[to_double(c).alias(c) for c in cols])
    return {s.value: s for s in selection.select(typed, list(cols), (), marks, moments=False)}


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, full: bool = True) -> DataFrame:
    """Per numeric column: count, mean, std, min, q25, median, q75, max and
    (``full``) missing count/percent, skewness, kurtosis, cv, q05, q95, iqr.

    Two scans over all columns together (bracket selection); the row count
    comes from a scan that reads no column."""
    cols = list(cols) if cols else numeric_columns(df)
    probs = {"q25": 0.25, "median": 0.5, "q75": 0.75} | ({"q05": 0.05, "q95": 0.95} if full else {})
    marks = [selection.Quantile(name, p) for name, p in probs.items()]
    typed = df.select(*[to_double(c).alias(c) for c in cols])
    found = selection.select(typed, cols, (), marks)
    rows = []
    total = df.count() if full else 0
    for s in found:
        q = {name: s.quantile(name) for name in probs}
        row = [s.value, s.n, s.mean, s.measure("std"), s.low, q["q25"], q["median"], q["q75"], s.high]
        if full:
            std = s.measure("std")
            row += [total - s.n, (total - s.n) * 100.0 / total if total else None, s.measure("skew"), s.measure("kurt"),
                    std / s.mean if std is not None and s.mean else None, q["q05"], q["q95"], q["q75"] - q["q25"] if s.n else None]
        rows.append(tuple(row))
    schema = "variable string, count bigint, mean double, std double, min double, q25 double, median double, q75 double, max double"
    if full:
        schema += ", missing_count bigint, missing_percent double, skewness double, kurtosis double, cv double, q05 double, q95 double, iqr double"
    return df.sparkSession.createDataFrame(rows, schema)


def target_distribution(df: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """count, mean, median, mode, std, var, skew, kurt, p1..p99, heavy tails,
    right skew, concentration (p90-p10)/median, Jarque-Bera (per group). Moments
    and quantiles come from two scans; the mode needs the counts of values."""
    keys = list(keys)
    d = df.select(*keys, to_double(target).alias("_x")).where(F.col("_x").isNotNull())
    pcts = {f"p{p}": p / 100 for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)}
    s = ranks.group_summary(d, "_x", keys, ("count", "mean", "std", "var", "skew", "kurt", "jarque_bera"), pcts)
    out = join_keys(s, modes(d, "_x", keys, "mode"), keys)
    return out.select(
        *keys, F.col("count").cast("bigint").alias("count"), "mean", F.col("p50").alias("median"), "mode", "std", "var",
        F.col("skew").alias("skewness"), F.col("kurt").alias("kurtosis"), *pcts,
        (F.col("kurt") > 3).alias("heavy_tails"), (F.col("skew") > 1).alias("right_skewed"),
        F.try_divide(F.col("p90") - F.col("p10"), F.col("p50")).alias("concentration_ratio"),
        "jarque_bera", F.exp(-F.col("jarque_bera") / 2).alias("jarque_bera_p"),
    )


def missing_profile(df: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Per column: null count, completeness % (and group of the catalogue)."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"n__{i}") for i, c in enumerate(cols)])
    parts = [F.struct(F.lit(c).alias("variable"), F.col(f"n__{i}").alias("non_null"), F.col("_rows").alias("rows"))
             for i, c in enumerate(cols)]
    st = one.select(F.explode(F.array(*parts)).alias("_r")).select("_r.*")
    st = st.select(
        "variable", F.col("non_null").cast("bigint").alias("non_null"),
        (F.col("rows") - F.col("non_null")).cast("bigint").alias("missing"),
        F.try_divide(F.col("non_null") * 100.0, F.col("rows")).alias("completeness_pct"),
    )
    if catalogue is not None:
        st = st.join(F.broadcast(catalogue), "variable", "left")
    return st


def data_dictionary(df: DataFrame, top: int = 3) -> DataFrame:
    """Per column: type, non-null, null, null %, distinct, min, max, mean, std
    (numeric), top-3 values as text."""
    cols = df.columns
    types = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        num = types[c].split("(")[0] in NUMERIC
        xd = to_double(x) if num else F.lit(None).cast("double")
        aggs += [
            F.count(x).alias(f"nn__{i}"),
            F.min(xd).alias(f"mn__{i}"), F.max(xd).alias(f"mx__{i}"), F.avg(xd).alias(f"av__{i}"),
            F.stddev_samp(xd).alias(f"sd__{i}"),
        ]
    one = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("variable"), F.lit(types[c]).alias("dtype"), F.col("_rows").alias("rows"),
                      F.col(f"nn__{i}").alias("non_null"),
                      F.col(f"mn__{i}").alias("min"), F.col(f"mx__{i}").alias("max"),
                      F.col(f"av__{i}").alias("mean"), F.col(f"sd__{i}").alias("std"))
             for i, c in enumerate(cols)]
    st = one.select(F.explode(F.array(*parts)).alias("_r")).select("_r.*")
    # top values: one unpivot of the text form, counts per (column, value)
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).unpivot([], cols, "variable", "_v")
    vc = long.where(F.col("_v").isNotNull()).groupBy("variable", "_v").agg(F.count(F.lit(1)).alias("_c"))
    tops = _top_values(vc, top)
    # exact distinct counts from the same (column, value) table: no Expand of
    # the input per column as several count(distinct) in one aggregate would
    nd = vc.groupBy("variable").agg(F.count(F.lit(1)).alias("distinct"))
    st = join_keys(st, nd, ["variable"])
    out = join_keys(st, tops, ["variable"])
    return out.select(
        "variable", "dtype", F.col("non_null").cast("bigint").alias("non_null"),
        (F.col("rows") - F.col("non_null")).cast("bigint").alias("null"),
        F.try_divide((F.col("rows") - F.col("non_null")) * 100.0, F.col("rows")).alias("null_pct"),
        F.col("distinct").cast("bigint").alias("distinct"), "min", "max", "mean", "std", "top_values",
    )


def _top_values(vc: DataFrame, top: int) -> DataFrame:
    """Top ``top`` values per variable by count (ties by value), as 'v (n)'
    text. Each round is one ``min(struct(-count, value))`` aggregate per
    variable (one struct of state, combined map-side) followed by removing
    the winner, so a column with billions of distinct values never lands in
    one window partition."""
    picks = None
    rest = vc
    for i in range(top):
        best = rest.groupBy("variable").agg(F.min(F.struct((-F.col("_c")).alias("nc"), F.col("_v").alias("v"))).alias("_m"))
        best = best.select("variable", F.lit(i).alias("_rn"), F.col("_m.v").alias("_v"), (-F.col("_m.nc")).alias("_c"))
        picks = best if picks is None else picks.unionByName(best)
        if i + 1 < top:
            # one row a variable: a map, not an exchange of the counts by variable
            rest = rest.join(F.broadcast(best.select("variable", "_v")), ["variable", "_v"], "left_anti")
    return picks.groupBy("variable").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("_rn", "_v", "_c"))),
                        lambda s: F.concat(s["_v"], F.lit(" ("), s["_c"].cast("string"), F.lit(")"))),
            ", ",
        ).alias("top_values")
    )


def dataset_overview(df: DataFrame, target: str, date: str) -> DataFrame:
    """Rows, columns, numeric/text column counts, total missing cells, mean and
    sum of the target, first/last date and duration in days."""
    cols = df.columns
    num = numeric_columns(df)
    txt = text_columns(df)
    miss = sum((F.count(F.lit(1)) - F.count(F.col(f"`{c}`")) for c in cols), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.lit(len(cols)).cast("bigint").alias("columns"),
        F.lit(len(num)).cast("bigint").alias("numeric_columns"),
        F.lit(len(txt)).cast("bigint").alias("text_columns"),
        miss.cast("bigint").alias("missing_cells"),
        F.avg(to_double(target)).alias("target_mean"),
        F.sum(to_double(target)).alias("target_sum"),
        F.min(date).alias("period_start"),
        F.max(date).alias("period_end"),
        F.datediff(F.max(date), F.min(date)).cast("bigint").alias("duration_days"),
    )


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Exact: one unpivot to (column, value) and two aggregations (the first
    combines map-side). Approximate: HyperLogLog sketches in one pass."""
    cols = list(cols) if cols else df.columns
    if not approx:
        long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).unpivot([], cols, "variable", "_v")
        vc = long.where(F.col("_v").isNotNull()).groupBy("variable", "_v").agg(F.count(F.lit(1)).alias("_c"))
        return vc.groupBy("variable").agg(F.count(F.lit(1)).cast("bigint").alias("distinct"))
    one = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d__{i}") for i, c in enumerate(cols)])
    parts = [F.struct(F.lit(c).alias("variable"), F.col(f"d__{i}").cast("bigint").alias("distinct")) for i, c in enumerate(cols)]
    return one.select(F.explode(F.array(*parts)).alias("_r")).select("_r.*")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def categorical_profile(df: DataFrame, target: str, max_cols: int = 10, max_levels: int = 50,
                        cols: Sequence[str] | None = None) -> DataFrame:
    """For the first ``max_cols`` text columns with fewer than ``max_levels``
    levels: count and mean target per level (one unpivot, one groupBy)."""
    txt = list(cols) if cols else text_columns(df)
    if not cols:
        txt = few_level_columns(df, txt, max_levels - 1, max_cols)
    long = df.select(to_double(target).alias("_t"), *[F.col(c).cast("string").alias(c) for c in txt]).unpivot(
        ["_t"], txt, "variable", "level")
    return long.groupBy("variable", "level").agg(
        F.count(F.lit(1)).cast("bigint").alias("count"), F.avg("_t").alias("target_mean"),
        F.count("_t").cast("bigint").alias("target_count"))


def few_level_columns(df: DataFrame, cols: Sequence[str], max_levels: int, max_cols: int | None = None) -> list[str]:
    """The first ``max_cols`` of ``cols`` with 1 to ``max_levels`` levels."""
    nd = {r["variable"]: r["distinct"] for r in distinct_counts(df, cols).collect()} if cols else {}
    return [c for c in cols if 0 < nd.get(c, 0) <= max_levels][:max_cols]


def category_means(df: DataFrame, target: str, max_levels: int = 10, max_cols: int = 4) -> DataFrame:
    """Mean and count of the target by level of the first ``max_cols`` text
    columns with at most ``max_levels`` levels: (variable, level, mean, count)."""
    txt = few_level_columns(df, text_columns(df), max_levels, max_cols)
    if not txt:
        return df.sparkSession.createDataFrame([], "variable string, level string, mean double, count bigint")
    long = df.select(to_double(target).alias("_t"), *[F.col(c) for c in txt]).unpivot(["_t"], txt, "variable", "level")
    return long.where(F.col("level").isNotNull()).groupBy("variable", "level").agg(F.avg("_t").alias("mean"), F.count("_t").cast("bigint").alias("count"))
