"""Encoders, scalers and target transforms as fit (small state table) +
transform (broadcast join or expressions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casting import to_double
from .levels import split_join


def fit_label_encoder(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """State: (variable, level, code) with codes 0..k-1 in sorted level order.

    The distinct levels are range-partitioned and sorted (a distributed
    sort), cut from their lineage by ``checkpoint()`` into the shared
    checkpoint folder so the partition ids are stable, then numbered by a
    per-partition row number plus the level count of all earlier partitions
    (a table of one row per partition and variable). No partition holds more
    than its range, however many levels a column has."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "variable", "level")
    lv = long.where(F.col("level").isNotNull()).distinct()
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    srt = lv.repartitionByRange(parts, "variable", "level").sortWithinPartitions("variable", "level").checkpoint()
    srt = srt.withColumn("_p", F.spark_partition_id())
    sizes = srt.groupBy("_p", "variable").agg(F.count(F.lit(1)).alias("_k"))
    # one row per (partition, variable): running offset in partition order
    w = Window.partitionBy("variable").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("_p", "variable", F.coalesce(F.sum("_k").over(w), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_p", "variable").orderBy("level"))
    return srt.join(F.broadcast(offs), ["_p", "variable"]).select(
        "variable", "level", (F.col("_off") + local - 1).cast("int").alias("code"))


def apply_label_encoder(df: DataFrame, state: DataFrame, cols: Sequence[str], suffix: str = "_encoded") -> DataFrame:
    """``<c>_encoded`` per column; unseen levels -> -1, null -> null. The rows
    are not exchanged on a frequent level (see :func:`levels.split_join`)."""
    out = df
    for c in cols:
        m = state.where(F.col("variable") == c).select(F.col("level").alias("_level"), F.col("code").alias(f"{c}{suffix}"))
        out = split_join(out.withColumn("_level", F.col(c).cast("string")), m, "_level").drop("_level")
        out = out.withColumn(f"{c}{suffix}", F.when(F.col(c).isNotNull(), F.coalesce(F.col(f"{c}{suffix}"), F.lit(-1))))
    return out


def encode_label(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return apply_label_encoder(df, fit_label_encoder(df, cols), cols)


def encode_onehot(df: DataFrame, col: str, levels: Sequence[str] | None = None, min_freq: int | None = None,
                  drop_original: bool = False, max_levels: int = 1000) -> DataFrame:
    """One 0/1 column ``<col>_<level>`` per level; unknown levels get all zeros.
    Levels that are not given are fitted: those with at least ``min_freq``
    rows. They become the schema, so more than ``max_levels`` raise ValueError."""
    if levels is None:
        vc = df.groupBy(col).count().where(F.col(col).isNotNull())
        if min_freq:
            vc = vc.where(F.col("count") >= min_freq)
        found = vc.select(F.col(col).cast("string").alias("level")).limit(max_levels + 1).collect()
        if len(found) > max_levels:
            raise ValueError(f"{col} has more than {max_levels} levels: give levels or min_freq")
        levels = sorted(r.level for r in found)
    x = F.col(col).cast("string")
    out = df.select("*", *[F.when(x == lv, 1).otherwise(0).cast("int").alias(f"{col}_{lv}") for lv in levels])
    return out.drop(col) if drop_original else out


def scale_standard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population std; constant column -> 0."""
    f = df.agg(*[F.avg(to_double(c)).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(to_double(c)).alias(f"_s_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(f))
    sel = []
    for c in df.columns:
        if c in cols:
            s = F.col(f"_s_{c}")
            sel.append(F.when(s == 0, F.when(to_double(c).isNotNull(), F.lit(0.0)))
                       .otherwise((to_double(c) - F.col(f"_m_{c}")) / s).alias(c))
        else:
            sel.append(F.col(c))
    return j.select(*sel)


def scale_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min); constant column -> 0."""
    f = df.agg(*[F.min(to_double(c)).alias(f"_a_{c}") for c in cols], *[F.max(to_double(c)).alias(f"_b_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(f))
    sel = []
    for c in df.columns:
        if c in cols:
            rng = F.col(f"_b_{c}") - F.col(f"_a_{c}")
            sel.append(F.when(rng == 0, F.when(to_double(c).isNotNull(), F.lit(0.0)))
                       .otherwise((to_double(c) - F.col(f"_a_{c}")) / rng).alias(c))
        else:
            sel.append(F.col(c))
    return j.select(*sel)


def target_transform(df: DataFrame, target: str, kind: str = "log", out: str = "y_t") -> DataFrame:
    """log with shift |min|+1 when min <= 0; sqrt with shift |min| when min < 0;
    adds ``out`` and the ``shift`` used (for the inverse)."""
    y = to_double(target)
    mn = df.agg(F.min(y).alias("_mn"))
    if kind == "log":
        shift = F.when(F.col("_mn") <= 0, F.abs(F.col("_mn")) + 1).otherwise(F.lit(0.0))
        fn = F.ln
    elif kind == "sqrt":
        shift = F.when(F.col("_mn") < 0, F.abs(F.col("_mn"))).otherwise(F.lit(0.0))
        fn = F.sqrt
    else:
        return df.withColumn(out, y).withColumn("shift", F.lit(0.0))
    j = df.crossJoin(F.broadcast(mn.select(shift.alias("shift"))))
    return j.withColumn(out, fn(y + F.col("shift")))


def inverse_target(col: str, kind: str = "log", shift: str = "shift"):
    if kind == "log":
        return F.exp(F.col(col)) - F.col(shift)
    if kind == "sqrt":
        return F.col(col) * F.col(col) - F.col(shift)
    return F.col(col)
