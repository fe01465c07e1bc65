"""All pairs of the levels of a column compared by ranks, from one table of
value x level counts with prefix sums.

A row of the table is a value with its count in each level (rows are combined
before the shuffle, so a frequent value costs one row a task). Values are cut
into ranges; the levels' totals of the ranges before (at most 4096 rows) and a
window inside the range give, at every value, how many rows of each level are
smaller. One aggregate then sums, for each level, its ranks and its wins over
every other level. No row is copied for a pair."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casting import to_double
from ..functions.special import norm_sf2
from . import ranks

#: levels compared with each other; their number of pairs bounds the result
MAX_LEVELS = 256


@dataclass
class LevelRanks:
    """``size`` and ``rank_sum`` (average ranks over all levels together) by
    level, ``wins[a, b]``: pairs of rows of a and b where a's is larger, ties
    counting a half, and the tie term sum(t^3 - t)."""

    size: dict[str, int]
    rank_sum: dict[str, float]
    wins: dict[tuple[str, str], float]
    ties: float

    def delta(self, a: str, b: str) -> float:
        """Cliff's delta, (#{a > b} - #{a < b}) / (n_a n_b)."""
        return 2 * self.wins[a, b] / (self.size[a] * self.size[b]) - 1


def level_ranks(df: DataFrame, group: str, value: str, min_n: int = 1, levels: Sequence[str] | None = None) -> LevelRanks:
    """Counts and ranks of every level (as text) with at least ``min_n`` values;
    of those in ``levels`` if given. More than MAX_LEVELS raise ValueError."""
    d = df.select(F.col(group).cast("string").alias("_g"), to_double(value).alias("_x")).where(F.col("_g").isNotNull() & F.col("_x").isNotNull())
    if levels is not None:
        d = d.where(F.col("_g").isin([str(v) for v in levels]))
    sizes = d.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n).limit(MAX_LEVELS + 1).collect()
    if len(sizes) > MAX_LEVELS:
        raise ValueError(f"{group} has more than {MAX_LEVELS} levels to compare in pairs")
    size = {r["_g"]: r["n"] for r in sorted(sizes)}
    names = list(size)
    if not names:
        return LevelRanks({}, {}, {}, 0.0)
    d = d.where(F.col("_g").isin(names))
    k = range(len(names))
    counts = d.groupBy("_x").agg(*[F.count(F.when(F.col("_g") == n, 1)).alias(f"c{i}") for i, n in enumerate(names)])
    placed = ranks.with_value_range(counts, d, "_x")
    totals = placed.groupBy("_b").agg(*[F.sum(f"c{i}").alias(f"t{i}") for i in k])
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = totals.select("_b", *[F.coalesce(F.sum(f"t{i}").over(earlier), F.lit(0)).alias(f"o{i}") for i in k])
    smaller = Window.partitionBy("_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    j = placed.join(F.broadcast(offsets), "_b").select(
        F.array(*[F.col(f"c{i}").cast("double") for i in k]).alias("c"),
        F.array(*[(F.col(f"o{i}") + F.coalesce(F.sum(f"c{i}").over(smaller), F.lit(0))).cast("double") for i in k]).alias("b"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    j = j.withColumn("t", add("c")).withColumn("before", add("b"))
    long = j.select("c", "b", "t", "before", F.posexplode("c").alias("level", "own")).where(F.col("own") > 0)
    t = F.col("t")
    one = long.groupBy("level").agg(
        F.sum(F.col("own") * (F.col("before") + (t + 1) / 2)).alias("rank_sum"),
        F.sum(F.col("own") / t * (t * t * t - t)).alias("ties"),
        *[F.sum(F.col("own") * (F.col("b")[i] + F.col("c")[i] / 2)).alias(f"w{i}") for i in k]).collect()
    return LevelRanks(
        size, {names[r["level"]]: r["rank_sum"] for r in one},
        {(names[r["level"]], names[i]): r[f"w{i}"] for r in one for i in k}, math.fsum(r["ties"] for r in one))


def cliffs_delta_pairs(df: DataFrame, group: str, value: str, pairs: Sequence[tuple[str, str]], min_n: int = 3) -> DataFrame:
    """Cliff's delta of level a against level b for each listed pair that has
    rows; null where a side has fewer than ``min_n``."""
    pairs = [(str(a), str(b)) for a, b in pairs]
    r = level_ranks(df, group, value, 1, sorted({v for p in pairs for v in p}))
    rows = []
    for i, (a, b) in enumerate(pairs):
        na, nb = r.size.get(a), r.size.get(b)
        if na or nb:
            ok = min(na or 0, nb or 0) >= min_n
            rows.append((i, a, b, na, nb, r.delta(a, b) if ok else None))
    return df.sparkSession.createDataFrame(rows, "pair int, level_a string, level_b string, n_a bigint, n_b bigint, delta double")


def holm(p: Sequence[float]) -> list[float]:
    """Step-down adjusted p of sorted p-values."""
    out, worst = [], 0.0
    for i, v in enumerate(p):
        worst = max(worst, min(1.0, (len(p) - i) * v))
        out.append(worst)
    return out


def dunn_posthoc(df: DataFrame, group: str, value: str, min_n: int = 3) -> DataFrame:
    """Pairwise z of the mean ranks over all levels with at least ``min_n``
    rows (tie corrected), two-sided normal p and Holm adjusted p. All values
    equal: nulls."""
    r = level_ranks(df, group, value, min_n)
    names, n = list(r.size), sum(r.size.values())
    var = n * (n + 1) / 12 - r.ties / (12 * (n - 1)) if n > 1 else 0.0
    rows = []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            sd = math.sqrt(var * (1 / r.size[a] + 1 / r.size[b])) if var > 1e-9 * n * n else 0.0
            z = (r.rank_sum[a] / r.size[a] - r.rank_sum[b] / r.size[b]) / sd if sd else None
            rows.append((a, b, z, None if z is None else norm_sf2(z)))
    known = sorted((x for x in rows if x[3] is not None), key=lambda x: (x[3], x[0], x[1]))
    out = [(*x, h) for x, h in zip(known, holm([x[3] for x in known]))] + [(*x, None) for x in rows if x[3] is None]
    return df.sparkSession.createDataFrame(out, "level_a string, level_b string, z double, p_value double, p_holm double")
