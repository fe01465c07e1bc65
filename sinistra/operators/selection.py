"""Exact order statistics, sums of the smallest values and moments of many
columns by bracket selection.

One scan sketches every column (``percentile_approx``): its values a little
below and above a wanted rank bracket the exact order statistic. A second scan
counts what lies below each bracket, keeps only the values strictly inside it
(at most ``6 / ACCURACY`` of the rows, equal values at the ends are counted, not
kept), sorts those and picks the wanted ones. Where that many would still be
more than ``INSIDE``, scans between the two narrow the brackets further, each
by more than a hundredfold, so the number of scans grows with the logarithm of
the rows. Nothing is exchanged by value: rows meet only in partial aggregates
of their group. A bracket that misses its rank (a sketch outside its error
bound) starts again from the column's minimum and maximum.

The second scan also sums powers of the differences from the first scan's
means, so moments are two-pass.

Groups: at most ``MAX_GROUPS`` (checked), since their brackets travel to every
task. Above that ``select`` returns None and the caller takes the rank table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: relative accuracy of a sketch is 1 / ACCURACY
ACCURACY = 2000
#: values kept inside one bracket by the last scan
INSIDE = 50_000
#: probabilities of a narrowing sketch
GRID = 256
MAX_GROUPS = 10_000


@dataclass(frozen=True)
class Quantile:
    """Linear-interpolated quantile (0-based position ``(n - 1) * p``)."""

    name: str
    p: float

    def ranks(self, n: int) -> tuple[int, int]:
        lo = math.floor((n - 1) * self.p)
        return lo, min(lo + 1, n - 1)


@dataclass(frozen=True)
class SumOfSmallest:
    """Sum of the ``count(n)`` smallest values, near share ``p`` of them."""

    name: str
    p: float
    count: Callable[[int], int]

    def ranks(self, n: int) -> tuple[int, int]:
        k = self.count(n)
        return k - 1, k - 1


@dataclass
class Selected:
    """What is known of one column of one group. ``marks``: per quantile name
    (lower, upper order statistic, fraction), per sum name the sum."""

    keys: tuple
    value: str
    n: int
    total: float | None
    low: float | None
    high: float | None
    mean: float | None = None
    m2: float | None = None
    m3: float | None = None
    m4: float | None = None
    marks: dict = field(default_factory=dict)

    def quantile(self, name: str) -> float | None:
        a, b, f = self.marks.get(name) or (None, None, None)
        return None if a is None else a + f * (b - a)

    def measure(self, name: str) -> float | None:
        """A moment measure by its name; pandas' corrections for bias."""
        n, m2 = self.n, self.m2
        if name == "count":
            return n
        if not n:
            return None
        if name in ("sum", "mean", "min", "max"):
            return {"sum": self.total, "mean": self.mean, "min": self.low, "max": self.high}[name]
        if name == "std_pop":
            return math.sqrt(m2 / n)
        var = m2 / (n - 1) if n > 1 else None
        if name in ("var", "std", "cv") and (name == "var" or var is None):
            return var
        if name == "std":
            return math.sqrt(var)
        if name == "cv":
            return math.sqrt(var) / self.mean if self.mean else None
        # a constant column has skewness and excess kurtosis 0 (pandas)
        g1 = math.sqrt(n) * self.m3 / m2**1.5 if m2 > 0 else 0.0
        g2 = n * self.m4 / (m2 * m2) - 3 if m2 > 0 else None
        if name == "skew":
            return g1 * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 else None
        if name == "kurt":
            return ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if g2 is not None else 0.0) if n > 3 else None
        if name == "jarque_bera":
            return None if g2 is None else n / 6 * (g1 * g1 + g2 * g2 / 4)
        raise ValueError(f"unknown measure {name}")


@dataclass
class _Bracket:
    """Order statistics ``first`` and ``last`` lie between ``low`` and ``high``
    (both included); ``inside`` bounds the rows strictly between them."""

    low: float
    high: float
    first: int
    last: int
    inside: float


_BRACKET = "struct<low:double,high:double,first:bigint,last:bigint>"


def _merge(df: DataFrame, keys: list[str], rows: list[tuple], schema) -> DataFrame:
    """``df`` with its group's row of a small table (null keys are equal)."""
    small = df.sparkSession.createDataFrame(rows, schema)
    small = small.toDF(*[f"_k{i}" for i in range(len(keys))], *small.columns[len(keys):])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(F.broadcast(small), cond).drop(*[f"_k{i}" for i in range(len(keys))])


def _number(v: float | int | None, kind: str) -> str:
    return f"cast(null as {kind})" if v is None else f"double('{v!r}')" if kind == "double" else f"{v}L"


class _Scan:
    """The brackets and centres of every group, as SQL over the input. SQL
    strings, since hundreds of Column calls would take longer than the scan."""

    def __init__(self, df: DataFrame, keys: list[str], table: dict[tuple, list[_Bracket | None]], centres: dict[tuple, list[float | None]]):
        from pyspark.sql.types import StructType

        self.keys = keys
        if keys:
            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
            schema = StructType.fromDDL(f"{kinds}, _brackets array<{_BRACKET}>, _centres array<double>")
            rows = [(*k, [None if b is None else (b.low, b.high, b.first, b.last) for b in bs], centres[k]) for k, bs in table.items()]
            self.df = _merge(df, keys, rows, schema)
        else:
            self.df = df
            (self.brackets,), (self.centres,) = table.values(), centres.values()

    def bracket(self, s: int, name: str) -> str:
        if self.keys:
            return f"_brackets[{s}].{name}"
        b = self.brackets[s]
        return _number(None if b is None else getattr(b, name), "double" if name in ("low", "high") else "bigint")

    def centre(self, i: int) -> str:
        return f"_centres[{i}]" if self.keys else _number(self.centres[i], "double")

    def grouped(self, aggs: list[str]) -> DataFrame:
        if self.keys:
            return self.df.groupBy(*self.keys).agg(*map(F.expr, aggs))
        return self.df.selectExpr(*aggs)


def select(df: DataFrame, values: Sequence[str], keys: Sequence[str] = (), marks: Sequence = (), moments: bool = True) -> list[Selected] | None:
    """One ``Selected`` for each group and column of ``values`` (doubles; null
    and NaN are left out), or None above MAX_GROUPS groups. A column without
    values in its group has n = 0."""
    keys, values, marks = list(keys), list(values), list(marks)
    x = [f"_v{i}" for i in range(len(values))]
    number = lambda v: f"if(isnan(cast(`{v}` as double)), null, cast(`{v}` as double))"
    df = df.selectExpr(*[f"`{k}`" for k in keys], *[f"{number(v)} as {c}" for v, c in zip(values, x)])
    near = 2.0 / ACCURACY
    probs = sorted({min(max(m.p + s, 0.0), 1.0) for m in marks for s in (-near, near)})
    aggs = []
    for i, c in enumerate(x):
        aggs += [f"count({c}) as n{i}", f"sum({c}) as s{i}", f"min({c}) as lo{i}", f"max({c}) as hi{i}"]
        if probs:
            aggs.append(f"{_sketch(c, probs)} as p{i}")
    first = (df.groupBy(*keys).agg(*map(F.expr, aggs)) if keys else df.selectExpr(*aggs)).limit(MAX_GROUPS + 1).collect()
    if len(first) > MAX_GROUPS:
        return None
    out: dict[tuple, list[Selected]] = {}
    table: dict[tuple, list[_Bracket | None]] = {}
    slots = [(i, m) for i in range(len(values)) for m in marks]
    for row in first:
        k = tuple(row[:len(keys)])
        out[k] = [Selected(k, v, row[f"n{i}"], row[f"s{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, v in enumerate(values)]
        table[k] = []
        for i, m in slots:
            n, at = row[f"n{i}"], m.ranks(row[f"n{i}"]) if row[f"n{i}"] else (-1, -1)
            if at[0] < 0 or isinstance(m, SumOfSmallest) and at[0] == n - 1:
                table[k].append(None)  # nothing to find: no values, none wanted or all
            elif n <= 3 * ACCURACY:
                table[k].append(_Bracket(row[f"lo{i}"], row[f"hi{i}"], *at, n))
            else:
                edge = dict(zip(probs, row[f"p{i}"]))
                a, b = (edge[min(max(m.p + s, 0.0), 1.0)] for s in (-near, near))
                low, high = (row[f"lo{i}"] if m.p <= near else a), (row[f"hi{i}"] if m.p >= 1 - near else b)
                table[k].append(_Bracket(low, high, *at, 6 * n / ACCURACY))
    centres = {k: [s.total / s.n if s.n else None for s in found] for k, found in out.items()}
    if not out:
        return []
    _pick(df, x, keys, slots, table, centres, out, moments)
    return [s for found in out.values() for s in found]


def _sketch(c: str, probs: Sequence[float]) -> str:
    return f"percentile_approx({c}, array({', '.join(f'{p!r}D' for p in probs)}), {ACCURACY})"


def _pick(df, x, keys, slots, table, centres, out, moments) -> None:
    """The scans after the first: narrow where needed, then pick."""
    todo = {k: list(bs) for k, bs in table.items()}
    while moments or any(b for bs in todo.values() for b in bs):
        while any(b and b.inside > max(INSIDE, 3 * ACCURACY) for bs in todo.values() for b in bs):
            _narrow(df, x, keys, slots, todo, centres)
        scan = _Scan(df, keys, todo, centres)
        wanted = [s for s in range(len(slots)) if any(bs[s] for bs in todo.values())]
        aggs, cols = [], [f"`{k}`" for k in keys]
        for s in wanted:
            c, low, high = x[slots[s][0]], scan.bracket(s, "low"), scan.bracket(s, "high")
            aggs += [f"count(if({c} < {low}, 1, null)) as lt_{s}", f"count(if({c} = {low}, 1, null)) as eq_{s}", f"count(if({c} <= {high}, 1, null)) as le_{s}",
                     f"sort_array(collect_list(if({c} > {low} and {c} < {high}, {c}, null))) as kept_{s}", f"max({low}) as low_{s}", f"max({high}) as high_{s}",
                     f"max({scan.bracket(s, 'first')}) as first_{s}", f"max({scan.bracket(s, 'last')}) as last_{s}"]
            with_sum = isinstance(slots[s][1], SumOfSmallest)
            if with_sum:
                aggs.append(f"sum(if({c} < {low}, {c}, null)) as below_{s}")
            cols += _picks(s, with_sum)
        if moments:
            for i, c in enumerate(x):
                d = f"({c} - {scan.centre(i)})"
                aggs += [f"sum({' * '.join([d] * j)}) as d{j}_{i}" for j in (1, 2, 3, 4)]
            cols += [f"d{j}_{i}" for i in range(len(x)) for j in (1, 2, 3, 4)]
        for row in scan.grouped(aggs).selectExpr(*cols).collect():
            k = tuple(row[:len(keys)])
            for s in wanted:
                b, (i, m) = todo[k][s], slots[s]
                if b is None:
                    continue
                a, z = row[f"a_{s}"], row[f"b_{s}"]
                if a is None or z is None:  # outside its bracket: once more, from the ends
                    todo[k][s] = _Bracket(out[k][i].low, out[k][i].high, b.first, b.last, out[k][i].n)
                    continue
                todo[k][s] = None
                h = (out[k][i].n - 1) * m.p
                out[k][i].marks[m.name] = row[f"sum_{s}"] if isinstance(m, SumOfSmallest) else (a, z, h - math.floor(h))
            if moments:
                for i, found in enumerate(out[k]):
                    _moments(found, centres[k][i], *(row[f"d{j}_{i}"] for j in (1, 2, 3, 4)))
        moments = False
    for k, found in out.items():
        for s, (i, m) in enumerate(slots):
            if isinstance(m, SumOfSmallest) and found[i].n and table[k][s] is None:
                found[i].marks[m.name] = found[i].total if m.count(found[i].n) >= found[i].n else 0.0


def _picks(s: int, with_sum: bool) -> list[str]:
    """The wanted order statistics of slot ``s``; null outside the bracket."""
    skip, kept = f"lt_{s} - eq_{s}", f"kept_{s}"

    def pick(r: str) -> str:
        at = f"({r} - {skip})"
        return (f"case when {r} < lt_{s} then null when {at} < 0 then low_{s} when {at} < size({kept}) then get({kept}, cast({at} as int)) "
                f"when {r} < le_{s} then high_{s} end")

    out = [f"{pick(f'first_{s}')} as a_{s}", f"{pick(f'last_{s}')} as b_{s}"]
    if with_sum:
        after = f"(first_{s} + 1 - {skip})"  # of the wanted values, those above low
        inside = f"cast(least(greatest({after}, 0L), size({kept})) as int)"
        rest = f"aggregate(slice({kept}, 1, {inside}), 0D, (acc, v) -> acc + v)"
        out.append(f"coalesce(below_{s}, 0D) + least(eq_{s}, first_{s} + 1 - lt_{s}) * low_{s} + {rest} + greatest({after} - size({kept}), 0L) * high_{s} as sum_{s}")
    return out


def _moments(found: Selected, centre: float | None, d1, d2, d3, d4) -> None:
    if not found.n:
        return
    n, e = found.n, d1 / found.n
    found.mean = centre + e
    found.m2 = max(d2 - n * e * e, 0.0)
    found.m3 = d3 - 3 * e * d2 + 2 * n * e**3
    found.m4 = d4 - 4 * e * d3 + 6 * e * e * d2 - 3 * n * e**4


def _narrow(df, x, keys, slots, todo, centres) -> None:
    """One scan that puts wide brackets between two points of a sketch of the
    values inside them."""
    scan = _Scan(df, keys, todo, centres)
    wide = [s for s in range(len(slots)) if any(bs[s] and bs[s].inside > max(INSIDE, 3 * ACCURACY) for bs in todo.values())]
    points = [j / GRID for j in range(GRID + 1)]
    aggs = []
    for s in wide:
        c, low, high = x[slots[s][0]], scan.bracket(s, "low"), scan.bracket(s, "high")
        kept = f"if({c} > {low} and {c} < {high}, {c}, null)"
        aggs += [f"count(if({c} < {low}, 1, null)) as lt_{s}", f"count(if({c} = {low}, 1, null)) as eq_{s}", f"count({kept}) as in_{s}",
                 f"{_sketch(kept, points)} as grid_{s}"]
    for row in scan.grouped(aggs).collect():
        k = tuple(row[:len(keys)])
        for s in wide:
            b = todo[k][s]
            if b is None:
                continue
            many, grid = row[f"in_{s}"], row[f"grid_{s}"]
            at, end = (r - row[f"lt_{s}"] - row[f"eq_{s}"] for r in (b.first, b.last))
            if many <= max(INSIDE, 3 * ACCURACY):
                b.inside = many
                continue
            slack = 2 * GRID / ACCURACY + 1
            j = math.floor(at / many * GRID - slack) if at >= 0 else -1
            z = math.ceil(end / many * GRID + slack)
            low = grid[j] if j > 0 else b.low
            high = grid[z] if z < GRID else b.high
            inside = many * ((min(z, GRID) - max(j, 0)) / GRID + 2 / ACCURACY)
            # a bracket that cannot shrink any more holds few distinct values at its ends
            todo[k][s] = _Bracket(low, high, b.first, b.last, inside if inside < 0.9 * b.inside else 0)
