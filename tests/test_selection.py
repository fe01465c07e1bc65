"""Bracket selection against sorted lists: hot values, nulls, NaN, groups with
a null key, empty columns; with the production settings and with sketches so
coarse and brackets so small that several narrowing scans are needed."""

import math
import random

import numpy as np
import pytest
from sinistra.operators import ranks, selection

MARKS = [selection.Quantile(f"q{p}", p) for p in (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)]
START, END = ranks.trim_counts(0.05, 0.95, 20)
SUMS = [selection.SumOfSmallest("head", 0.05, START), selection.SumOfSmallest("upto", 0.95, END)]


def _rows():
    rnd = random.Random(7)
    rows = []
    for i in range(30_000):
        g = rnd.choice(["hot", "hot", "hot", "hot", "b", None])
        x = 5.0 if rnd.random() < 0.35 else rnd.gauss(0, 100) ** 3
        y = None if rnd.random() < 0.2 else float("nan") if rnd.random() < 0.1 else float(rnd.randint(0, 9))
        rows.append((g, x, y, None))
    return rows + [("tiny", 1.0, None, None), ("pair", 2.0, 3.0, None), ("pair", 4.0, None, None)]


ROWS = _rows()


def _expected(rows, i):
    return sorted(r[i] for r in rows if r[i] is not None and not math.isnan(r[i]))


def _check(found, values):
    n = len(values)
    assert found.n == n
    if not n:
        assert found.mean is None and all(found.quantile(m.name) is None for m in MARKS)
        return
    for m in MARKS:
        assert found.quantile(m.name) == pytest.approx(float(np.quantile(values, m.p)), rel=1e-12, abs=1e-9), m
    for m in SUMS:
        assert found.marks[m.name] == pytest.approx(math.fsum(values[:m.count(n)]), rel=1e-9, abs=1e-6 * max(map(abs, values)))
    v = np.array(values)
    assert found.mean == pytest.approx(v.mean(), rel=1e-9, abs=1e-9)
    for name, k in (("m2", 2), ("m3", 3), ("m4", 4)):
        assert getattr(found, name) == pytest.approx(((v - v.mean()) ** k).sum(), rel=1e-7, abs=1e-7 * (np.abs(v - v.mean()) ** k).sum() + 1e-9)


@pytest.mark.parametrize("accuracy,inside,grid", [(2000, 50_000, 256), (60, 1, 16), (400, 20, 8)])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_select(spark, monkeypatch, accuracy, inside, grid, keys):
    for name, v in (("ACCURACY", accuracy), ("INSIDE", inside), ("GRID", grid)):
        monkeypatch.setattr(selection, name, v)
    df = spark.createDataFrame(ROWS, "g string, x double, y double, z double").repartition(7)
    got = selection.select(df, ["x", "y", "z"], keys, MARKS + SUMS)
    groups = {r[0] for r in ROWS} if keys else {()}
    assert len(got) == 3 * len(groups)
    for s in got:
        rows = [r for r in ROWS if not keys or r[0] == s.keys[0]]
        _check(s, _expected(rows, "gxyz".index(s.value)))


def test_a_wrong_bracket_starts_again(spark, monkeypatch):
    """A sketch outside its error bound costs scans, not the result."""
    real = selection._sketch
    monkeypatch.setattr(selection, "_sketch", lambda c, probs: real(f"({c} * 0 + 1e9D)", probs))
    df = spark.createDataFrame(ROWS, "g string, x double, y double, z double")
    got = selection.select(df, ["x"], (), MARKS[2:5], moments=False)
    monkeypatch.undo()
    values = _expected(ROWS, 1)
    assert [got[0].quantile(m.name) for m in MARKS[2:5]] == pytest.approx([float(np.quantile(values, m.p)) for m in MARKS[2:5]])


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert selection.select(df, ["x"], ["g"], MARKS) == []
    (one,) = selection.select(df, ["x"], (), MARKS)
    assert one.n == 0 and one.quantile("q0.5") is None
    assert ranks.exact_quantiles(df, "x", [0.5], ["g"]).count() == 0


def test_many_groups_take_the_rank_table(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "g string, x double, y double, z double")
    want = {r.g: r for r in ranks.group_summary(df, "x", ["g"], ("count", "mean", "std", "skew"), {"m": 0.5, "p9": 0.9}, "tm").collect()}
    monkeypatch.setattr(selection, "MAX_GROUPS", 2)
    got = {r.g: r for r in ranks.group_summary(df, "x", ["g"], ("count", "mean", "std", "skew"), {"m": 0.5, "p9": 0.9}, "tm").collect()}
    assert got.keys() == want.keys()
    for g, r in want.items():
        for c in r.__fields__:
            assert r[c] == got[g][c] or r[c] == pytest.approx(got[g][c], rel=1e-9)
    q = {r.g: r.m for r in ranks.exact_quantiles(df, "x", [0.5], ["g"], names=["m"]).collect()}
    assert q == pytest.approx({g: r.m for g, r in want.items()})


def test_nothing_is_exchanged_by_value(spark, sf_dir, monkeypatch):
    """The plans of a description: partial aggregates alone."""
    from sinistra.operators import profile

    plans = []
    real = type(spark.range(1)).collect

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(type(spark.range(1)), "collect", seen)
    df = spark.createDataFrame(ROWS, "g string, x double, y double, z double")
    profile.describe_numeric(df, ["x", "y", "z"])
    assert len(plans) == 2  # two scans
    assert all("hashpartitioning" not in p for p in plans)
