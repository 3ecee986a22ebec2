"""Operators that cut a series among tasks: running aggregates, as-of joins, overlap, rolling functions, and the bootstrap's tree."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import econometrics as ec
from tidemark.operators import folds, intervals, rolling, running

DAY = dt.datetime(2024, 1, 1)


def at(k):
    return DAY + dt.timedelta(minutes=int(k))


@pytest.fixture(scope="module")
def table():
    """A symbol with nearly all rows, one with few, ties in time, nulls."""
    rng = np.random.default_rng(5)
    return [("HOT", at(k // 2), float(rng.integers(0, 50)) if rng.random() > 0.1 else None) for k in range(500)] + [("B", at(k), float(k)) for k in range(3)]


def test_running_kinds(spark, table):
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(table)], "symbol string, ts timestamp_ntz, x double, k int").repartition(5)
    got = running.running(df, {"s": ("sum", "x"), "n": ("count", "x"), "hi": ("max", "x"), "lo": ("min", "x"), "z": ("last", "x")}, ["ts", "k"]).toPandas().sort_values(["symbol", "k"], ignore_index=True)
    assert len(got) == len(table)
    for _, g in got.groupby("symbol"):
        x = g["x"]
        assert np.allclose(g["s"], x.fillna(0).cumsum()) and (g["n"] == x.notna().cumsum()).all()
        assert np.allclose(g["hi"], x.cummax().ffill(), equal_nan=True) and np.allclose(g["lo"], x.cummin().ffill(), equal_nan=True) and np.allclose(g["z"], x.ffill(), equal_nan=True)
    for whole in (0, 50_000):
        placed = running.places(df, order=["ts", "k"], whole=whole).where("symbol = 'HOT'").toPandas().sort_values("k")
        assert placed["pos"].tolist() == list(range(500))


@pytest.mark.parametrize(("strict", "within"), [(False, None), (True, None), (False, "3 MINUTES")])
def test_asof_join(spark, table, strict, within):
    rng = np.random.default_rng(1)
    right = [("HOT", at(k), int(k) * 10) for k in sorted(rng.choice(240, 40, replace=False))] + [("B", at(1), 7), ("C", at(0), 1)]
    a = spark.createDataFrame([*table, (None, at(1), 1.0), ("HOT", None, 2.0)], "symbol string, ts timestamp_ntz, x double")
    b = spark.createDataFrame([*right, (None, at(0), 5), ("HOT", None, 5)], "symbol string, ts timestamp_ntz, x long").withColumn("since", F.col("ts"))
    got = running.asof_join(a, b, strict=strict, within=within)
    assert got.columns == ["symbol", "ts", "x", "x_asof", "since"]
    want = []
    for s, t, x in [*table, (None, at(1), 1.0), ("HOT", None, 2.0)]:
        best = max(((u, v) for r, u, v in right if s == r and t is not None and (u < t if strict else u <= t)), default=None)
        if best and within and t - best[0] > dt.timedelta(minutes=3):
            best = None
        want.append((s, t, x, best and best[1], best and best[0]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_overlap_without_pairs(spark):
    rng = np.random.default_rng(2)
    make = lambda n: [(str(s), at(a), at(a + w)) for s, a, w in zip(rng.choice(["X", "Y"], n), rng.integers(0, 900, n), rng.integers(0, 9, n), strict=True)]
    spans, others = [*make(300), ("X", at(1), None), (None, at(1), at(2))], [*make(40), ("Z", at(0), at(9))]
    a, b = spark.createDataFrame(spans, "symbol string, t0 timestamp_ntz, t1 timestamp_ntz"), spark.createDataFrame(others, "symbol string, s timestamp_ntz, e timestamp_ntz")
    left = intervals.without_overlap(a, b)
    want = [x for x in spans if x[2] is None or not any(x[0] == o[0] and not (x[2] < o[1] or x[1] > o[2]) for o in others)]
    assert sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)
    plan = left._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("before", [False, True])
def test_rolling_chunks(spark, table, before):
    df = spark.createDataFrame([(s, DAY + dt.timedelta(seconds=k), x) for k, (s, _, x) in enumerate(table)], "symbol string, ts timestamp_ntz, x double")
    got = rolling.rolling_apply(df, "x", 7, lambda w: np.nanmax(w, 1) - np.nanmin(w, 1), "span", least=4, before=before, chunk=10, block=4).toPandas()
    want = []
    for _, g in pd.DataFrame(df.toPandas()).sort_values("ts").groupby("symbol"):
        w = g["x"].rolling(7, min_periods=4).agg(lambda x: x.max() - x.min())
        w[:6] = np.nan  # windows that reach beyond the start
        want.append(g.assign(span=w.shift(1) if before else w))
    both = got.merge(pd.concat(want), on=["symbol", "ts"], suffixes=("", "_want"))
    assert len(got) == len(both) == len(table) and both["span"].notna().sum() > 400 and np.allclose(both["span"], both["span_want"], equal_nan=True)


def test_rows_of_entropy_and_phrases():
    rng = np.random.default_rng(3)
    w = rng.normal(size=(60, 50)).round(1)
    w[0] = 1.0
    assert np.allclose(rolling.shannon_rows(w + 0.037), [ec.shannon(x + 0.037) for x in w], atol=1e-9)
    with_gaps = np.where(rng.random(w.shape) < 0.2, np.nan, w)
    assert np.allclose(rolling.shannon_rows(with_gaps), [ec.shannon(x[np.isfinite(x)]) for x in with_gaps], atol=1e-9)
    bits = rng.random((80, 50)) < 0.3
    bits[0], bits[1] = False, np.arange(50) % 2 == 0
    assert np.allclose(rolling.lempel_ziv_rows(bits), [ec.lempel_ziv(b) for b in bits])
    for x, got in zip(w, rolling.median_bits(w), strict=True):
        edges = np.unique(np.quantile(x, np.linspace(0, 1, 11)))
        code = np.clip(np.searchsorted(edges, x, "left") - 1, 0, None)
        assert (got == (code > np.median(code))).all()


def plain_draws(i0, i1, draws, seed):
    """The definition: average uniqueness of every span anew before each draw."""
    taken, rng, picked = np.zeros(i1.max() + 1), np.random.default_rng(seed), []
    for _ in range(draws):
        u = np.array([np.mean(1 / (1 + taken[a : b + 1])) for a, b in zip(i0, i1, strict=True)])
        picked.append(int(rng.choice(len(u), p=u / u.sum())))
        taken[i0[picked[-1]] : i1[picked[-1]] + 1] += 1
    return picked


def test_bootstrap_draws_as_the_plain_loop(spark):
    rng = np.random.default_rng(0)
    i0 = np.sort(rng.integers(0, 120, 90))
    i1 = i0 + rng.integers(0, 25, 90)
    spans = spark.createDataFrame([("S", int(k), int(a), int(b)) for k, (a, b) in enumerate(zip(i0, i1, strict=True))] + [("S", 999, 3, None)], "symbol string, label_id long, i0 long, i1 long")
    got = folds.sequential_bootstrap(spans, draws=200, replicates=2, seed=4).orderBy("replicate", "draw").toPandas()
    for r in (0, 1):
        assert got[got["replicate"] == r]["label_id"].tolist() == plain_draws(i0, i1, 200, [4, r])


def test_bootstrap_of_many_spans():
    i0 = np.arange(100_000)
    tree = folds.UniquenessTree(i0, i0 + 10)
    rng = np.random.default_rng(1)
    for _ in range(5_000):
        tree.take(tree.find(rng.random()))
    u = np.array([np.mean(1 / (1 + tree.taken[a : a + 11])) for a in range(0, 100_000, 997)])
    assert np.allclose(tree.tree[tree.leaves : tree.leaves + 100_000][::997], u)
