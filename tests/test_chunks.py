"""Differences and searches that run by chunks, and scans over models: against numpy and plain Python."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import econometrics as ec
from tidemark.operators import folds, learning, regression, risk, rolling, signals, weights

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def walks():
    rng = np.random.default_rng(12)
    return {"A": 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 1_700))), "B": 50 + rng.normal(size=300), "C": [5.0] * 40, "D": 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 25)))}


@pytest.fixture(scope="module")
def prices(spark, walks):
    return spark.createDataFrame([(s, START + dt.timedelta(hours=k), float(v)) for s, x in walks.items() for k, v in enumerate(x)], "symbol string, ts timestamp_ntz, close double").repartition(3)


@pytest.mark.parametrize("chunk", [500, 20_000])
def test_weighted_past(prices, walks, chunk):
    w = ec.ffd_weights(0.4, 1e-4)
    got = rolling.weighted_past(prices, F.col("close"), lambda _: w, len(w), "y", chunk=chunk).toPandas().sort_values("ts")
    assert 100 < len(w) < 500 and len(got) == sum(map(len, walks.values()))
    for s, x in walks.items():
        assert np.allclose(got[got["symbol"] == s]["y"], ec.frac_diff(np.array(x), 0.4, 1e-4), equal_nan=True), s


def test_wide_difference_of_a_series(prices, walks):
    got = folds.frac_diff(prices, 0.4, log=True).toPandas().sort_values("ts")
    a = got[got["symbol"] == "A"]["frac_diff"]
    assert a.notna().sum() == 1_700 - len(ec.ffd_weights(0.4)) + 1 and np.allclose(a, ec.frac_diff(np.log(walks["A"]), 0.4), equal_nan=True)


def plain_minimum(x, grid, least, max_lag, min_corr):
    tried = []
    for d in grid:
        y = ec.frac_diff(np.asarray(x, float), d)
        ok = np.isfinite(y)
        if ok.sum() >= least:
            c = np.corrcoef(np.asarray(x)[ok], y[ok])[0, 1] if ok.sum() > 10 and y[ok].std() > 0 else np.nan
            tried.append((d, ec.adf(y[ok] - y[ok].mean(), max_lag)[1], c))
    good = [t for t in tried if t[1] < 0.05]
    if min_corr is None:
        return (min(good) if good else max(tried)) if tried else None
    keeps = [t for t in good if t[2] >= min_corr]
    return min(keeps) if keeps else min(good) if good else (0.5, None, None)


@pytest.mark.parametrize(("min_corr", "max_lag"), [(None, None), (0.5, 12)])
def test_minimum_order(prices, walks, min_corr, max_lag):
    grid = [0.0, 0.3, 0.7, 1.0]
    with np.errstate(all="ignore"):
        want = {s: plain_minimum(x, grid, 20, max_lag, min_corr) for s, x in walks.items() if s != "C"}
    got = {r["symbol"]: r for r in risk.minimum_d(prices.where("symbol <> 'C'"), grid=grid, max_lag=max_lag, min_corr=min_corr).collect()}
    assert set(got) == set(want)
    for s, (d, p, c) in want.items():
        assert got[s]["d"] == d and (p is None or np.isclose(got[s]["p_value"], p, atol=1e-5)) and (c is None or np.isclose(got[s]["correlation"], c, atol=1e-6)), s


def test_scan_of_models(spark):
    rng = np.random.default_rng(2)
    rows = [(s, START + dt.timedelta(days=k), float(v), 10.0) for s in "VWXYZ" for k, v in enumerate(100 + rng.normal(size=90).cumsum())]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, volume double").repartition(4)
    names = ["bollinger_breakout", "momentum_rotation", "sma_crossover"]
    made = [signals.model(n, **({"fast": 5, "slow": 20} if n == "sma_crossover" else {})).signals(bars).toPandas() for n in names[:2]]
    last = {}
    for frame in made:
        for s, g in frame.sort_values("ts").groupby("symbol"):
            last.setdefault(s, []).append(g["signal"].iloc[-1])
    want = sorted(((s, float(np.mean(v))) for s, v in last.items()), key=lambda t: (-abs(t[1]), t[0]))[:3]
    got = [(r["symbol"], r["score"]) for r in signals.scan_universe(bars, names[:2], k=3).collect()]
    assert got == want


def test_one_feature_at_a_time(spark):
    """Accuracy by feature over purged folds is that of a model of the feature alone on the same folds."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 2))
    rows = [("S", START + dt.timedelta(hours=k), float(a), float(b), int(a + 0.3 * e > 0)) for k, ((a, b), e) in enumerate(zip(x, rng.normal(size=240), strict=True))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, a double, b double, label int")
    spans = df.select("symbol", F.col("ts").alias("t0"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("t1"))
    parts = weights.purged_kfold(spans, 3)
    got = {r["feature"]: r for r in learning.importance_sfi(df, parts, ["a", "b"]).collect()}
    roles = parts.toPandas()
    frame = df.toPandas()
    accuracies = []
    for _, g in roles.groupby("fold"):
        test = frame[frame["ts"].isin(g[g["role"] == "test"]["t0"])]
        accuracies.append(((test["a"] > 0).astype(int) == test["label"]).mean())
    assert abs(got["a"]["mean"] - np.mean(accuracies)) < 0.04 and got["a"]["mean"] > 0.85 and abs(got["b"]["mean"] - 0.5) < 0.15


@pytest.mark.parametrize(("lags", "chunk", "block"), [(1, 40, 32), (2, 20_000, 2_048), (0, 64, 50)])
def test_supremum_in_blocks(spark, walks, lags, chunk, block):
    rows = [("A", START + dt.timedelta(hours=k), float(v)) for k, v in enumerate(walks["A"][:150])] + [("B", START + dt.timedelta(hours=k), float(v)) for k, v in enumerate(walks["B"][:90])]
    rows += [("C", START + dt.timedelta(hours=k), float(k + 1)) for k in range(30)] + [("A", START - dt.timedelta(hours=1), None), ("B", START - dt.timedelta(hours=2), -1.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double").repartition(3)
    got = risk.sadf(df, least=20, lags=lags).toPandas() if chunk > 1_000 else regression.sadf(df, least=20, lags=lags, chunk=chunk, block=block).toPandas()
    assert len(got) == len(rows) and got.columns.tolist() == ["symbol", "ts", "close", "sadf"]
    got = got.sort_values("ts")
    for s, x in (("A", walks["A"][:150]), ("B", walks["B"][:90])):
        assert np.allclose(got[(got["symbol"] == s) & (got["close"] > 0)]["sadf"], ec.sadf(np.log(x), 20, lags), rtol=1e-5, equal_nan=True), s
    assert got[got["symbol"] == "C"]["sadf"].isna().all()
