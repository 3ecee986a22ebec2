"""Pooled learners, long regressions, and reports: against hand-made folds, the numpy forms and plain formatting."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import econometrics as ec
from tidemark.operators import learners, regression, report, risk

START = dt.datetime(2024, 1, 1)


def series(spark, **values):
    rows = [(s, START + dt.timedelta(hours=k), float(v) if v is not None else None) for s, x in values.items() for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double").repartition(3)


@pytest.mark.parametrize("chunk", [60, 20_000])
def test_adf_equals_numpy(spark, chunk):
    rng = np.random.default_rng(3)
    walk, noise = 1e6 + rng.normal(size=700).cumsum(), rng.normal(size=333)
    ar = [0.0]
    for e in rng.normal(size=400):
        ar.append(0.7 * ar[-1] + e)
    own = {"walk": walk, "noise": noise, "ar": ar, "ten": rng.normal(size=10), "nine": rng.normal(size=9), "flat": [4.0] * 60, "gaps": [None if k % 7 == 0 else v for k, v in enumerate(noise)], "eleven": rng.normal(size=11).cumsum()}
    got = {r["symbol"]: r for r in regression.adf_test(series(spark, **own), chunk=chunk).collect()}
    assert set(got) == set(own)
    for name, x in own.items():
        known = np.array([v for v in x if v is not None])
        tau, p, lag = ec.adf(known - known.mean())  # the numpy form loses digits far from 0
        assert got[name]["lag"] == lag and np.isclose(got[name]["p_value"], p, atol=1e-6) and got[name]["is_stationary"] == (p < 0.05), name
        assert (got[name]["adf_stat"] is None and np.isnan(tau)) or np.isclose(got[name]["adf_stat"], tau, rtol=1e-5, equal_nan=True), name
    fixed = {r["symbol"]: r["adf_stat"] for r in regression.adf_test(series(spark, walk=walk), max_lag=3, chunk=chunk).collect()}
    assert np.isclose(fixed["walk"], ec.adf(walk - walk.mean(), 3)[0], rtol=1e-5)


@pytest.fixture(scope="module")
def prices(spark):
    rng = np.random.default_rng(9)
    return series(spark, A=100 * np.exp(np.cumsum(rng.normal(0, 0.01, 260))), B=50 * np.exp(np.cumsum(rng.normal(0, 0.02, 200))), SHORT=[1.0, 2.0, 3.0])


def test_errors_of_a_hand_made_fold(prices):
    """Root mean squared errors over each symbol's last fifth, from models of the rest."""
    small = {"forest": {"numTrees": 7}, "boosting": {"maxIter": 4}}
    one = learners.Learners.train(prices, **small)
    table, names = learners.learning_table(prices)
    rows = table.where("target is not null").toPandas().sort_values(["symbol", "ts"])
    rows["place"] = rows.groupby("symbol").cumcount() / (rows.groupby("symbol")["ts"].transform("size") - 1)
    train, test = rows[rows["place"] < 0.8], rows[rows["place"] >= 0.8].copy()
    x, mean, sd = train[names].to_numpy(), train[names].mean().to_numpy(), train[names].std().to_numpy()
    z = lambda t: (t[names].to_numpy() - mean) / sd
    y = train["target"].to_numpy()
    got = {(r["symbol"], r["model"]): r["rmse"] for r in one.errors.collect()}
    assert set(got) == {(s, m) for s in "AB" for m in learners.LEARNERS} and x.shape[1] > 15
    # ridge as the library states it: squared errors halved and averaged, target and features in units of their deviation
    ys, lam = y.std(ddof=1), 1e-3
    a = z(train)
    b = np.linalg.solve(a.T @ a / len(a) + lam / ys * ys * np.eye(a.shape[1]) * (len(a) - 1) / len(a), a.T @ (y - y.mean()) / len(a))
    for s, g in test.groupby("symbol"):
        err = float(np.sqrt(np.mean((z(g) @ b + y.mean() - g["target"]) ** 2)))
        assert np.isclose(got[s, "ridge"], err, rtol=2e-2)
        naive = float(np.sqrt(np.mean(g["target"] ** 2)))
        assert all(got[s, m] < 2.5 * naive for m in learners.LEARNERS)


def test_paths_feed_forecasts_back(spark, prices):
    one = learners.Learners.train(prices, learners=("ridge",))
    got = one.paths(prices, horizon=3).toPandas().sort_values(["symbol", "step"])
    assert set(got["symbol"]) == {"A", "B"} and got.groupby("symbol")["step"].apply(list).tolist() == [[1, 2, 3]] * 2
    full = {s: g.sort_values("ts")["close"].tolist() for s, g in prices.toPandas().groupby("symbol") if s != "SHORT"}
    for _ in range(3):  # the same with whole series instead of tails
        bars = series(spark, **full)
        from tidemark.operators.windows import forecast_features

        feats = forecast_features(bars.withColumnRenamed("close", "price"), "price").na.drop(subset=one.features)
        last = feats.groupBy("symbol").agg(F.max_by(F.struct(*feats.columns), "ts").alias("x")).select("x.*")
        for r in one.models["ridge"].transform(last).collect():
            full[r["symbol"]].append(r["price"] * (1 + r["yhat"]))
    want = [v for s in ("A", "B") for v in full[s][-3:]]
    assert np.allclose(got["yhat"], want, rtol=1e-9)
    last = got["symbol"].map({r["symbol"]: r["close"] for r in prices.orderBy("ts").collect()})
    assert np.allclose(got["yhat"] - got["lo"], 1.645 * got["rmse"] * np.sqrt(got["step"]) * last) and np.allclose(got["hi"] - got["yhat"], got["yhat"] - got["lo"])


def test_unknown_learner():
    with pytest.raises(ValueError):
        learners.regressor("oracle", ["a"])


def test_report_blocks(spark, prices):
    rets = prices.withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")) - 1).where("symbol <> 'SHORT'")
    got = {r["symbol"]: r for r in report.risk_report(rets, draws=200).collect()}
    tails = {r["symbol"]: r for r in risk.fat_tails(rets).join(risk.ks_normal(rets), "symbol").collect()}
    var = {(r["symbol"], r["method"]): r for r in risk.var_all(rets).collect()}
    boot = {r["symbol"]: r for r in risk.var_bootstrap(rets, draws=200).collect()}
    for s, r in got.items():
        t = tails[s]
        assert r["tail_block"] == (
            f"  - Skewness: {t['skewness']:.4f}\n  - Excess Kurtosis: {t['excess_kurtosis']:.4f}  ({t['tail_class']})\n"
            f"  - Jarque-Bera p-value: {t['jb_p']:.4e}  ({'Normal' if t['jb_p'] > 0.05 else 'NON-Normal'})\n  - KS-test p-value: {t['ks_p']:.4e}"
        )
        lines = r["var_block"].split("\n")
        assert [x.split(":")[0] for x in lines] == [f"  - {n}" for n in report.METHODS.values()]
        assert lines[0].startswith(f"  - Parametric (Normal): VaR = {var[s, 'parametric']['var']:.4%}")
        assert lines[3] == f"  - Bootstrap: VaR = {boot[s]['var']:.4%}  [95% CI: {boot[s]['lo']:.4%} - {boot[s]['hi']:.4%}]"


def test_report_gaps(spark):
    rows = spark.createDataFrame([("A", "parametric", None, 0.02, None, None), ("A", "other", 0.01, None, 0.005, 0.02), ("A", "historical", 0.0, None, None, None)], "symbol string, method string, var double, cvar double, lo double, hi double")
    block = report.var_blocks(rows).first()["var_block"]
    assert block == "  - Parametric (Normal): N/A,  CVaR = 2.0000%\n  - Historical Simulation: N/A\n  - other: VaR = 1.0000%  [95% CI: 0.5000% - 2.0000%]"
    fit = spark.createDataFrame([(0.05, 0.9, 0.95, 5.0, 0.2, None, 10.25, 20.0), (None,) * 8], "a double, b double, p double, nu double, v double, l double, aic double, bic double")
    texts = [r[0] for r in fit.select(report.garch_block(*[F.col(c) for c in fit.columns])).collect()]
    assert texts[0] == "  - alpha = 0.0500,  beta = 0.9000,  persistence (alpha+beta) = 0.9500\n  - Distribution: Student-t\n  - Current Conditional Vol (ann.): 20.00%\n  - AIC: 10.3   BIC: 20.0" and texts[1] == report.NO_GARCH
