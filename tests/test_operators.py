"""Grouped maps against pandas and numpy, published values, and invariants."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import econometrics as ec
from tidemark.functions import series as s
from tidemark.functions import text
from tidemark.operators import backtest, bars as barops, folds, intervals, learning, risk, signals, weights, windows
from tidemark.sources import market


def by_symbol(df, col):
    return df.toPandas().sort_values(["symbol", "ts"])[col].to_numpy()


def test_ewm_std_equals_pandas(bars, walk):
    want = walk.groupby("symbol")["close"].transform(lambda x: x.ewm(span=20).std()).to_numpy()
    assert np.allclose(by_symbol(folds.ewm_std(bars, "close", 20), "ewm_std").astype(float), want, equal_nan=True)


@pytest.mark.parametrize(("d", "width"), [(0.2, 3382), (0.4, 1458), (0.6, 590), (0.95, 79), (1.0, 2), (0.0, 1)])
def test_weight_counts(d, width):
    assert len(ec.ffd_weights(d)) == width


def test_frac_diff_wide_equals_expression(bars):
    narrow = folds.frac_diff(bars, 0.95, narrow=200).select("symbol", "ts", "frac_diff")
    wide = folds.frac_diff(bars, 0.95, narrow=1)
    assert np.allclose(by_symbol(narrow, "frac_diff").astype(float), by_symbol(wide, "frac_diff").astype(float), equal_nan=True)


def test_published_walk():
    rng = np.random.default_rng(0)
    x = np.log(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 2000))))
    p = {d: ec.adf(y[np.isfinite(y)])[1] for d in (0.5, 0.55) for y in [ec.frac_diff(np.exp(x), d)]}
    assert p[0.55] < 0.05 < p[0.5]


def test_adf_critical_values():
    assert [round(ec.mackinnon_p(t), 2) for t in (-3.43, -2.86, -2.57)] == [0.01, 0.05, 0.1]


def test_sadf_equals_regressions(walk):
    x = np.log(walk["close"].to_numpy()[:70])
    got = ec.sadf(x, 20, 1)
    for end in (45, 60):
        want = max(ec.adf(x[a:end], 1)[0] for a in range(end - 20))
        assert math.isclose(got[end], want, rel_tol=1e-5)


def test_triple_barrier_equals_loop(bars, walk):
    df = folds.daily_volatility(bars)
    got = folds.triple_barrier(df, bars=10).toPandas().set_index(["symbol", "ts"]).sort_index()
    vol = df.toPandas().set_index(["symbol", "ts"])["vol"]
    for symbol, g in walk.groupby("symbol"):
        p, ts = g["close"].to_numpy(), g["ts"].to_numpy()
        for i in range(20, len(p) - 10, 7):
            v = vol[(symbol, ts[i])]
            want = 0
            for x in p[i : i + 11]:
                if x >= p[i] * (1 + 2 * v):
                    want = 1
                elif x <= p[i] * (1 - v):
                    want = -1
                if want:
                    break
            assert got.loc[(symbol, ts[i]), "label"] == want


def test_cusum_resets():
    x = np.array([np.nan, 0.5, 0.6, 0.1, -0.4, -0.9])
    assert folds.cusum_path(x, 1.0).tolist() == [0, 0, 1, 0, 0, -1]


def test_flat_signals_keep_capital(bars):
    flat = bars.select("symbol", "ts", F.col("close").alias("price"), F.lit(0).alias("signal"))
    assert {r["equity"] for r in backtest.equity(flat).select("equity").distinct().collect()} == {100_000.0}
    assert backtest.trades(flat).count() == 0


def test_backtest_accounts(bars):
    sig = bars.select("symbol", "ts", F.col("close").alias("price"), F.when(F.col("volume") > 500, 1).otherwise(-1).alias("signal"))
    config = backtest.Config(max_bars=5, allow_short=False)
    t = backtest.trades(sig, config).toPandas()
    assert (t["direction"] == 1).all() and t["bars_held"].max() <= 5
    e = backtest.equity(sig, config).toPandas().sort_values("ts").groupby("symbol")["equity"].last()
    for symbol, g in t.groupby("symbol"):
        closed = g[g["exit_reason"] != "end_of_data"]["pnl"].sum()
        last = g[g["exit_reason"] == "end_of_data"]
        marked = ((last["exit_price"] - last["entry_price"]) * last["quantity"]).sum()
        assert math.isclose(e[symbol], 100_000 + closed + marked, rel_tol=1e-9)


def test_walk_forward_covers_tests_once(bars):
    c = backtest.Config(train=100, test=40)
    out = backtest.walk_forward_signals(bars.select("symbol", "ts", F.col("close").alias("price")), lambda a, b: np.full(len(b), len(a) == 100), c).toPandas()
    assert len(out) == 2 * 200 and (out["signal"] == 1).all() and not out.duplicated(["symbol", "ts"]).any()


def test_sweep_equals_range_join(bars):
    spans = bars.withColumn("t1", F.lead("ts", 7).over(s.by())).where("minute(ts) = 0 AND hour(ts) % 3 = 0").select("symbol", F.col("ts").alias("t0"), "t1")
    got = intervals.concurrency(bars, spans).toPandas().set_index(["symbol", "ts"])["concurrency"].sort_index()
    b, t = bars.select("symbol", "ts").toPandas(), spans.toPandas().dropna()
    want = b.merge(t, on="symbol").query("t0 <= ts <= t1").groupby(["symbol", "ts"]).size().reindex(got.index, fill_value=0)
    assert (got == want).all()


def test_weights_scale(bars):
    spans = bars.withColumn("t1", F.lead("ts", 7).over(s.by())).where("t1 is not null").select("symbol", F.col("ts").alias("t0"), "t1")
    w = weights.combined_weights(bars, spans, factor=0.99).groupBy("symbol").agg(F.sum("w").alias("s"), F.count("w").alias("n")).toPandas()
    assert np.allclose(w["s"], w["n"])
    u = weights.average_uniqueness(bars, spans).agg(F.min("avg_uniqueness"), F.max("avg_uniqueness")).first()
    assert 0 < u[0] <= u[1] <= 1


def test_folds_do_not_leak(bars):
    spans = bars.withColumn("t1", F.lead("ts", 7).over(s.by())).where("t1 is not null").select("symbol", F.col("ts").alias("t0"), "t1")
    for f, key in ((weights.purged_kfold(spans, 4), "fold"), (weights.combinatorial_purged(spans, 5, 2, "block"), "split")):
        d = f.join(spans, ["symbol", "t0"]).toPandas()
        for _, g in d.groupby(["symbol", key]):
            test, train = g[g["role"] == "test"], g[g["role"] == "train"]
            assert not len(test.merge(train, how="cross").query("t0_x <= t1_y and t0_y <= t1_x"))
    e = weights.purged_kfold(spans, 4, embargo=0.05)
    assert e.where("role = 'train'").count() < weights.purged_kfold(spans, 4).where("role = 'train'").count()


def test_combinations_and_paths(spark):
    from tidemark.operators import sets

    assert sets.combinations(spark, 10, 2).count() == 45


def test_bootstrap_is_seeded(bars):
    spans = bars.withColumn("i", s.position()).where("i % 5 = 0").select("symbol", F.col("i").cast("long").alias("label_id"), F.col("i").alias("i0"), (F.col("i") + 9).alias("i1"))
    a, b = (folds.sequential_bootstrap(spans, draws=20, seed=3).orderBy("symbol", "draw").collect() for _ in range(2))
    assert a == b and len(a) == 40


def test_dollar_bars_shrink_with_threshold(bars):
    n = [barops.dollar_bars(bars, t, "close", "volume").count() for t in (1e4, 1e5, 1e6)]
    assert n[0] > n[1] > n[2]


def test_indicator_ranges(bars):
    r = signals.RsiReversion().signals(bars).agg(F.min("rsi"), F.max("rsi")).first()
    assert 0 <= r[0] <= r[1] <= 100
    for name in signals.models():
        out = signals.model(name, **({"fast": 5, "slow": 20} if name == "sma_crossover" else {})).signals(bars)
        assert {x["signal"] for x in out.select("signal").distinct().collect()} <= {-1, 0, 1}
    with pytest.raises(ValueError):
        signals.model("none")


def test_exit_at_mid_only_flattens(bars):
    hold, leave = (signals.BollingerBreakout(exit_at_mid=x).signals(bars).select("symbol", "ts", "signal").toPandas().set_index(["symbol", "ts"])["signal"].sort_index() for x in (False, True))
    assert ((leave == hold) | (leave == 0)).all() and (leave == 0).sum() >= (hold == 0).sum()


def test_parkinson_forms(bars):
    d = bars.select(windows.parkinson_of_mean().alias("a"), windows.parkinson_mean_of().alias("b")).na.drop().toPandas()
    assert (d["a"] >= d["b"] - 1e-12).all()


def test_sharpe_inference(spark):
    one = spark.range(1).select(learning.psr(F.lit(0.1), F.lit(0.0), F.lit(100), F.lit(0.0), F.lit(3.0)).alias("hi"), learning.psr(F.lit(0.0), F.lit(0.1), F.lit(100), F.lit(0.0), F.lit(3.0)).alias("lo")).first()
    assert one["hi"] > 0.5 > one["lo"]
    assert learning.expected_max_sharpe(1) == 0 and learning.deflated_excess(1.0, 1, 100)["dsr"] == 1.0
    assert learning.expected_max_sharpe(100) > learning.expected_max_sharpe(10)


def test_normal_column(spark):
    for z in (-2.5, -1.0, 0.0, 0.3, 1.96):
        assert abs(spark.range(1).select(risk.phi(F.lit(z))).first()[0] - ec.PHI.cdf(z)) < 3e-7


def test_t_quantile():
    assert abs(ec.t_quantile(0.05, 10) + 1.8125) < 1e-3 and abs(ec.t_quantile(0.05, 5) + 2.015) < 1e-2


def test_garch_is_stationary():
    rng, h, r = np.random.default_rng(2), 1e-4, []
    for _ in range(1500):
        r.append(math.sqrt(h) * rng.normal())
        h = 5e-6 + 0.1 * r[-1] ** 2 + 0.85 * h
    g = ec.garch(np.array(r), student=False)
    assert 0.8 < g["persistence"] < 1 and 0.02 < g["alpha"] < 0.25


def test_bootstrap_var_near_parametric(bars):
    df = bars.withColumn("ret", s.ret("close"))
    a = {r["symbol"]: r["var"] for r in risk.var_parametric(df).collect()}
    b = {r["symbol"]: r["var"] for r in risk.var_bootstrap(df, draws=200, per_task=50).collect()}
    assert all(abs(a[k] - b[k]) < 0.3 * a[k] for k in a)


def test_chunks_cover_and_overlap(spark):
    body = "\n\n".join(f"Paragraph {i} " + "x" * 30 for i in range(20))
    got = spark.createDataFrame([(1, body), (2, None), (3, "")], "doc_id int, text string")
    rows = text.explode_chunks(got, size=100, overlap=20).orderBy("chunk").collect()
    assert {r["doc_id"] for r in rows} == {1} and all(f"Paragraph {i} " in " ".join(r["chunk_text"] for r in rows) for i in range(20))
    assert all(b["chunk_text"].startswith(a["chunk_text"][-20:]) for a, b in zip(rows, rows[1:], strict=False))


def test_parse_answer(spark):
    body = "ALPHA_DECAY: slow\nRISK_LEVEL: HIGH\nCONSENSUS:\nBuy\nKEY FINDINGS:\n- one\n- two\nRECOMMENDATIONS:\n- wait\nCITATIONS:\n- none"
    r = text.parse_answer(spark.createDataFrame([(body,), ("",)], "text string")).collect()
    assert (r[0]["risk_level"], r[0]["consensus"], r[0]["findings"]) == ("HIGH", "Buy", ["one", "two"]) and r[1]["findings"] == []


def test_market_sources(spark, bars, tmp_path):
    market.write_bars(bars, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).where("symbol = 'AAA'").count() == 300
    market.register(spark)
    df = spark.read.format("synthetic_bars").option("symbols", "X,Y").option("n", 50).load()
    assert df.where("symbol = 'X'").count() == 50 and df.where("high >= greatest(open, close) AND low <= least(open, close)").count() == 100
    with pytest.raises(ValueError):
        market.history(bars, "none")
    with pytest.raises(ValueError):
        market.screen(bars, "none")
    raw = spark.createDataFrame([("2024-01-02", 1.0, 9)], "Date string, `Adj Close` double, other int")
    assert market.normalise(raw).columns == ["ts", "close"]


def test_streaming_equals_batch(spark, bars, tmp_path):
    from tidemark.streaming import live

    trades = bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col("close").alias("price"), F.col("volume").alias("size"))
    for k in range(3):
        trades.where(f"pmod(datediff(ts, '2024-01-01'), 1000) >= {5 * k} AND pmod(datediff(ts, '2024-01-01'), 1000) < {5 * (k + 1) if k < 2 else 10**6}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(trades.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = live.cusum(stream, 0.03).writeStream.format("memory").queryName("cusum_test").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["symbol"], r["ts"], r["event"]) for r in spark.table("cusum_test").collect()}
    want = {(r["symbol"], r["t"], r["event"]) for r in folds.cusum(bars, threshold=0.03).where("event <> 0").select("symbol", F.col("ts").cast("timestamp").alias("t"), "event").collect()}
    assert got == want
    seen = []
    live.start(stream, lambda df, i: seen.append(df.count()), str(tmp_path / "cp2")).awaitTermination()
    assert sum(seen) == 600


def test_null_and_empty_series(spark):
    empty = spark.createDataFrame([], "symbol string, ts timestamp_ntz, close double, high double, low double, volume double")
    assert folds.triple_barrier(folds.daily_volatility(empty)).count() == 0 and risk.adf_test(empty).count() == 0 and windows.trend_scan(empty).count() == 0
    one = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), None, None, None, None)], empty.schema)
    assert windows.kyle_lambda(one).first()["kyle_lambda"] is None and folds.cusum(one, threshold=1.0).first()["event"] == 0


def test_sequential_bootstrap_takes_every_span(spark):
    from tests.oracle import SF
    from tidemark import catalog
    from tidemark.catalog.book import VIEWS

    got = catalog.load()[0]["F12_sequential_bootstrap"](spark, SF).groupBy("symbol", "replicate").count().toPandas()
    rows = VIEWS["user_ticks"](spark, SF).groupBy("symbol").count().toPandas().set_index("symbol")["count"]
    want = {k: n - 6 for k, n in rows.items() if n > 6}
    assert want and {(a, b): n for a, b, n in got.itertuples(index=False)} == {(k, r): n for k, n in want.items() for r in (0, 1)}


def test_a_span_at_every_bar(bars, walk):
    """Ten-bar spans from every bar, so that eleven overlap: concurrency, uniqueness and purged folds by brute force."""
    spans = bars.withColumn("t1", F.lead("ts", 10).over(s.by())).where("t1 IS NOT NULL").select("symbol", F.col("ts").alias("t0"), "t1")
    n, life = 300, [(k, k + 10) for k in range(290)]
    active = np.array([sum(a <= t <= b for a, b in life) for t in range(n)])
    found = intervals.concurrency(bars, spans).toPandas().sort_values(["symbol", "ts"])
    assert active.max() == 11 and found["concurrency"].tolist() == [*active, *active]
    u = weights.average_uniqueness(bars, spans).toPandas().sort_values(["symbol", "t0"])["avg_uniqueness"].to_numpy()
    assert np.allclose(u, [np.mean(1 / active[a : b + 1]) for a, b in life] * 2)
    roles = weights.purged_kfold(spans).where("symbol = 'AAA'").toPandas()
    at = {t: k for k, t in enumerate(walk[walk["symbol"] == "AAA"]["ts"])}
    want = {}
    for f in range(5):
        lo, hi = 58 * f, 58 * f + 57
        for k, (a, b) in enumerate(life):
            role = "test" if lo <= k <= hi else "train" if b < lo or a > hi + 10 else None
            if role:
                want[(f, k)] = role
    assert {(f, at[t]): r for f, t, r in zip(roles["fold"], roles["t0"], roles["role"], strict=True)} == want


def test_streams_go_to_files(spark, bars):
    """Streams of the catalog are read back from files, not from a table in the driver."""
    from tests.oracle import SF
    from tidemark.catalog import streams

    raw = streams.stream(spark, SF)
    for df, mode in ((raw, "append"), (raw.groupBy("symbol").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n")), "complete")):
        got = streams.collected(spark, df, mode)
        assert got.inputFiles() and (got.count() if mode == "append" else got.agg(F.sum("n")).first()[0]) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_nearest_in_blocks(spark):
    from tidemark.operators import sets

    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4)]) for i in range(60)], "vec_id long, embedding array<double>")
    queries = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    one, many = (sorted(map(tuple, sets.nearest(rows, queries, 3, block=b).collect())) for b in (1000, 20))
    assert one == many and len(one) == 180


def test_catalog_takes_all_features_and_models(spark):
    from tests.oracle import SF
    from tidemark import catalog
    from tidemark.catalog import models
    from tidemark.operators import forecast

    queries = catalog.load()[0]
    assert {r["feature"] for r in queries["M8_importance_sfi"](spark, SF).collect()} == set(models.FEATURES)
    assert queries["X9_forecast_ensemble"](spark, SF).agg(F.max("n_models")).first()[0] == len(forecast.MODELS)


def holes(walk):
    x = walk.copy()
    x.loc[np.random.default_rng(4).choice(len(x), len(x) // 9, replace=False), "close"] = np.nan
    return x


@pytest.mark.parametrize("span", [1, 2, 12, 90])
def test_ewm_equals_recursion(spark, walk, span):
    """Sums over blocks give what one pass over the series gives, nulls included."""
    for table, adjust in ((walk, True), (walk, False), (holes(walk), True)):
        df = spark.createDataFrame(table[["symbol", "ts", "close"]]).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
        got = folds.ewm_std(folds.ewm_mean(df, "close", span, adjust, "m", least=3), "close", span, "s").toPandas().sort_values(["symbol", "ts"])
        table = table.sort_values(["symbol", "ts"])
        by = table.groupby("symbol")["close"]
        np.testing.assert_allclose(got["m"].to_numpy(float), by.transform(lambda v: v.ewm(span=span, adjust=adjust, min_periods=3).mean()).to_numpy(), rtol=1e-9)
        np.testing.assert_allclose(got["s"].to_numpy(float), by.transform(lambda v: v.ewm(span=span).std()).to_numpy(), rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("n", [21, 25, 29, 30, 60])
def test_hurst_needs_ten_values_beyond_the_lags(spark, n):
    x = np.cumsum(np.random.default_rng(n).normal(size=n)) + 50
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "symbol string, ts int, close double")
    want = 0.5 if n < 30 else np.polyfit(np.log(range(2, 20)), np.log([np.var(x[k:] - x[:-k]) for k in range(2, 20)]), 1)[0] / 2
    assert math.isclose(risk.hurst(df).first()["hurst"], want, rel_tol=1e-9)


def test_lempel_ziv_phrases():
    """0 | 1 | 00 | 010 and the rest 1, which occurs before: four phrases and one."""
    assert math.isclose(ec.lempel_ziv(np.array([0, 1, 0, 0, 0, 1, 0, 1])), 5 / (8 / math.log2(9)))
    assert ec.lempel_ziv(np.zeros(0)) == 0


def test_cointegration_flag(spark):
    """A pair that shares a walk is cointegrated, two walks of their own are not."""
    rng = np.random.default_rng(2)
    base, other = 100 + rng.normal(size=400).cumsum(), 100 + rng.normal(size=400).cumsum()
    for second, flag in ((1.5 * base + 3 + rng.normal(0, 0.5, 400), True), (other, False)):
        df = spark.createDataFrame([("p", i, float(a), float(b)) for i, (a, b) in enumerate(zip(second, base, strict=True))], "symbol string, ts int, s1 double, s2 double")
        row = risk.engle_granger(df).first()
        assert row["is_cointegrated"] is flag and (row["p_value"] < 0.05) is flag
