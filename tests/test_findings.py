"""Odd rows that reviewers found: prices of 0, ticks of one time, running values that reach a threshold exactly."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import SF, assert_same, connect
from tidemark import catalog
from tidemark.catalog import windows as window_queries
from tidemark.functions import econometrics as ec
from tidemark.operators import backtest, bars, folds, forecast, learners, learning, regression, risk, sets, weights
from tidemark.plans import pipelines
from tidemark.streaming import machines

QUERIES, SQL = catalog.load()


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A folder of events of which some have a price of 0 and some the time of the row before."""
    path = tmp_path_factory.mktemp("odd")
    duckdb.sql(
        f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 97 = 40 THEN 0 ELSE value END AS value) FROM '{SF}/events.parquet') TO '{path}/events.parquet' (FORMAT parquet)"""
    )
    tied = path / "tied"
    tied.mkdir()
    duckdb.sql(
        f"""COPY (SELECT * EXCLUDE (before, i) REPLACE (CASE WHEN i % 40 = 7 THEN before ELSE ts END AS ts) FROM (SELECT *, lag(ts) OVER w AS before, row_number() OVER w AS i
            FROM '{SF}/events.parquet' WINDOW w AS (PARTITION BY event_type ORDER BY ts))) TO '{tied}/events.parquet' (FORMAT parquet)"""
    )
    return str(path)


@pytest.mark.parametrize("name", ["P2_log_returns", "P5_elementwise", "W17_trend_scan", "W22_forecast_features", "C4_weights_by_return", "C6_combined_weights", "F2_cusum_events", "F3_cusum_signed"])
def test_prices_of_0(spark, odd, name):
    assert_same(QUERIES[name](spark, odd).toPandas(), connect(odd).sql(SQL[name]).df())


@pytest.mark.parametrize("name", ["C10_cross_validation", "M15_orthogonal_features"])
def test_feature_tables_with_prices_of_0(spark, odd, name):
    assert QUERIES[name](spark, odd).count() > 0


def test_fractional_differences_of_infinite_logs(spark):
    close = [5.0, 0.0, 3.0, 2.0, 0.0, 4.0, None, *np.linspace(1, 2, 12).tolist()]
    rows = spark.createDataFrame([("A", i, v) for i, v in enumerate(close)], "symbol string, ts int, close double")
    wide = [r["frac_diff"] for r in folds.frac_diff(rows, 0.4, log=True, threshold=0.05, narrow=0).orderBy("ts").collect()]
    narrow = [r["frac_diff"] for r in folds.frac_diff(rows, 0.4, log=True, threshold=0.05).orderBy("ts").collect()]
    same = lambda a, b: (a is None) == (b is None) and (a is None or a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) < 1e-9)
    assert all(map(same, wide, narrow)) and any(v is not None and math.isnan(v) for v in wide) and any(v is not None and math.isinf(v) for v in wide)


@pytest.mark.parametrize("name", ["P14_meta_labels", "A1_dollar_bars", "T2_dollar_bars", "T2_positions", "F14_live_positions"])
def test_ticks_of_one_time(spark, odd, name):
    """What SQL leaves open among ticks of one time is left out: first and last price of a bar, the direction of a position."""
    got, want = QUERIES[name](spark, f"{odd}/tied").toPandas(), connect(f"{odd}/tied").sql(SQL[name]).df()
    free = [c for c in ("open", "close", "position", "changes") if c in got.columns]
    late = lambda df: df[df["action"] != "CLOSE"] if "action" in df else df
    assert_same(late(got).drop(columns=free), late(want).drop(columns=free))


def test_running_values_that_reach_the_threshold(spark):
    prices = [0.1] * 100
    rows = spark.createDataFrame([("A", i, p, 1.0) for i, p in enumerate(prices)], "symbol string, ts int, price double, size double")
    got = {r["bar_id"]: round(r["volume"]) for r in bars.dollar_bars(rows, 1.0).collect()}
    assert got == {0: 9, **{k: 10 for k in range(1, 10)}, 10: 1}
    close = spark.createDataFrame([("A", 0, 19_999.995, 1.0), ("A", 1, 0.005, 1.0)], "symbol string, ts int, price double, size double")
    assert sorted(r["bar_id"] for r in bars.dollar_bars(close, 20_000.0).collect()) == [0, 1]
    held, sent = None, []
    for i, p in enumerate(prices):
        held = machines.DollarBars(1.0).tick(held, i, p, 1.0, lambda *row: sent.append(row))
    assert [(r[0], round(r[6])) for r in sent] == [(0, 9), *[(k, 10) for k in range(1, 10)]] and held[1] == 10


def test_recursions_take_a_series_in_batches(spark):
    """Batches of 7 rows give what whole series give, across two symbols in one task."""
    rng, rows = np.random.default_rng(4), []
    for name in ("A", "B", "C"):
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 60)))
        rows += [(name, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(p), int(g)) for i, (p, g) in enumerate(zip(price, rng.integers(-1, 2, 60)))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, price double, signal int").repartition(3)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        events = {(r["symbol"], r["ts"]): r["event"] for r in folds.cusum(df, "price").collect()}
        trades = sorted(tuple(r) for r in backtest.trades(df).collect())
        curve = {(r["symbol"], r["ts"]): r["equity"] for r in backtest.equity(df).collect()}
    finally:
        spark.conf.set(key, before)
    want_trades = []
    for name in ("A", "B", "C"):
        own = [r for r in rows if r[0] == name]
        price = np.array([r[2] for r in own])
        lr = np.diff(np.log(price), prepend=np.nan)
        assert [events[name, r[1]] for r in own] == folds.cusum_path(lr, float(np.nanstd(lr, ddof=1))).tolist()
        found, equity = backtest.simulate([r[1] for r in own], price, [r[3] for r in own], backtest.Config())
        want_trades += [(name, *x) for x in found]
        assert np.allclose([curve[name, r[1]] for r in own], equity)
    assert len(trades) == len(want_trades) and all(a[:4] == b[:4] and a[-1] == b[-1] and np.allclose(a[4:9], b[4:9]) for a, b in zip(trades, sorted(want_trades)))


def test_recurrences_equal_plain_loops():
    x = np.random.default_rng(2).normal(size=1_003)
    h = [3.0]
    for v in x:
        h.append(0.9 * h[-1] + v)
    assert np.allclose(ec.recurrence([x], np.array([[0.9]]), np.array([3.0]))[0], h, rtol=1e-12)
    step, state = np.array([[0.7, 0.2], [-0.1, 0.9]]), [np.array([1.0, -1.0])]
    for v in x:
        state.append(step @ state[-1] + np.array([v, 2 * v]))
    assert np.allclose(ec.recurrence([x, 2 * x], step, state[0]), np.array(state).T, rtol=1e-11)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_by_products_keep_ties(spark, metric):
    """Candidates from products of matrices lose no row of equal distance, of which the least ids count."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).round(3)
    v[100:140], v[200:220] = v[7], v[20]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(5)
    ask = df.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    got = {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in sets.nearest(df, ask, 5, metric=metric, block=10).collect()}
    f = v.astype(np.float32).astype(float)
    for q in range(0, 300, 20):
        d = np.sqrt(((f - f[q]) ** 2).sum(1)) if metric == "l2" else 1 - f @ f[q] / np.sqrt((f * f).sum(1) * (f[q] @ f[q]))
        order = sorted((round(float(x), 6) + 0.0, i) for i, x in enumerate(d) if i != q)[:5]
        assert [got[q, r + 1][0] for r in range(5)] == [i for _, i in order] and np.allclose([got[q, r + 1][1] for r in range(5)], [x for x, _ in order], atol=1e-6)


@pytest.fixture(scope="module")
def two(spark):
    """Two walks of 400 and 90 rows."""
    rng = np.random.default_rng(5)
    x = {"A": 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 400))), "B": 50 + rng.normal(size=90)}
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), float(v)) for s, xs in x.items() for k, v in enumerate(xs)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double").repartition(3), x


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_windows_of_short_series_are_solved_in_one_pass(two):
    df, x = two
    out = regression.sadf(df, least=20)
    assert "CoGroup" not in plan(out)
    got = out.toPandas().sort_values("ts")
    for s, v in x.items():
        assert np.allclose(got[got["symbol"] == s]["sadf"], ec.sadf(np.log(v), 20, 1), rtol=1e-6, equal_nan=True), s
    both = regression.sadf(df, least=20, chunk=70, block=100).toPandas().sort_values("ts")  # A by blocks, B whole
    assert len(both) == len(got) and np.allclose(both.sort_values(["symbol", "ts"])["sadf"], got.sort_values(["symbol", "ts"])["sadf"], rtol=1e-6, equal_nan=True)


def test_nearly_dependent_columns_take_the_pseudo_inverse():
    x = np.arange(60.0)
    m = regression.adf_rows(x, 1)
    m = np.stack([m.T @ m, m[:30].T @ m[:30]])
    assert np.allclose(regression._solved(m, np.arange(4)), regression._pseudo(m))


@pytest.mark.parametrize("gaps", [False, True])
def test_differences_are_not_written(two, monkeypatch, gaps):
    df, x = two
    if gaps:
        df = df.withColumn("close", F.when(~F.hour("ts").isin(5) | (F.col("symbol") == "B"), F.col("close")))
    written, real = [], risk.materialise

    def counting(table, name):
        out = real(table, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(risk, "materialise", counting)
    grid = [1.0, 0.8, 2.0]
    got = {(r["symbol"], r["d"]): r for r in risk.differences_tested(df.withColumnRenamed("close", "x"), grid, chunk=60).collect()}
    assert max(written) <= 490
    for s in x:
        v = np.array([np.nan if r["close"] is None else r["close"] for r in df.where(F.col("symbol") == s).orderBy("ts").collect()])
        for d in grid:
            y = ec.frac_diff(v, d)
            y = y[np.isfinite(y)]
            if len(y):
                assert got[s, d]["n"] == len(y) and np.isclose(got[s, d]["p_value"], ec.adf(y)[1], atol=1e-4), (s, d)


def test_resamples_are_places(two):
    for n in (1, 2, 7, 90, 5_000):
        r, at = np.sort(np.random.default_rng(n).normal(size=n)), (1 - 0.95) * (n - 1)
        a, b = np.random.default_rng([42, 3]), np.random.default_rng([42, 3])
        for _ in range(50):
            low, high = risk.resampled_ranks(b, n, at, 64)
            assert np.isclose(r[low] + (r[high] - r[low]) * (at % 1), np.quantile(r[a.integers(0, n, n)], 1 - 0.95), rtol=1e-12, atol=1e-15)
    df, x = two
    got = {r["symbol"]: r for r in risk.var_bootstrap(df, "close", draws=150, per_task=100).collect()}
    for s, v in x.items():
        v, want = np.sort(v), []
        for chunk, n in ((0, 100), (1, 50)):
            rng = np.random.default_rng([42, chunk])
            want += [-np.quantile(v[rng.integers(0, len(v), len(v))], 1 - 0.95) for _ in range(n)]
        assert np.allclose([got[s]["var"], got[s]["lo"], got[s]["hi"]], [np.mean(want), *np.quantile(want, [0.025, 0.975])], rtol=1e-12), s


def test_distance_to_the_normal_takes_no_window_over_a_whole_series(two):
    assert "unboundedfollowing" not in plan(risk.ks_normal(two[0], "close"))


def test_equity_takes_no_window(two):
    df = two[0].withColumn("price", F.col("close")).withColumn("signal", F.when(F.hour("ts") < 12, 1).otherwise(-1))
    out = backtest.equity(df)
    assert "Window" not in plan(out)
    for _, g in out.toPandas().sort_values("ts").groupby("symbol"):
        assert np.allclose(g["ret"], g["equity"].pct_change(), equal_nan=True) and np.allclose(g["drawdown"], g["equity"] / g["equity"].cummax() - 1)


def test_ridge_takes_a_series_in_parts(two):
    df, x = two
    out = forecast.forecasts(df, 10, ("ridge",))
    assert "FlatMapGroups" not in plan(out)
    got = {s: g.sort_values("step") for s, g in out.toPandas().groupby("symbol")}
    for s, v in x.items():
        z = np.array([forecast._design(v[: i + 1][-60:]) for i in range(25, len(v) - 1)])
        y, cut = v[26:] / v[25:-1] - 1, int(0.8 * (len(v) - 26))
        fit = lambda a, b: np.linalg.solve(a.T @ a + np.eye(9), a.T @ b)
        assert np.isclose(got[s]["rmse"].iloc[0], np.sqrt(np.mean((y[cut:] - z[cut:] @ fit(z[:cut], y[:cut])) ** 2)))
        first = v[-1] * (1 + forecast._design(v[-60:]) @ fit(z, y))
        band = forecast.Z90 * y.std() * v[-1]
        assert np.allclose(got[s].iloc[0][["yhat", "lo", "hi"]].astype(float), [first, first - band, first + band])


def test_trees_are_trained_on_more_tasks_than_symbols(spark, two):
    df = spark.range(45_000).select(F.lit("A").alias("symbol"), "id", F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"))
    out = learning.spread(df)
    sizes = [len(p) for p in out.select("id").rdd.glom().collect()]
    assert len(sizes) == 5 and sum(sizes) == 45_000 and min(sizes) > 5_000


def test_series_stay_whole_after_a_join(spark, two):
    old = {c: spark.conf.get(c, None) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
        assert forecast.forecasts(two[0].repartition(8, "ts"), 10, ("ridge",)).count() == 20
        assert len(regression.sadf(two[0].repartition(8, "ts"), least=20, block=100).toPandas().dropna()) == 400 - 40 + 90 - 40
    finally:
        for c, v in old.items():
            spark.conf.set(c, v) if v is not None else spark.conf.unset(c)


@pytest.fixture(scope="module")
def thrice(spark):
    """100 times with three ticks each, and spans over them."""
    rng = np.random.default_rng(4)
    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(hours=k // 3), float(a), float(b), int(a > 0)) for k, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, a double, b double, label int")
    return df, df.select("symbol", F.col("ts").alias("t0"), F.col("ts").alias("t1"))


def test_ticks_of_one_time_do_not_multiply_in_folds(thrice):
    df, spans = thrice
    folds = weights.purged_kfold(spans, 3)
    assert sum(r["n"] for r in learning.cross_validate(learning.logistic(["a", "b"]), df, folds).collect()) <= 306  # a time at an end of a fold is in both
    some = folds.unionByName(folds.where("role = 'train'").withColumn("fold", F.lit(9)))  # a fold without test rows
    got = {r["feature"]: r["importance"] for r in learning.importance_mda(learning.logistic(["a", "b"]), df, some, ["a", "b"]).collect()}
    assert 1.0 < got["a"] < 2.0 and abs(got["b"]) < 0.2


def counted(spark):
    """A column function that counts the rows it sees, and its count."""
    seen = spark.sparkContext.accumulator(0)
    return F.udf(lambda x: (seen.add(1), x)[1], "double"), seen


def test_rows_are_dealt_to_folds_once_for_all_features(spark, thrice):
    df, spans = thrice
    count, seen = counted(spark)
    folds = weights.purged_kfold(spans, 3).select("symbol", "fold", "t0", F.when(count(F.lit(1.0) + F.col("fold")) > 0, F.col("role")).alias("role"))
    got = {r["feature"]: r["mean"] for r in learning.importance_sfi(df, folds, ["a", "b"]).collect()}
    assert got["a"] > 0.9 > got["b"] and seen.value == weights.purged_kfold(spans, 3).count()


def test_boosting_passes_over_few_tasks(spark, monkeypatch):
    """Some hundred passes of one small tree each: 45,000 rows are one task, for a forest five."""
    df = spark.range(45_000).select(F.lit("A").alias("symbol"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), F.rand(1).alias("a"), (F.col("id") % 2).cast("int").alias("label"))
    tasks, spread = [], learning.spread
    monkeypatch.setattr(learning, "spread", lambda *a: (out := spread(*a), tasks.append(out.rdd.getNumPartitions()))[0])
    learning.fit(learning.boosting(["a"], rounds=1), df)
    learning.fit(learning.forest(["a"], trees=1), df)
    assert tasks == [1, 5]


def test_stack_reads_its_rows_once(spark, thrice):
    count, seen = counted(spark)
    df = thrice[0].withColumn("a", count("a"))
    stack = learning.Stack.train([learning.forest(["a", "b"], trees=2, leaf=1), learning.logistic(["a", "b"])], df)
    assert seen.value == 300 and stack.predict(thrice[0]).count() == 300


def written_by(monkeypatch, module):
    """A list of the (name, rows) that a module writes from now on."""
    found, real = [], module.materialise

    def counting(table, name):
        out = real(table, name)
        found.append((name, out.count()))
        return out

    monkeypatch.setattr(module, "materialise", counting)
    return found


def test_folds_of_a_forest_are_written_once(thrice, monkeypatch):
    """Three folds: not three rows for one, and no copy of each fold's train rows."""
    df, spans = thrice
    written = written_by(monkeypatch, learning)
    assert learning.cross_validate(learning.forest(["a", "b"], trees=2, leaf=1), df, weights.purged_kfold(spans, 3)).count() == 3
    assert written == [("folds", 300)]


def test_python_steps_of_the_feature_table_take_narrow_rows(bars, monkeypatch):
    taken = {}
    for name in ("cusum", "frac_diff", "shannon_entropy"):
        monkeypatch.setattr(folds, name, lambda df, *a, f=getattr(folds, name), n=name, **k: (taken.update({n: len(df.columns)}), f(df, *a, **k))[1])
    out, names = pipelines.feature_table(bars)
    assert max(taken.values()) <= len(bars.columns) + 2 and names[-3:] == ["ffd", "event", "shannon_entropy"] and out.columns == [*bars.columns, *names]


def test_parts_in_time_are_those_of_the_split(two):
    df = two[0]
    for want, got in zip(("train", "test"), weights.parts_in_time(df), strict=True):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, weights.temporal_split(df).where(F.col("role") == want).drop("role").collect()))


def test_meta_labels_make_their_features_once(spark, monkeypatch):
    price = 100 * np.exp(np.cumsum(np.random.default_rng(3).normal(0, 0.01, 1_500)))
    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), float(p), float(p) * 1.01, float(p) * 0.99, 10.0 + k % 7) for k, p in enumerate(price)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, high double, low double, volume double")
    made, real = [], pipelines.feature_table
    monkeypatch.setattr(pipelines, "feature_table", lambda *a, **k: (made.append(1), real(*a, **k))[1])
    written = written_by(monkeypatch, learning)
    p = pipelines.MetaPipeline(trees=2).fit(bars)
    known = p.predict(bars).orderBy("symbol", "ts").collect()
    assert len(made) == 1 and written == [] and known
    assert p.predict(bars.select("*")).orderBy("symbol", "ts").collect() == known and len(made) == 2


def test_learners_write_their_rows_once_and_boosting_passes_over_few_tasks(two, monkeypatch):
    written, dealt, real = written_by(monkeypatch, learning), [], learners.spread
    monkeypatch.setattr(learners, "spread", lambda df, *a: (dealt.append(a[:2]), real(df, *a))[1])
    found = learners.Learners.train(two[0], forest={"numTrees": 2}, boosting={"maxIter": 1})
    assert written == [] and dealt == [(10_000, 96), (50_000, 24), (10_000, 96)] and found.errors.count() == 6


def test_values_of_nine_places_are_shortened_as_in_sql(spark):
    values = [-2.0177685, 2.0177685, 1.0000005, -0.0000015, 0.1234565, 316.2277665, 3.25, float("nan"), float("inf"), None]
    got = [r["v"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", window_queries.shortened("x").alias("v")).orderBy("i").collect()]
    assert repr(got) == repr([duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchall()[0][0] for v in values]) and got[0] == -2.017768


def test_contributions_score_rows_once(spark, thrice):
    count, seen = counted(spark)
    stack = learning.Stack.train([learning.forest(["a", "b"], trees=5, leaf=1), learning.logistic(["a", "b"])], thrice[0])
    got = {r["model"]: r for r in learning.contributions(stack, thrice[0].withColumn("a", count("a"))).collect()}
    assert seen.value == 300 and sorted(got) == ["base_0", "base_1", "stack"]
    for i, m in enumerate(stack.bases):
        want = learning.confusion(learning.scored(m, thrice[0])).first()
        assert all(np.isclose(got[f"base_{i}"][c], want[c]) for c in ("n", "accuracy", "f1", "log_loss"))


def test_stack_writes_its_rows_once(thrice, monkeypatch):
    written = written_by(monkeypatch, learning)
    learning.Stack.train([learning.forest(["a", "b"], trees=2, leaf=1), learning.logistic(["a", "b"])], thrice[0])
    assert written == [("stack", 300), ("probabilities", 300)]
