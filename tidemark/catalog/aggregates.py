"""Section 2.4: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series as s
from ..operators import bars, metrics
from .book import Book, rounded

book = Book()
VALUE = "v AS (SELECT *, price * size AS pv, sum(price * size) OVER (PARTITION BY symbol ORDER BY ts) AS cv FROM ticks)"


@book.add(
    "A1_dollar_bars", "ticks",
    "SELECT symbol, CAST(floor(cv / 20000.0) AS BIGINT) AS bar_id, max(ts) AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, round(sum(size), 4) AS volume, round(sum(pv), 4) AS dollar_volume"
    " FROM v GROUP BY 1, 2", VALUE,
)
def _(df):
    return rounded(bars.dollar_bars(df, 20_000.0), "symbol", "bar_id", "ts", "open", "high", "low", "close", digits=4, volume="volume", dollar_volume="dollar_volume")


@book.add(
    "A2_vpin", "ticks",
    "SELECT d.symbol, d.ts, bucket, round(vpin, 6) AS vpin FROM d JOIN (SELECT symbol, bucket, CASE WHEN count(*) OVER w = 10 THEN sum(imb) OVER w / nullif(sum(total) OVER w, 0) END AS vpin FROM"
    " (SELECT symbol, bucket, abs(coalesce(sum(size) FILTER (ch > 0), 0) - coalesce(sum(size) FILTER (ch < 0), 0)) AS imb, sum(size) AS total FROM d GROUP BY 1, 2)"
    " WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) USING (symbol, bucket)",
    "d AS (SELECT *, price - lag(price) OVER w AS ch, CAST(floor(sum(size) OVER w / 500) AS BIGINT) AS bucket FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts))",
)
def _(df):
    return rounded(bars.vpin(df, 500, 10), "symbol", "ts", "bucket", vpin="vpin")


@book.add("A3_time_bars", "ticks", "SELECT symbol, time_bucket(INTERVAL 60 MINUTE, ts) AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(size) AS volume FROM ticks GROUP BY 1, 2")
def _(df):
    return bars.time_bars(df, "60 minutes")


@book.add("A4_most_active", "ticks", "SELECT symbol, count(*) AS n FROM ticks GROUP BY 1 ORDER BY n DESC, symbol LIMIT 1")
def _(df):
    return bars.most_active(df)


LABELS = "l AS (SELECT symbol, CAST(sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts)) AS INTEGER) AS label, CAST(size AS INTEGER) AS bars_until_hit, price / 100 AS ret FROM ticks)"


@book.add(
    "A5_label_statistics", "ticks",
    "SELECT symbol, count(*) AS n, count(*) FILTER (label = 1) AS n_up, count(*) FILTER (label = -1) AS n_down, count(*) FILTER (label = 0) AS n_flat, round(avg(CAST(label = 1 AS INTEGER)), 6) AS up_share, round(avg(CAST(label = -1 AS INTEGER)), 6) AS down_share,"
    " round(avg(bars_until_hit), 6) AS mean_bars, quantile_cont(bars_until_hit, 0.5) AS median_bars, round(avg(ret), 6) AS mean_ret, round(stddev_samp(ret), 6) AS std_ret FROM l GROUP BY 1", LABELS,
)
def _(df):
    labels = df.select("symbol", F.signum(s.change("price")).cast("int").alias("label"), F.col("size").cast("int").alias("bars_until_hit"), (F.col("price") / 100).alias("ret"))
    out = metrics.label_statistics(labels)
    return rounded(out, "symbol", "n", "n_up", "n_down", "n_flat", "median_bars", **{c: c for c in ("up_share", "down_share", "mean_bars", "mean_ret", "std_ret")})


EQUITY = (
    "q AS (SELECT symbol, ts, coalesce(equity / nullif(lag(equity) OVER w, 0) - 1, 0) AS ret, equity, (equity - max(equity) OVER w) / nullif(max(equity) OVER w, 0) AS dd FROM (SELECT symbol, ts, 1000 + price AS equity FROM ticks) WINDOW w AS (PARTITION BY symbol ORDER BY ts)),"
    " runs AS (SELECT symbol, max(n) AS longest FROM (SELECT symbol, run, sum(CAST(dd < 0 AS INTEGER)) AS n FROM (SELECT symbol, dd, sum(chg) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM"
    " (SELECT *, coalesce(CAST((dd < 0) <> lag(dd < 0) OVER (PARTITION BY symbol ORDER BY ts) AS INTEGER), 1) AS chg FROM q)) GROUP BY 1, 2) GROUP BY 1),"
    " m AS (SELECT symbol, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS tr, count(*) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd, CASE WHEN count(*) FILTER (ret < 0) > 1 THEN stddev_samp(ret) FILTER (ret < 0) ELSE 1e-10 END AS dn, min(dd) AS mdd, quantile_cont(ret, 0.05) AS v FROM q GROUP BY 1)"
)


@book.add(
    "A6_equity_metrics", "ticks",
    "SELECT m.symbol, round(tr, 6) AS total_return, round(power(1 + tr, 252.0 / n) - 1, 6) AS annual_return, round(mu / nullif(sd, 0) * sqrt(252.0), 6) AS sharpe, round(mu / dn * sqrt(252.0), 6) AS sortino,"
    " round((power(1 + tr, 252.0 / n) - 1) / nullif(abs(mdd), 0), 6) AS calmar, round(mdd, 6) AS max_drawdown, CAST(longest AS BIGINT) AS max_drawdown_bars, round(sd * sqrt(252.0), 6) AS annual_vol, round(v, 6) AS var_95, n AS n_bars FROM m JOIN runs USING (symbol)", EQUITY,
)
def _(df):
    out = metrics.equity_metrics(df.select("symbol", "ts", (1000 + F.col("price")).alias("equity")))
    return rounded(out, "symbol", "max_drawdown_bars", "n_bars", **{c: c for c in out.columns if c not in ("symbol", "max_drawdown_bars", "n_bars")})


@book.add("A7_longest_run", "ticks", "SELECT symbol, CAST(longest AS BIGINT) AS longest FROM runs", EQUITY)
def _(df):
    df = df.withColumn("e", 1000 + F.col("price"))
    return metrics.longest_run(df.withColumn("dd", F.col("e") - s.cummax("e")), F.col("dd") < 0)


TRADES = "t AS (SELECT symbol, round(price - 50, 6) AS pnl, size AS bars_held, 0.001 * price AS cost FROM ticks)"


@book.add(
    "A8_trade_metrics", "ticks",
    "SELECT symbol, count(*) AS n_trades, round(100 * avg(CAST(pnl > 0 AS INTEGER)), 6) AS win_rate, round(sum(pnl) FILTER (pnl > 0) / nullif(abs(sum(pnl) FILTER (pnl < 0)), 0), 6) AS profit_factor, round(avg(pnl) FILTER (pnl > 0), 6) AS avg_win,"
    " round(avg(pnl) FILTER (pnl < 0), 6) AS avg_loss, round(avg(bars_held), 6) AS avg_bars, round(sum(cost), 6) AS total_cost FROM t GROUP BY 1", TRADES,
)
def _(df):
    out = metrics.trade_metrics(df.select("symbol", F.round(F.col("price") - 50, 6).alias("pnl"), F.col("size").alias("bars_held"), (0.001 * F.col("price")).alias("cost")))
    return rounded(out, "symbol", "n_trades", **{c: c for c in out.columns if c not in ("symbol", "n_trades")})


@book.add("A9_sharpe", "ticks", "SELECT symbol, round(coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0), 0), 6) AS sharpe, round(coalesce((avg(r) - 0.02 / 252) / nullif(stddev_samp(r), 0) * sqrt(252.0), 0), 6) AS sharpe_rf FROM (SELECT symbol, price / 100 - 0.5 AS r FROM ticks) GROUP BY 1")
def _(df):
    r = F.col("price") / 100 - 0.5
    return rounded(df.groupBy("symbol").agg(metrics.sharpe(r).alias("a"), metrics.sharpe(r, risk_free=0.02).alias("b")), "symbol", sharpe="a", sharpe_rf="b")


@book.add("A10_signal_summary", "ticks", "SELECT symbol, count(*) FILTER (size >= 75) AS n_buy, count(*) FILTER (size < 25) AS n_sell, round(avg(size / 100), 6) AS mean_confidence, arg_max(size, ts) AS last_size FROM ticks GROUP BY 1")
def _(df):
    return df.groupBy("symbol").agg(F.count_if(F.col("size") >= 75).alias("n_buy"), F.count_if(F.col("size") < 25).alias("n_sell"), F.round(F.avg(F.col("size") / 100), 6).alias("mean_confidence"), F.max_by("size", "ts").alias("last_size"))


FAN = (0.05, 0.25, 0.5, 0.75, 0.95)


@book.add("A11_percentile_fan", "ticks", "SELECT CAST(size AS INTEGER) AS step, " + ", ".join(f"round(quantile_cont(price, {q}), 6) AS p{int(q * 100)}" for q in FAN) + ", round(avg(CAST(price > 50 AS INTEGER)), 6) AS p_gain FROM ticks GROUP BY 1")
def _(df):
    return df.groupBy(F.col("size").cast("int").alias("step")).agg(*[F.round(F.percentile("price", F.lit(q)), 6).alias(f"p{int(q * 100)}") for q in FAN], F.round(F.avg((F.col("price") > 50).cast("double")), 6).alias("p_gain"))


@book.add("A12_target_probability", "ticks", "SELECT symbol, target, round(avg(CAST(price >= target AS INTEGER)), 6) AS p FROM ticks, (SELECT unnest([10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 80.0])::DOUBLE AS target) GROUP BY 1, 2")
def _(df):
    targets = df.sparkSession.createDataFrame([(float(x),) for x in (10, 20, 30, 40, 50, 60, 80)], "target double")
    return df.crossJoin(F.broadcast(targets)).groupBy("symbol", "target").agg(F.round(F.avg((F.col("price") >= F.col("target")).cast("double")), 6).alias("p"))


@book.add("A13_ensemble_mean", "ticks", "SELECT CAST(size AS INTEGER) AS step, round(sum(price / w) / sum(1 / w), 6) AS yhat FROM (SELECT *, CASE symbol WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 ELSE 0.5 END AS w FROM ticks) GROUP BY 1")
def _(df):
    w = 1 / F.when(F.col("symbol") == "view", 1.0).when(F.col("symbol") == "click", 2.0).otherwise(0.5)
    return df.groupBy(F.col("size").cast("int").alias("step")).agg(F.round(F.sum(F.col("price") * w) / F.sum(w), 6).alias("yhat"))


@book.add(
    "A14_moments", "ticks",
    "SELECT symbol, count(*) AS n, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS sd, round(avg(power((price - m) / s, 3)), 6) AS skew, round(avg(power((price - m) / s, 4)) - 3, 6) AS excess_kurtosis, min(price) AS lo, max(price) AS hi"
    " FROM (SELECT *, avg(price) OVER (PARTITION BY symbol) AS m, stddev_pop(price) OVER (PARTITION BY symbol) AS s FROM ticks) GROUP BY 1",
)
def _(df):
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("price"), 6).alias("mean"), F.round(F.stddev_samp("price"), 6).alias("sd"), F.round(F.skewness("price"), 6).alias("skew"), F.round(F.kurtosis("price"), 6).alias("excess_kurtosis"),
        F.min("price").alias("lo"), F.max("price").alias("hi"),
    )


GRID = "g AS (SELECT symbol, CAST(floor(size / 25) AS INTEGER) AS p1, CAST(extract(hour FROM ts) / 6 AS INTEGER) AS p2, round(avg(price), 6) AS score FROM ticks GROUP BY 1, 2, 3)"


def grid(df):
    return df.groupBy("symbol", F.floor(F.col("size") / 25).cast("int").alias("p1"), F.round(F.hour("ts") / 6).cast("int").alias("p2")).agg(F.round(F.avg("price"), 6).alias("score"))


@book.add("A15_best_of_grid", "ticks", "SELECT symbol, p1, p2, score FROM g QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY score DESC, p1, p2) = 1", GRID.replace("CAST(extract(hour FROM ts) / 6 AS INTEGER)", "CAST(round(extract(hour FROM ts) / 6.0) AS INTEGER)"))
def _(df):
    best = grid(df).groupBy("symbol").agg(F.max_by(F.struct("p1", "p2", "score"), F.struct("score", -F.col("p1"), -F.col("p2"))).alias("b"))
    return best.select("symbol", "b.p1", "b.p2", "b.score")


@book.add("A16_pivot_grid", "ticks", "SELECT symbol, p1, " + ", ".join(f"coalesce(max(score) FILTER (p2 = {k}), 0) AS p2_{k}" for k in range(5)) + " FROM g GROUP BY 1, 2", GRID.replace("CAST(extract(hour FROM ts) / 6 AS INTEGER)", "CAST(round(extract(hour FROM ts) / 6.0) AS INTEGER)"))
def _(df):
    wide = grid(df).groupBy("symbol", "p1").pivot("p2", list(range(5))).agg(F.first("score")).na.fill(0.0)
    return wide.select("symbol", "p1", *[F.col(str(k)).alias(f"p2_{k}") for k in range(5)])
