"""Section 2.5: window functions over one ordered series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import series as s
from ..operators import rolling
from ..operators import windows as op
from .book import Book, rounded

book = Book()

#: Frames of the SQL side.
W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def over(n: int, end: str = "CURRENT ROW") -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND {end})"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {agg}({x}) {over(n)} END"


LAG = "lag({x}) OVER (PARTITION BY symbol ORDER BY ts)"
RET = f"price / nullif({LAG.format(x='price')}, 0) - 1"


@book.add("W1_sma", "ticks", f"SELECT symbol, ts, round({full('avg', 'price', 20)}, 6) AS sma_20, round({full('avg', 'price', 50)}, 6) AS sma_50 FROM ticks")
def _(df):
    return rounded(df, "symbol", "ts", sma_20=s.mean("price", 20), sma_50=s.mean("price", 50))


@book.add(
    "W2_bollinger_zscore", "ticks",
    f"SELECT symbol, ts, round(m - 2 * d, 6) AS lower_band, round(m + 2 * d, 6) AS upper_band, round((price - m) / nullif(d, 0), 6) AS z, round((price - m) / nullif(price, 0), 6) AS dist"
    f" FROM (SELECT *, {full('avg', 'price', 20)} AS m, {full('stddev_samp', 'price', 20)} AS d FROM ticks)",
)
def _(df):
    m, d = s.mean("price", 20), s.std("price", 20)
    return rounded(df, "symbol", "ts", lower_band=m - 2 * d, upper_band=m + 2 * d, z=s.zscore("price", 20), dist=F.try_divide(F.col("price") - m, F.col("price")))


RETS = f"r AS (SELECT *, {RET} AS ret, ln(price / nullif({LAG.format(x='price')}, 0)) AS lr, price - {LAG.format(x='price')} AS d FROM ticks)"


@book.add("W3_realised_vol", "ticks", f"SELECT symbol, ts, round({full('stddev_samp', 'lr', 20)} * sqrt(252.0), 6) AS vol FROM r", RETS)
def _(df):
    df = df.withColumn("lr", s.log_ret("price"))
    return rounded(df, "symbol", "ts", vol=s.std("lr", 20) * F.sqrt(F.lit(252.0)))


@book.add("W4_vol_ratio", "ticks", f"SELECT symbol, ts, round(v / nullif({full('avg', 'v', 50)}, 0), 6) AS vol_ratio FROM v", RETS + f", v AS (SELECT *, {full('stddev_samp', 'lr', 20)} AS v FROM r)")
def _(df):
    df = df.withColumn("lr", s.log_ret("price")).withColumn("v", s.std("lr", 20))
    return rounded(df, "symbol", "ts", vol_ratio=F.try_divide(F.col("v"), s.mean("v", 50)))


@book.add("W5_lag_lead", "ticks", f"SELECT symbol, ts, lag(price, 3) OVER w AS lag_3, lead(price) OVER w AS next_price FROM ticks {W}")
def _(df):
    return df.select("symbol", "ts", s.lag("price", 3).alias("lag_3"), s.lead("price").alias("next_price"))


@book.add(
    "W6_cumulative", "ticks",
    f"SELECT symbol, ts, round(sum(size) OVER w, 6) AS cum_size, max(price) OVER w AS cum_max, round(exp(sum(ln(1 + least(greatest(ret, -0.5), 0.5))) OVER w), 4) AS growth FROM r {W}", RETS,
)
def _(df):
    df = df.withColumn("ret", s.ret("price"))
    growth = F.exp(s.cumsum(F.ln(1 + F.least(F.greatest("ret", F.lit(-0.5)), F.lit(0.5)))))
    return df.select("symbol", "ts", F.round(s.cumsum("size"), 6).alias("cum_size"), s.cummax("price").alias("cum_max"), F.round(F.when(F.col("ret").isNotNull() | growth.isNotNull(), growth), 4).alias("growth"))


@book.add("W7_drawdown", "ticks", f"SELECT symbol, ts, round((price - max(price) OVER w) / nullif(max(price) OVER w, 0), 6) AS drawdown FROM ticks {W}")
def _(df):
    top = s.cummax("price")
    return rounded(df, "symbol", "ts", drawdown=F.try_divide(F.col("price") - top, top))


@book.add(
    "W8_forward_fill", "ticks",
    f"SELECT symbol, ts, CAST(coalesce(last_value(nullif(sig, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS held"
    " FROM (SELECT *, CASE WHEN size > 90 THEN 1 WHEN size < 5 THEN -1 ELSE 0 END AS sig FROM ticks)",
)
def _(df):
    df = df.withColumn("sig", F.when(F.col("size") > 90, 1).when(F.col("size") < 5, -1).otherwise(0))
    return df.select("symbol", "ts", s.hold(F.col("sig")).cast("int").alias("held"))


@book.add(
    "W9_parkinson", "brand",
    f"SELECT symbol, ts, round(sqrt({full('avg', 'x', 20)}), 6) AS of_mean, round({full('avg', 'sqrt(x)', 20)}, 6) AS mean_of FROM (SELECT *, power(ln(high / nullif(low, 0)), 2) / (4 * ln(2)) AS x FROM brand)",
)
def _(df):
    return rounded(df, "symbol", "ts", of_mean=op.parkinson_of_mean(), mean_of=op.parkinson_mean_of())


@book.add(
    "W10_roll_spread", "ticks",
    f"SELECT symbol, ts, round(2 * sqrt(greatest(-CASE WHEN count(d) {over(20)} = 20 THEN covar_samp(d, e) {over(19)} END, 0)), 6) AS roll_spread FROM (SELECT *, {LAG.format(x='d')} AS e FROM r)", RETS,
)
def _(df):
    return rounded(op.roll_spread(df, "price"), "symbol", "ts", roll_spread="roll_spread")


@book.add(
    "W11_kyle_lambda", "ticks",
    "SELECT symbol, ts, round(CASE WHEN i > 20 AND count(sv) OVER f >= 5 THEN abs(regr_slope(ret, sv) OVER f) END, 6) AS kyle_lambda FROM"
    " (SELECT *, sign(ret) * size AS sv, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM r) WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)", RETS,
)
def _(df):
    return rounded(op.kyle_lambda(df, "price", "size"), "symbol", "ts", kyle_lambda="kyle_lambda")


@book.add("W12_amihud_lambda", "ticks", f"SELECT symbol, ts, round({full('avg', 'x', 20)}, 6) AS amihud_lambda FROM (SELECT *, abs(ret) / nullif(price * size, 0) AS x FROM r)", RETS)
def _(df):
    return rounded(op.amihud_lambda(df, "price", "size"), "symbol", "ts", amihud_lambda="amihud_lambda")


@book.add(
    "W13_autocorrelation", "ticks",
    "SELECT symbol, ts, " + ", ".join(f"round(CASE WHEN count(lr) {over(50)} = 50 THEN corr(lr, l{k}) {over(50 - k)} END, 6) AS autocorr_{k}" for k in (1, 5, 10))
    + " FROM (SELECT *, " + ", ".join(f"lag(lr, {k}) OVER (PARTITION BY symbol ORDER BY ts) AS l{k}" for k in (1, 5, 10)) + " FROM r)", RETS,
)
def _(df):
    return rounded(op.autocorrelation(df, "price"), "symbol", "ts", **{f"autocorr_{k}": f"autocorr_{k}" for k in (1, 5, 10)})


@book.add(
    "W14_rsi", "ticks",
    f"SELECT symbol, ts, round(100 - 100 / (1 + {full('avg', 'u', 14)} / nullif({full('avg', 'n', 14)}, 0)), 6) AS rsi FROM (SELECT *, greatest(coalesce(d, 0), 0) AS u, greatest(-coalesce(d, 0), 0) AS n FROM r)", RETS,
)
def _(df):
    return rounded(df.withColumn("d", s.change("price")), "symbol", "ts", rsi=s.rsi("d"))


@book.add("W15_volume_ratio", "ticks", f"SELECT symbol, ts, round(size / nullif({full('avg', 'size', 20)}, 0), 6) AS volume_ratio, round(price * size, 6) AS dollar_volume FROM ticks")
def _(df):
    return rounded(df, "symbol", "ts", volume_ratio=F.try_divide(F.col("size"), s.mean("size", 20)), dollar_volume=F.col("price") * F.col("size"))


PAIR = "p AS (SELECT 'pair' AS symbol, a.ts, a.close AS s1, b.close AS s2 FROM brand a JOIN brand b USING (ts) WHERE a.symbol = 'Brand#11' AND b.symbol = 'Brand#12')"


@book.add(
    "W16_pair_zscore", "brand",
    "SELECT symbol, ts, round(ratio, 6) AS ratio, round(z, 6) AS z, CAST(coalesce(last_value(CASE WHEN round(z, 9) > 2 THEN -1 WHEN round(z, 9) < -2 THEN 1 WHEN abs(round(z, 9)) < 0.5 THEN 0 END IGNORE NULLS)"
    " OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS signal"
    f" FROM (SELECT *, (ratio - {full('avg', 'ratio', 20)}) / nullif({full('stddev_samp', 'ratio', 20)}, 0) AS z FROM (SELECT *, s1 / nullif(s2, 0) AS ratio FROM p))", PAIR,
)
def _(df):
    a, b = (df.where(F.col("symbol") == x).select("ts", F.col("close").alias(c)) for x, c in (("Brand#11", "s1"), ("Brand#12", "s2")))
    return rounded(op.pair_zscore(a.join(b, "ts").withColumn("symbol", F.lit("pair"))), "symbol", "ts", "signal", ratio="ratio", z="z")


def _scan_sql(y: str, guard: str) -> str:
    parts = []
    for h in (5, 10, 20, 40, 60):
        f = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)"
        parts.append(f"regr_slope({y}, i) {f} AS b{h}, regr_r2({y}, i) {f} AS r{h}, coalesce(lead(ts, {h}) OVER (PARTITION BY symbol ORDER BY ts), max(ts) OVER (PARTITION BY symbol)) AS e{h}")
    rows = " UNION ALL ".join(
        f"SELECT symbol, ts, i, n, {h} AS horizon, e{h} AS t1, round(sign(b{h}) * sqrt(r{h} * {h - 2} / nullif(1 - r{h}, 0)), 9) AS tval FROM f WHERE r{h} IS NOT NULL AND {guard.format(h=h)}" for h in (5, 10, 20, 40, 60)
    )
    return (
        f"b AS (SELECT *, ln(price) AS lnp, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ticks), f AS (SELECT *, {', '.join(parts)} FROM b),"
        f" c AS ({rows}), best AS (SELECT * FROM c WHERE tval IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY abs(tval) DESC, horizon) = 1)"
    )


def shortened(x: str):
    """A value that is rounded to 9 places, rounded to 6 as SQL does it, by its product with a million: such values often end in a 5, and Spark's round would take the decimal digits."""
    return F.round(F.col(x) * 1e6) / 1e6


@book.add("W17_trend_scan", "ticks", "SELECT symbol, ts, t1, round(tval, 6) AS tval, CAST(sign(tval) AS INTEGER) AS label, horizon FROM best WHERE i >= 10 AND i < n - 60", _scan_sql("lnp", "TRUE"))
def _(df):
    return op.trend_scan(df, "price").withColumn("tval", shortened("tval"))


@book.add(
    "W18_trend_scan_fit", "ticks",
    "SELECT b.symbol, b.ts, round(CASE WHEN b.i >= 60 THEN coalesce(tval, 0) END, 6) AS tval, CAST(sign(CASE WHEN b.i >= 60 THEN coalesce(tval, 0) END) AS INTEGER) AS label, CASE WHEN b.i >= 60 THEN coalesce(horizon, 5) END AS horizon"
    " FROM b LEFT JOIN best USING (symbol, ts)", _scan_sql("price", "r{h} >= 0.5 AND i + {h} < n"),
)
def _(df):
    return op.trend_scan_fit(df, "price").withColumn("tval", shortened("tval"))


def _ffd_weights(d: float, n: int) -> list[float]:
    w = [1.0]
    for k in range(1, n):
        w.append(-w[-1] * (d - k + 1) / k)
    return w


@book.add("W21_truncated_frac_diff", "ticks", "SELECT symbol, ts, round(" + " + ".join(f"({w!r} * lag(price, {k}) OVER w)" for k, w in enumerate(_ffd_weights(0.4, 20))) + f", 6) AS frac_diff FROM ticks {W}")
def _(df):
    x = sum((F.lit(w) * s.lag("price", k) for k, w in enumerate(_ffd_weights(0.4, 20)) if k), F.col("price"))
    return rounded(df, "symbol", "ts", frac_diff=x)


FEATURES = (
    [f"round(lag(ret, {k}) OVER w, 6) AS ret_lag_{k}" for k in (1, 2, 3, 5, 10, 20)] + [f"round({full('stddev_samp', 'ret', n)}, 6) AS vol_{n}" for n in (5, 10, 20, 60)]
    + [f"round({full('avg', 'ret', n)}, 6) AS mean_ret_{n}" for n in (5, 10, 20)] + [f"round(price / nullif({full('avg', 'price', n)}, 0) - 1, 6) AS dist_ma_{n}" for n in (20, 50)]
    + [f"round(price / nullif(lag(price, {n}) OVER w, 0) - 1, 6) AS mom_{n}" for n in (20, 60)]
    + [f"round((price - {full('avg', 'price', 20)}) / nullif({full('stddev_samp', 'price', 20)}, 0), 6) AS z_20"]
    + [f"round(100 - 100 / (1 + {full('avg', 'greatest(coalesce(d, 0), 0)', 14)} / nullif({full('avg', 'greatest(-coalesce(d, 0), 0)', 14)}, 0)), 6) AS rsi_14"]
)


@book.add("W22_forecast_features", "ticks", f"SELECT symbol, ts, round(lr, 6) AS log_ret, {', '.join(FEATURES)} FROM r {W}", RETS)
def _(df):
    out = op.forecast_features(df, "price").drop("price", "size")
    return rounded(out, "symbol", "ts", **{c: c for c in out.columns if c not in ("symbol", "ts")})


@book.add(
    "W23_indicator_pack", "brand",
    f"SELECT symbol, ts, round(100 * (close - {full('min', 'low', 14)}) / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0), 6) AS stoch_k, round({full('avg', 'tr', 14)}, 6) AS atr_sma,"
    f" round(sum(sign(coalesce(close - pc, 0)) * volume) OVER w, 6) AS obv FROM (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, {LAG.format(x='close')} AS pc FROM brand)) {W}",
)
def _(df):
    df = op.obv(op.true_range(df))
    return rounded(df, "symbol", "ts", stoch_k=op.stochastic(), atr_sma=s.mean("true_range", 14), obv="obv")


@book.add(
    "W24_chart_overlay", "daily",
    f"SELECT symbol, ts, round(close, 2) AS close, round({full('avg', 'close', 20)}, 2) AS sma_20, round({full('avg', 'close', 50)}, 2) AS sma_50 FROM (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 80)",
)
def _(df):
    return op.chart_overlay(df)


@book.add(
    "U6_rolling_function", "user_ticks",
    "SELECT symbol, ts, round(CASE WHEN len(xs) = 20 THEN list_median(list_transform(xs, lambda v: abs(v - m))) END, 6) AS mad FROM"
    " (SELECT *, list_median(xs) AS m FROM (SELECT symbol, ts, list(price) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS xs FROM user_ticks))",
)
def _(df):
    mad = lambda w: np.median(np.abs(w - np.median(w, 1, keepdims=True)), 1)
    return rounded(rolling.rolling_apply(df, "price", 20, mad, "mad"), "symbol", "ts", mad="mad")
