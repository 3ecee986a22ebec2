"""Section 2.6: order-dependent folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import econometrics as ec
from ..functions import series as s
from ..operators import backtest, folds
from .book import Book, rounded
from .windows import _scan_sql as scan_sql

book = Book()
N = "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM user_ticks)"
ALPHA = 2 / 13


@book.add(
    "F1_ewm_mean", "user_ticks",
    "SELECT symbol, ts, round(y, 6) AS ewm FROM f",
    "RECURSIVE_MARK" + N + f", f AS (SELECT symbol, ts, i, price AS y FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.ts, n.i, {ALPHA!r} * n.price + (1 - {ALPHA!r}) * f.y FROM f JOIN n ON n.symbol = f.symbol AND n.i = f.i + 1)",
)
def _(df):
    return rounded(folds.ewm_mean(df, "price", 12, adjust=False, out="ewm"), "symbol", "ts", ewm="ewm")


@book.add(
    "F1_ewm_std", "user_ticks",
    "SELECT symbol, ts, round(sqrt(greatest(wxx / w - power(wx / w, 2), 0) * w * w / nullif(w * w - w2, 0)), 4) AS ewm FROM (SELECT a.symbol, a.ts, sum(power(1 - 2.0 / 21, a.i - b.i)) AS w, sum(power(1 - 2.0 / 21, 2 * (a.i - b.i))) AS w2,"
    " sum(power(1 - 2.0 / 21, a.i - b.i) * b.price) AS wx, sum(power(1 - 2.0 / 21, a.i - b.i) * b.price * b.price) AS wxx FROM n a JOIN n b ON a.symbol = b.symbol AND b.i <= a.i GROUP BY 1, 2) ", N,
)
def _(df):
    return rounded(folds.ewm_std(df, "price", 20, out="ewm"), "symbol", "ts", digits=4, ewm="ewm")


def ewm(y, first="symbol, ts"):
    return f"SELECT {first}, round({y}, 6) AS ewm FROM (SELECT a.symbol, a.ts, a.i, sum(power(1 - 2.0 / 15, a.i - b.i)) AS w, sum(power(1 - 2.0 / 15, a.i - b.i) * b.price) AS wx FROM n a JOIN n b ON a.symbol = b.symbol AND b.i <= a.i GROUP BY 1, 2, 3)"


@book.add("W25_ewm_adjusted", "user_ticks", ewm("CASE WHEN i >= 14 THEN wx / w END"), N)
def _(df):
    return rounded(folds.ewm_mean(df, "price", 14, out="ewm", least=14), "symbol", "ts", ewm="ewm")


@book.add(
    "W26_macd_line", "user_ticks", "SELECT symbol, ts, round(q - l, 6) AS macd FROM f",
    "RECURSIVE_MARK" + N + ", f AS (SELECT symbol, ts, i, price AS q, price AS l FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.ts, n.i, 2.0::DOUBLE / 13 * n.price + (1 - 2.0::DOUBLE / 13) * f.q, 2.0::DOUBLE / 27 * n.price + (1 - 2.0::DOUBLE / 27) * f.l FROM f JOIN n ON n.symbol = f.symbol AND n.i = f.i + 1)",
)
def _(df):
    both = folds.ewm_mean(folds.ewm_mean(df, "price", 12, adjust=False, out="quick"), "price", 26, adjust=False, out="slow")
    return both.select("symbol", "ts", F.round(F.col("quick") - F.col("slow"), 6).alias("macd"))


#: A shock's weight falls by this factor a row.
FALL = repr(1 - 2 / 21)


@book.add(
    "W27_ewm_volatility", "ticks",
    "SELECT symbol, ts, round(CASE WHEN m >= 2 THEN sqrt(greatest(wxx / w - power(wx / w, 2), 0) * w * w / nullif(w * w - w2, 0)) END, 6) AS vol FROM f",
    "RECURSIVE_MARKv AS (SELECT symbol, ts, row_number() OVER w AS i, (100 + price) / lag(100 + price) OVER w - 1 AS r FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts)),"
    " x AS (SELECT *, coalesce(r - avg(r) OVER (PARTITION BY symbol), 0) AS x, CASE WHEN r IS NULL THEN 0 ELSE 1 END AS one FROM v),"
    f" f AS (SELECT symbol, ts, i, CAST(one AS DOUBLE) AS w, CAST(one AS DOUBLE) AS w2, x AS wx, x * x AS wxx, one AS m FROM x WHERE i = 1 UNION ALL SELECT x.symbol, x.ts, x.i, {FALL} * f.w + one, {FALL} * {FALL} * f.w2 + one,"
    f" {FALL} * f.wx + x.x, {FALL} * f.wxx + x.x * x.x, f.m + one FROM f JOIN x ON x.symbol = f.symbol AND x.i = f.i + 1)",
)
def _(df):
    out = folds.daily_volatility(df.select("symbol", "ts", (100 + F.col("price")).alias("close")))
    return rounded(out, "symbol", "ts", vol="vol")


CUSUM = (
    "RECURSIVE_MARK" + N + ", r AS (SELECT *, coalesce(ln(price) - lag(ln(price)) OVER (PARTITION BY symbol ORDER BY ts), 0) AS x FROM n),"
    " f AS (SELECT symbol, ts, i, CAST(0.0 AS DOUBLE) AS up, CAST(0.0 AS DOUBLE) AS dn, 0 AS event FROM r WHERE i = 1 UNION ALL"
    " SELECT symbol, ts, i, CASE WHEN u > 2.0 THEN 0.0 ELSE u END, CASE WHEN u <= 2.0 AND d < -2.0 THEN 0.0 ELSE d END, CASE WHEN u > 2.0 THEN 1 WHEN d < -2.0 THEN -1 ELSE 0 END FROM"
    " (SELECT r.symbol, r.ts, r.i, greatest(0, f.up + r.x) AS u, least(0, f.dn + r.x) AS d FROM f JOIN r ON r.symbol = f.symbol AND r.i = f.i + 1))"
)


@book.add("F2_cusum_events", "user_ticks", "SELECT symbol, ts FROM f WHERE event <> 0", CUSUM)
def _(df):
    return folds.cusum_events(df, "price", 2.0)


@book.add("F3_cusum_signed", "user_ticks", "SELECT symbol, ts, event FROM f", CUSUM)
def _(df):
    return folds.cusum(df, "price", 2.0).select("symbol", "ts", "event")


WIDE = ec.ffd_weights(0.95)


@book.add("F4_frac_diff", "ticks", "SELECT symbol, ts, round(" + " + ".join(f"({float(w)!r} * lag(price, {k}) OVER w)" for k, w in enumerate(WIDE)) + ", 6) AS frac_diff FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts)")
def _(df):
    return rounded(folds.frac_diff(df, 0.95, "price"), "symbol", "ts", frac_diff="frac_diff")


@book.add(
    "F4_frac_diff_long", "ticks", "SELECT symbol, ts, round(sum(w * x) FILTER (i >= n), 6) AS frac_diff FROM (SELECT a.symbol, a.ts, a.i, l.n, l.w, b.x FROM p a JOIN p b ON a.symbol = b.symbol AND b.i <= a.i JOIN lags l ON l.k = a.i - b.i) GROUP BY 1, 2",
    "RECURSIVE_MARKp AS (SELECT symbol, ts, ln(price) AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM ticks),"
    " wk AS (SELECT 0 AS k, CAST(1 AS DOUBLE) AS w UNION ALL SELECT k + 1, -w * (0.4::DOUBLE - k) / (k + 1) FROM wk WHERE abs(w * (0.4::DOUBLE - k) / (k + 1)) >= 1e-5), lags AS (SELECT k, w, count(*) OVER () AS n FROM wk)",
)
def _(df):
    return rounded(folds.frac_diff(df, 0.4, "price", log=True), "symbol", "ts", frac_diff="frac_diff")


VOL = (
    "v AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, CASE WHEN count(r) OVER f = 20 THEN stddev_samp(r) OVER f END AS vol FROM"
    " (SELECT symbol, ts, 100 + price AS close, (100 + price) / lag(100 + price) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM ticks) WINDOW w AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"
)


def with_vol(df):
    return folds.daily_volatility(df.select("symbol", "ts", (100 + F.col("price")).alias("close")), span=20, method="rolling")


@book.add("F6_barriers", "ticks", "SELECT symbol, ts, round(close + 2 * vol, 6) AS upper_barrier, round(close - vol, 6) AS lower_barrier, coalesce(lead(ts, 20) OVER (PARTITION BY symbol ORDER BY ts), max(ts) OVER (PARTITION BY symbol)) AS t1 FROM v", VOL)
def _(df):
    return rounded(folds.barriers(with_vol(df), bars=20), "symbol", "ts", "t1", upper_barrier="upper_barrier", lower_barrier="lower_barrier")


@book.add(
    "F5_triple_barrier_absolute", "ticks",
    "SELECT symbol, ts, CASE WHEN u <= d AND u <= 20 THEN 1 WHEN d <= 20 THEN -1 ELSE 0 END AS label, CASE WHEN u <= d AND u <= 20 THEN 'upper' WHEN d <= 20 THEN 'lower' ELSE 'vertical' END AS barrier_hit, CAST(least(u, d, 20) AS INTEGER) AS bars_until_hit, close AS entry_price FROM"
    " (SELECT a.symbol, a.ts, a.close, coalesce(min(b.i - a.i) FILTER (b.close >= a.close + 2000 * a.vol), 21) AS u, coalesce(min(b.i - a.i) FILTER (b.close <= a.close - 1000 * a.vol), 21) AS d FROM v a JOIN v b ON a.symbol = b.symbol AND b.i BETWEEN a.i AND a.i + 20 WHERE a.i < a.n - 20 GROUP BY 1, 2, 3)", VOL,
)
def _(df):
    return folds.triple_barrier_absolute(with_vol(df), profit=2000.0, stop=1000.0, bars=20).drop("upper_barrier", "lower_barrier")


@book.add(
    "F7_triple_barrier", "ticks",
    "SELECT symbol, ts, t1, round(vol, 6) AS trgt, CASE WHEN u <= d AND u <= 20 THEN 1 WHEN d <= 20 THEN -1 ELSE 0 END AS label, p.ts_k AS touch_time, round(p.close_k / close - 1, 6) AS ret, close AS entry_price, 1 AS side FROM"
    " (SELECT a.symbol, a.ts, a.i, a.close, a.vol, max(b.ts) AS t1, coalesce(min(b.i - a.i) FILTER (b.close >= a.close * (1 + 2.0 * a.vol)), 21) AS u, coalesce(min(b.i - a.i) FILTER (b.close <= a.close * (1 - 1.0 * a.vol)), 21) AS d"
    " FROM v a JOIN v b ON a.symbol = b.symbol AND b.i BETWEEN a.i AND a.i + 20 WHERE a.i >= 20 AND a.i < a.n - 20 AND a.vol > 0.001 GROUP BY 1, 2, 3, 4, 5) q JOIN (SELECT symbol AS sym, i AS k, ts AS ts_k, close AS close_k FROM v) p ON p.sym = q.symbol AND p.k = q.i + least(u, d, 20)", VOL,
)
def _(df):
    out = folds.triple_barrier(with_vol(df), bars=20)
    return out.withColumns({"trgt": F.round("trgt", 6), "ret": F.round("ret", 6)})


RANGED = (
    "v AS (SELECT *, sqrt(CASE WHEN count(x) OVER f = 20 THEN avg(x) OVER f END) AS vol FROM (SELECT symbol, ts, 100 + price AS close, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, power(ln((101 + price) / (99 + price)), 2) / (4 * ln(2)) AS x FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
    " WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),"
    " t3 AS (SELECT a.symbol, coalesce(min(b.i - a.i) FILTER (b.close >= a.close * (1 + 2.0 * a.vol)), 21) AS u, coalesce(min(b.i - a.i) FILTER (b.close <= a.close * (1 - 1.0 * a.vol)), 21) AS d FROM v a JOIN v b ON a.symbol = b.symbol AND b.i BETWEEN a.i AND a.i + 20"
    " WHERE a.i >= 20 AND a.i < a.n - 20 AND a.vol > 0.001 GROUP BY a.symbol, a.ts), "
)


@book.add(
    "F8_labels_by_method", "ticks",
    "SELECT 'triple_barrier' AS method, symbol, CASE WHEN u <= d AND u <= 20 THEN 1 WHEN d <= 20 THEN -1 ELSE 0 END AS label, count(*) AS n FROM t3 GROUP BY 1, 2, 3"
    " UNION ALL SELECT 'trend_scanning', symbol, CAST(sign(tval) AS INTEGER), count(*) FROM best WHERE i >= 10 AND i < n - 60 GROUP BY 1, 2, 3",
    RANGED + scan_sql("lnp", "TRUE").replace("ln(price) AS lnp", "ln(100 + price) AS lnp"),
)
def _(df):
    bars = df.select("symbol", "ts", (100 + F.col("price")).alias("close"), (101 + F.col("price")).alias("high"), (99 + F.col("price")).alias("low"))
    kinds = [folds.labels(bars, m, **o).select(F.lit(m).alias("method"), "symbol", "label") for m, o in (("triple_barrier", {"bars": 20}), ("trend_scanning", {}))]
    return kinds[0].unionByName(kinds[1]).groupBy("method", "symbol", "label").agg(F.count(F.lit(1)).alias("n"))


RETURNS = "r AS (SELECT symbol, ts, row_number() OVER w AS i, list(price / p - 1) OVER (w ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS rs FROM (SELECT *, nullif(lag(price) OVER (PARTITION BY symbol ORDER BY ts), 0) AS p FROM user_ticks) WINDOW w AS (PARTITION BY symbol ORDER BY ts))"


@book.add(
    "W19_shannon_entropy", "user_ticks",
    "SELECT symbol, ts, CASE WHEN n IS NOT NULL THEN round(abs(-list_sum(list_transform(counts, lambda c: CASE WHEN c > 0 THEN c / n * log2(c / n) ELSE 0 END))), 6) END AS shannon_entropy FROM c",
    RETURNS + ", x AS (SELECT symbol, ts, i, list_filter(rs, lambda v: v IS NOT NULL) AS xs FROM r), b AS (SELECT symbol, ts, CASE WHEN i > 50 AND len(xs) >= 25 THEN xs END AS xs, list_min(xs) AS lo, list_max(xs) AS hi FROM x),"
    " k AS (SELECT symbol, ts, len(xs) AS n, list_transform(xs, lambda v: CASE WHEN hi > lo THEN len(list_filter(range(1, 10), lambda b: v >= lo + b * ((hi - lo) / 10))) ELSE 0 END) AS ks FROM b),"
    " c AS (SELECT symbol, ts, n, list_transform(range(10), lambda b: len(list_filter(ks, lambda v: v = b))) AS counts FROM k)",
)
def _(df):
    return rounded(folds.shannon_entropy(df, "price"), "symbol", "ts", shannon_entropy="shannon_entropy")


@book.add(
    "W20_lempel_ziv", "user_ticks",
    "SELECT symbol, ts, CASE WHEN n IS NOT NULL THEN round(phrases / (n / log2(n + 1)), 6) END AS lempel_ziv FROM (SELECT symbol, ts, n, list_reduce(list_transform(range(1, n + 1), lambda z: {'at': z, 'phrases': CAST(0 AS BIGINT)}), lambda a, j: CASE WHEN contains(substr(bits, 1, a.at - 1), substr(bits, a.at, j.at - a.at + 1)) THEN a ELSE {'at': j.at + 1, 'phrases': a.phrases + 1} END, {'at': CAST(1 AS BIGINT), 'phrases': CAST(1 AS BIGINT)}).phrases AS phrases FROM s)",
    RETURNS + ", x AS (SELECT symbol, ts, i, list_filter(rs, lambda v: v IS NOT NULL) AS xs FROM r), b AS (SELECT symbol, ts, CASE WHEN i > 50 AND len(xs) >= 25 THEN xs END AS xs FROM x),"
    " e AS (SELECT symbol, ts, xs, list_distinct(list_aggregate(xs, 'quantile_cont', [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS edges FROM b),"
    " c AS (SELECT symbol, ts, list_transform(xs, lambda v: greatest(len(list_filter(edges, lambda q: q < v)) - 1, 0)) AS codes FROM e),"
    " s AS (SELECT symbol, ts, len(codes) AS n, array_to_string(list_transform(codes, lambda k: CASE WHEN k > m THEN '1' ELSE '0' END), '') AS bits FROM (SELECT *, list_median(codes) AS m FROM c))",
)
def _(df):
    return rounded(folds.lempel_ziv_complexity(df, "price"), "symbol", "ts", lempel_ziv="lempel_ziv")


def _signals(df):
    df = df.select("symbol", "ts", (100 + F.col("price")).alias("price"), F.when(F.col("size") > 60, 1).when(F.col("size") < 30, -1).otherwise(0).alias("signal"))
    return df


@book.add("F9_backtest_trades", "ticks")
def _(df):
    return backtest.trades(_signals(df), backtest.Config(max_bars=30))


@book.add("F9_backtest_equity", "ticks")
def _(df):
    return rounded(backtest.equity(_signals(df), backtest.Config(max_bars=30)), "symbol", "ts", equity="equity", ret="ret", drawdown="drawdown")


@book.add("F11_quick_backtest", "ticks")
def _(df):
    out = backtest.quick(_signals(df), backtest.Config(max_bars=30))
    return rounded(out, "symbol", "n_bars", "n_trades", **{c: c for c in ("total_return", "sharpe", "max_drawdown", "win_rate", "profit_factor", "total_cost")})


def trend_rule(train, test):
    """Long after a rising training window, short after a falling one."""
    return np.full(len(test), np.sign(train["price"].iloc[-1] - train["price"].iloc[0]))


@book.add("F10_walk_forward", "ticks")
def _(df):
    c = backtest.Config(train=200, test=50)
    return backtest.walk_forward(df.select("symbol", "ts", (100 + F.col("price")).alias("price")), trend_rule, c)


@book.add("F12_sequential_bootstrap", "user_ticks")
def _(df):
    spans = df.withColumn("i", s.position()).withColumn("t1", F.lead("ts", 6).over(s.by())).where("t1 IS NOT NULL").select("symbol", F.col("i").cast("long").alias("label_id"), F.col("i").alias("i0"), (F.col("i") + 6).alias("i1"))
    return folds.sequential_bootstrap(spans, replicates=2)
