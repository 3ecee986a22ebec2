"""Section 2.10: statistical tests and risk."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import econometrics as ec
from ..functions import series as s
from ..operators import risk
from .book import Book, phi_sql, rounded

book = Book()
RET = "r AS (SELECT symbol, ts, (100 + price) / lag(100 + price) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret, 100 + price AS close FROM ticks)"
Z = ec.PHI.inv_cdf(0.05)
DENSITY = math.exp(-Z * Z / 2) / math.sqrt(2 * math.pi)


def rets(df):
    df = df.select("symbol", "ts", (100 + F.col("price")).alias("close"))
    return df.withColumn("ret", s.ret("close"))


@book.add("Q1_adf", "ticks")
def _(df):
    return risk.adf_test(rets(df), "close")


LAGS = range(2, 20)


@book.add(
    "Q2_hurst", "ticks",
    "SELECT symbol, round(regr_slope(lv, lk) / 2, 6) AS hurst FROM (" + " UNION ALL ".join(f"SELECT symbol, ln({k}) AS lk, ln(var_pop(d)) AS lv FROM (SELECT symbol, close - lag(close, {k}) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM r) GROUP BY 1" for k in LAGS) + ") GROUP BY 1", RET,
)
def _(df):
    return rounded(risk.hurst(rets(df)), "symbol", hurst="hurst")


@book.add("Q3_volatility", "ticks", "SELECT symbol, round(stddev_samp(ret) * sqrt(252.0), 6) AS volatility FROM r GROUP BY 1", RET)
def _(df):
    return rounded(risk.volatility(rets(df)), "symbol", volatility="volatility")


MOMENTS = ", m AS (SELECT symbol, count(ret) AS n, avg(power((ret - mu) / sd, 3)) AS g, avg(power((ret - mu) / sd, 4)) - 3 AS k, any_value(mu) AS mu, any_value(sd) AS sd FROM (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS mu, stddev_pop(ret) OVER (PARTITION BY symbol) AS sd FROM r) GROUP BY 1)"


@book.add(
    "Q4_fat_tails", "ticks",
    "SELECT symbol, n, round(g, 6) AS skewness, round(k, 6) AS excess_kurtosis, round(n / 6.0 * (g * g + k * k / 4), 4) AS jb_stat, CASE WHEN k > 3 THEN 'very fat' WHEN k > 1 THEN 'fat' WHEN k > 0 THEN 'slightly fat' ELSE 'normal or thin' END AS tail_class FROM m", RET + MOMENTS,
)
def _(df):
    out = risk.fat_tails(rets(df))
    return out.select("symbol", "n", F.round("skewness", 6).alias("skewness"), F.round("excess_kurtosis", 6).alias("excess_kurtosis"), F.round("jb_stat", 4).alias("jb_stat"), "tail_class")


KS = (
    ", z AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ret, ts) AS i, count(*) OVER (PARTITION BY symbol) AS n, (ret - avg(ret) OVER (PARTITION BY symbol)) / stddev_pop(ret) OVER (PARTITION BY symbol) AS z FROM r WHERE ret IS NOT NULL),"
    f" f AS (SELECT symbol, i, n, {phi_sql('z')} AS f FROM z), d AS (SELECT symbol, max(greatest(i / n - f, f - (i - 1) / n)) AS d, any_value(n) AS n FROM f GROUP BY 1)"
)


@book.add(
    "Q4_ks_normal", "ticks",
    "SELECT symbol, round(d, 6) AS ks_stat, round(least(greatest(2 * list_sum(list_transform(range(1, 20), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * t * t))), 0), 1), 6) AS ks_p FROM (SELECT symbol, d, sqrt(n) * d AS t FROM d)",
    RET + KS,
)
def _(df):
    return rounded(risk.ks_normal(rets(df)), "symbol", ks_stat="ks_stat", ks_p="ks_p")


@book.add("Q5_var_parametric", "ticks", f"SELECT symbol, 'parametric' AS method, round(-(avg(ret) + {Z!r} * stddev_samp(ret)), 6) AS var, round(-(avg(ret) - stddev_samp(ret) * {DENSITY / 0.05!r}), 6) AS cvar FROM r GROUP BY 1", RET)
def _(df):
    return rounded(risk.var_parametric(rets(df)), "symbol", "method", var="var", cvar="cvar")


CF = f"-(mu + ({Z!r} + ({Z * Z - 1!r}) * g / 6 + ({Z**3 - 3 * Z!r}) * k / 24 - ({2 * Z**3 - 5 * Z!r}) * g * g / 36) * sd)"


@book.add("Q6_var_cornish_fisher", "ticks", f"SELECT symbol, 'cornish_fisher' AS method, round({CF}, 6) AS var FROM m", RET + MOMENTS)
def _(df):
    return rounded(risk.var_cornish_fisher(rets(df)), "symbol", "method", var="var")


HIST = "SELECT symbol, 'historical' AS method, round(-max(cut), 6) AS var, round(-avg(ret) FILTER (ret <= cut), 6) AS cvar FROM r JOIN (SELECT symbol, quantile_cont(ret, 0.05) AS cut FROM r GROUP BY 1) USING (symbol) GROUP BY 1"


@book.add("Q7_var_historical", "ticks", HIST, RET)
def _(df):
    return rounded(risk.var_historical(rets(df)), "symbol", "method", var="var", cvar="cvar")


@book.add("Q8_var_bootstrap", "ticks")
def _(df):
    return risk.var_bootstrap(rets(df))


@book.add(
    "Q9_var_all", "ticks",
    f"SELECT symbol, 'parametric' AS method, round(-(avg(ret) + {Z!r} * stddev_samp(ret)), 6) AS var FROM r GROUP BY 1 UNION ALL SELECT symbol, 'cornish_fisher', round({CF}, 6) FROM m UNION ALL SELECT symbol, method, var FROM ({HIST})", RET + MOMENTS,
)
def _(df):
    return rounded(risk.var_all(rets(df)), "symbol", "method", var="var")


@book.add("F13_garch", "ticks")
def _(df):
    return risk.garch_fit(rets(df))


@book.add("Q10_garch_var", "ticks")
def _(df):
    return risk.garch_var(rets(df))


@book.add("Q11_series_structure", "ticks")
def _(df):
    return risk.series_structure(rets(df))


@book.add("Q12_minimum_d", "ticks")
def _(df):
    return risk.minimum_d(rets(df))


@book.add("Q13_optimal_d", "ticks")
def _(df):
    return risk.minimum_d(rets(df), log=True, least=50, max_lag=12, min_corr=0.5)


@book.add("Q14_memory_kept", "ticks", "SELECT symbol, round(corr(close, d), 6) AS correlation FROM (SELECT symbol, close, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM r) WHERE d IS NOT NULL GROUP BY 1", RET)
def _(df):
    return rounded(risk.memory_kept(rets(df), 1.0), "symbol", correlation="correlation")


@book.add("Q15_sadf", "user_ticks")
def _(df):
    return rounded(risk.sadf(df.select("symbol", "ts", (100 + F.col("price")).alias("close")), least=20), "symbol", "ts", sadf="sadf")


@book.add("Q17_feature_bundle", "ticks")
def _(df):
    from ..operators import bars, folds

    b = bars.dollar_bars(df, 20_000.0)
    b = folds.frac_diff(b, 0.6, "close", out="ffd").withColumn("ret", s.ret("close"))
    return rounded(b, "symbol", "ts", "bar_id", ffd="ffd", vol=s.std("ret", 20))


PAIRS = "p AS (SELECT a.ts, a.close AS s1, b.close AS s2 FROM brand a JOIN brand b USING (ts) WHERE a.symbol = 'Brand#11' AND b.symbol = 'Brand#12')"


@book.add("G8_engle_granger", "brand", "SELECT 'pair' AS symbol, round(regr_slope(s1, s2), 6) AS beta, round(regr_intercept(s1, s2), 4) AS alpha, round(corr(s1, s2), 6) AS correlation FROM p", PAIRS)
def _(df):
    a, b = (df.where(F.col("symbol") == x).select("ts", F.col("close").alias(c)) for x, c in (("Brand#11", "s1"), ("Brand#12", "s2")))
    out = risk.engle_granger(a.join(b, "ts").withColumn("symbol", F.lit("pair")))
    return out.select("symbol", F.round("beta", 6).alias("beta"), F.round("alpha", 4).alias("alpha"), F.round("correlation", 6).alias("correlation"))


@book.add("G8_cointegration_test", "brand")
def _(df):
    a, b = (df.where(F.col("symbol") == x).select("ts", F.col("close").alias(c)) for x, c in (("Brand#11", "s1"), ("Brand#12", "s2")))
    return risk.engle_granger(a.join(b, "ts").withColumn("symbol", F.lit("pair")))
