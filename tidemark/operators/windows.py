"""Window operators over series (volatility, spreads, liquidity, trend scanning, indicators)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import series as s

PARKINSON = 1 / (4 * math.log(2))


def parkinson_of_mean(n: int = 20) -> Column:
    """Square root of the mean of k ln(high/low)^2."""
    x = F.pow(F.ln(F.try_divide(F.col("high"), F.col("low"))), 2)
    return F.sqrt(PARKINSON * s.mean(x, n))


def parkinson_mean_of(n: int = 20) -> Column:
    """Mean of the square roots of k ln(high/low)^2."""
    return s.mean(F.sqrt(PARKINSON * F.pow(F.ln(F.try_divide(F.col("high"), F.col("low"))), 2)), n)


def roll_spread(df: DataFrame, price: str = "close", n: int = 20) -> DataFrame:
    """Add ``roll_spread``, 2 sqrt(-cov) of successive changes in a window of n changes; 0 where these do not revert."""
    df = df.withColumn("__d", s.change(price)).withColumn("__e", s.lag("__d"))
    cov = F.when(F.count("__d").over(s.rows(1 - n)) == n, F.covar_samp("__d", "__e").over(s.rows(2 - n)))
    return df.withColumn("roll_spread", 2 * F.sqrt(F.greatest(-cov, F.lit(0.0)))).drop("__d", "__e")


def kyle_lambda(df: DataFrame, price: str = "close", volume: str = "volume", n: int = 20) -> DataFrame:
    """Add ``kyle_lambda``: absolute slope of returns on signed volume over the n rows before; at least 5 pairs and varying volume."""
    df = df.withColumn("__r", s.ret(price)).withColumn("__v", F.signum("__r") * F.col(volume)).withColumn("__i", s.position())
    w = s.rows(-n, -1)
    both = F.when(F.col("__r").isNotNull() & F.col("__v").isNotNull(), F.lit(1))
    slope = F.when((F.col("__i") >= n) & (F.count(both).over(w) >= 5), F.abs(F.regr_slope("__r", "__v").over(w)))
    return df.withColumn("kyle_lambda", slope).drop("__r", "__v", "__i")


def amihud_lambda(df: DataFrame, price: str = "close", volume: str = "volume", n: int = 20) -> DataFrame:
    """Add ``amihud_lambda``: mean of absolute return per traded value."""
    df = df.withColumn("__x", F.try_divide(F.abs(s.ret(price)), F.col(price) * F.col(volume)))
    return df.withColumn("amihud_lambda", s.mean("__x", n)).drop("__x")


def autocorrelation(df: DataFrame, price: str = "close", lags: tuple[int, ...] = (1, 5, 10), n: int = 50) -> DataFrame:
    """Add ``autocorr_k``: correlation of returns with those k rows before, in windows of n returns."""
    df = df.withColumn("__r", s.log_ret(price))
    for k in lags:
        df = df.withColumn("__k", s.lag("__r", k))
        df = df.withColumn(f"autocorr_{k}", F.when(F.count("__r").over(s.rows(1 - n)) == n, F.corr("__r", "__k").over(s.rows(k + 1 - n)))).drop("__k")
    return df.drop("__r")


def _scans(df: DataFrame, y: str, horizons: tuple[int, ...]) -> DataFrame:
    """Add ``__t{h}`` and ``__r2_{h}``, t value and R2 of the slope of y over the h rows from each on; null where fewer follow.

    The rows ahead are taken once, as offsets, and the sums of a longer horizon go on from those of a shorter one; y counts from its own row, so nothing cancels.
    """
    ahead = {f"__y{k}": F.lead(y, k).over(s.by()) - F.col(y) for k in range(1, max(horizons))}
    df = df.withColumns(ahead)
    sums, first, columns = (F.lit(0.0), F.lit(0.0), F.lit(0.0)), 1, {}
    for h in sorted(horizons):
        step = [F.col(f"__y{k}") for k in range(first, h)]
        k_of = range(first, h)
        parts = (sum(step, F.lit(0.0)), sum((k * c for k, c in zip(k_of, step, strict=True)), F.lit(0.0)), sum((c * c for c in step), F.lit(0.0)))
        df = df.withColumns({f"__{n}{h}": total + part for n, total, part in zip("abc", sums, parts, strict=True)})
        sums, first = tuple(F.col(f"__{n}{h}") for n in "abc"), h
        sxx, sxy, syy = h * (h * h - 1) / 12, sums[1] - sums[0] * ((h - 1) / 2), sums[2] - sums[0] * sums[0] / h
        r2 = F.when(syy > 0, sxy * sxy / (sxx * syy))
        columns[f"__r2_{h}"] = r2
        columns[f"__t{h}"] = F.round(F.signum(sxy) * F.sqrt(F.try_divide(r2 * (h - 2), 1 - r2)), 9)
    return df.withColumns(columns).drop(*ahead, *[f"__{n}{h}" for n in "abc" for h in horizons])


def trend_scan(df: DataFrame, price: str = "close", horizons: tuple[int, ...] = (5, 10, 20, 40, 60), first: int = 10) -> DataFrame:
    """Trend labels: of the slopes of ln price over [i, i+h) the one with the largest absolute t value. Rows from ``first`` on that have the longest horizon ahead; ``ts``, ``t1``, ``tval``, ``label``, ``horizon``."""
    df = df.withColumn("__y", s.ln(price)).withColumn("__i", s.position()).withColumn("__n", F.count(F.lit(1)).over(s.whole()))
    df = _scans(df.withColumns({f"__e{h}": F.coalesce(F.lead("ts", h).over(s.by()), F.max("ts").over(s.whole())) for h in horizons}), "__y", horizons)
    found = [F.struct(F.abs(f"__t{h}").alias("size"), F.lit(-h).alias("order"), F.col(f"__t{h}").alias("tval"), F.lit(h).alias("horizon"), F.col(f"__e{h}").alias("t1")) for h in horizons]
    df = df.where((F.col("__i") >= first) & (F.col("__i") < F.col("__n") - max(horizons)))
    best = F.slice(F.reverse(F.array_sort(F.filter(F.array(*found), lambda x: x["size"].isNotNull()))), 1, 1)
    df = df.select("symbol", "ts", F.explode(best).alias("best"))  # a condition on the best would repeat all sums in the filter
    label = F.when(F.isnan("best.tval"), 0).otherwise(F.signum("best.tval").cast("int"))  # a window with a price of 0 has no slope
    return df.select("symbol", "ts", "best.t1", "best.tval", label.alias("label"), "best.horizon")


def trend_scan_fit(df: DataFrame, price: str = "close", horizons: tuple[int, ...] = (5, 10, 20, 40, 60), min_r2: float = 0.5) -> DataFrame:
    """Trend labels on raw prices, only from slopes with at least ``min_r2``; all rows stay, null before the longest horizon, 0 where no slope qualifies."""
    df = _scans(df.withColumn("__i", s.position()).withColumn("__n", F.count(F.lit(1)).over(s.whole())), price, horizons)
    use = lambda h: (F.col(f"__r2_{h}") >= min_r2) & (F.col("__i") + h < F.col("__n"))
    found = [F.when(use(h), F.struct(F.abs(f"__t{h}").alias("size"), F.lit(-h).alias("order"), F.col(f"__t{h}").alias("tval"), F.lit(h).alias("horizon"))) for h in horizons]
    df = df.withColumn("__best", F.array_max(F.filter(F.array(*found), lambda x: x["size"].isNotNull())))
    late = F.col("__i") >= max(horizons)
    pick = lambda c, other: F.when(late, F.coalesce(F.col(f"__best.{c}"), F.lit(other)))
    return df.select("symbol", "ts", pick("tval", 0.0).alias("tval"), F.signum(pick("tval", 0.0)).cast("int").alias("label"), pick("horizon", horizons[0]).cast("int").alias("horizon"))


def pair_zscore(pairs: DataFrame, n: int = 20, enter: float = 2.0, leave: float = 0.5) -> DataFrame:
    """Ratio z-score of two aligned series (symbol, ts, s1, s2) and the position it asks for: -1 above ``enter``, 1 below, 0 inside ``leave``, else the last."""
    df = pairs.withColumn("ratio", F.try_divide(F.col("s1"), F.col("s2"))).withColumn("z", s.zscore("ratio", n))
    ask = F.when(F.col("z") > enter, -1).when(F.col("z") < -enter, 1).when(F.abs("z") < leave, 0)
    return df.withColumn("__a", ask).withColumn("signal", F.coalesce(s.ffill("__a"), F.lit(0)).cast("int")).drop("__a")


def forecast_features(df: DataFrame, price: str = "close") -> DataFrame:
    """Lagged returns, volatilities, mean returns, distances from averages, momentum, RSI and z-score of one price."""
    df = df.withColumn("log_ret", s.log_ret(price)).withColumn("__d", s.change(price)).withColumn("ret", s.ret(price))
    lags = {f"ret_lag_{k}": s.lag("ret", k) for k in (1, 2, 3, 5, 10, 20)}
    vols = {f"vol_{n}": s.std("ret", n) for n in (5, 10, 20, 60)}
    means = {f"mean_ret_{n}": s.mean("ret", n) for n in (5, 10, 20)}
    dist = {f"dist_ma_{n}": F.try_divide(F.col(price), s.mean(price, n)) - 1 for n in (20, 50)}
    mom = {f"mom_{n}": s.ret(price, n) for n in (20, 60)}
    return df.withColumns(lags | vols | means | dist | mom | {"rsi_14": s.rsi("__d"), "z_20": s.zscore(price, 20)}).drop("__d", "ret")


def obv(df: DataFrame, price: str = "close", volume: str = "volume") -> DataFrame:
    """On-balance volume."""
    return df.withColumn("__s", F.signum(F.coalesce(s.change(price), F.lit(0.0))) * F.col(volume)).withColumn("obv", s.cumsum("__s")).drop("__s")


def stochastic(n: int = 14) -> Column:
    low, high = s.rolling(F.min, "low", n), s.rolling(F.max, "high", n)
    return 100 * F.try_divide(F.col("close") - low, high - low)


def true_range(df: DataFrame) -> DataFrame:
    before = s.lag("close")
    return df.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def chart_overlay(df: DataFrame, last: int = 80) -> DataFrame:
    """The last rows of each series with averages taken within them, rounded to 2."""
    back = F.row_number().over(s.whole().orderBy(F.desc("ts")))
    df = df.withColumn("__r", back).where(F.col("__r") <= last)
    return df.select("symbol", "ts", F.round("close", 2).alias("close"), F.round(s.mean("close", 20), 2).alias("sma_20"), F.round(s.mean("close", 50), 2).alias("sma_50"))
