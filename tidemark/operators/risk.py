"""Statistical tests and risk measures of return and price series, one row per symbol."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import econometrics as ec
from ..functions import series as s
from ..sources.market import materialise
from .folds import frac_diff
from .regression import adf_rows, adf_test, choose_and_test, most_lags, sadf  # noqa: F401  a test of this module
from .running import places


def hurst(df: DataFrame, x: str = "close", max_lag: int = 20) -> DataFrame:
    """``symbol, hurst``: half the slope of ln variance of k-step changes on ln k, k = 2 to max_lag - 1; 0.5 for series of fewer than max_lag + 10 values."""
    lags = range(2, max_lag)
    df = df.withColumns({f"__d{k}": F.col(x) - s.lag(x, k) for k in lags})
    wide = df.groupBy("symbol").agg(F.count(x).alias("n"), *[F.var_pop(f"__d{k}").alias(f"v{k}") for k in lags])
    long = wide.select("symbol", "n", F.explode(F.array(*[F.struct(F.lit(math.log(k)).alias("lk"), F.ln(f"v{k}").alias("lv")) for k in lags])).alias("p"))
    return long.groupBy("symbol").agg(F.when(F.max("n") >= max_lag + 10, F.coalesce(F.regr_slope("p.lv", "p.lk") / 2, F.lit(0.5))).otherwise(0.5).alias("hurst"))


def volatility(df: DataFrame, ret: str = "ret", periods: int = 252) -> DataFrame:
    return df.groupBy("symbol").agg((F.stddev_samp(ret) * math.sqrt(periods)).alias("volatility"))


def fat_tails(df: DataFrame, ret: str = "ret") -> DataFrame:
    """``symbol, n, skewness, excess_kurtosis, jb_stat, jb_p, tail_class``; moments are population ones, p is the chi-squared tail with 2 degrees."""
    m = df.groupBy("symbol").agg(F.count(ret).alias("n"), F.skewness(ret).alias("skewness"), F.kurtosis(ret).alias("excess_kurtosis"))
    k = F.col("excess_kurtosis")
    m = m.withColumn("jb_stat", F.col("n") / 6 * (F.pow("skewness", F.lit(2)) + F.pow(k, F.lit(2)) / 4)).withColumn("jb_p", F.exp(-F.col("jb_stat") / 2))
    return m.withColumn("tail_class", F.when(k > 3, "very fat").when(k > 1, "fat").when(k > 0, "slightly fat").otherwise("normal or thin"))


def phi(z: Column) -> Column:
    """Standard normal distribution function (Abramowitz and Stegun 7.1.26; error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def ks_normal(df: DataFrame, ret: str = "ret") -> DataFrame:
    """``symbol, ks_stat, ks_p``: distance to the fitted normal; p by Kolmogorov's series."""
    df = df.where(F.col(ret).isNotNull()).select("symbol", F.col(ret).alias("__r"))
    m = df.groupBy("symbol").agg(F.count("__r").alias("__n"), F.avg("__r").alias("__mu"), F.stddev_pop("__r").alias("__sd"))
    df = places(df, "__p", ["__r"]).join(m, "symbol").withColumn("__i", F.col("__p") + 1).withColumn("__f", phi(F.try_divide(F.col("__r") - F.col("__mu"), F.col("__sd"))))
    d = df.groupBy("symbol").agg(F.max(F.greatest(F.col("__i") / F.col("__n") - F.col("__f"), F.col("__f") - (F.col("__i") - 1) / F.col("__n"))).alias("ks_stat"), F.max("__n").alias("n"))
    t = F.col("ks_stat") * F.sqrt("n")
    series = sum(((-1) ** (k - 1) * F.exp(-2 * k * k * t * t) for k in range(1, 20)), F.lit(0.0))
    return d.select("symbol", "ks_stat", F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)).alias("ks_p"))


def var_parametric(df: DataFrame, ret: str = "ret", confidence: float = 0.95, days: int = 1) -> DataFrame:
    z = ec.PHI.inv_cdf(1 - confidence)
    density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    m = df.groupBy("symbol").agg(F.avg(ret).alias("mu"), F.stddev_samp(ret).alias("sd"))
    mu, sd = F.col("mu") * days, F.col("sd") * math.sqrt(days)
    return m.select("symbol", F.lit("parametric").alias("method"), (-(mu + z * sd)).alias("var"), (-(mu - sd * density / (1 - confidence))).alias("cvar"))


def var_cornish_fisher(df: DataFrame, ret: str = "ret", confidence: float = 0.95) -> DataFrame:
    z = ec.PHI.inv_cdf(1 - confidence)
    m = df.groupBy("symbol").agg(F.avg(ret).alias("mu"), F.stddev_pop(ret).alias("sd"), F.skewness(ret).alias("g"), F.kurtosis(ret).alias("k"))
    g, k = F.col("g"), F.col("k")
    zc = z + (z * z - 1) * g / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * g * g / 36
    return m.select("symbol", F.lit("cornish_fisher").alias("method"), (-(F.col("mu") + zc * F.col("sd"))).alias("var"), F.lit(None).cast("double").alias("cvar"))


def var_historical(df: DataFrame, ret: str = "ret", confidence: float = 0.95) -> DataFrame:
    cut = df.groupBy("symbol").agg(F.percentile(ret, F.lit(1 - confidence)).alias("cut"))
    both = df.join(cut, "symbol")
    return both.groupBy("symbol").agg(F.lit("historical").alias("method"), (-F.max("cut")).alias("var"), (-F.avg(F.when(F.col(ret) <= F.col("cut"), F.col(ret)))).alias("cvar"))


def resampled_ranks(rng: np.random.Generator, n: int, at: float, block: int = 1 << 18) -> tuple[int, int]:
    """Of a resample of n places 0 .. n - 1, the two order statistics next to ``at`` (0 to n - 1), drawn a block at a time; only places near them are kept."""
    lo, width = math.floor(at), 8 * math.sqrt(n) + 8
    low, high, below, near = at - width, at + width, 0, []
    kind = np.int32 if n < 1 << 31 else np.int64  # the same draws, in half the room
    state = rng.bit_generator.state
    for a in range(0, n, block):
        x = rng.integers(0, n, min(block, n - a), dtype=kind)
        under = x < high
        x = x[under]
        x = x[x >= low]
        below += int(np.count_nonzero(under)) - len(x)
        near.append(x)
    found = np.concatenate(near)
    first, second = lo - below, min(lo + 1, n - 1) - below
    if 0 <= first and second < len(found):
        ranked = np.partition(found, [first, second])
        return int(ranked[first]), int(ranked[second])
    rng.bit_generator.state = state  # more than eight deviations away
    ranked = np.sort(rng.integers(0, n, n))
    return int(ranked[lo]), int(ranked[min(lo + 1, n - 1)])


def var_bootstrap(df: DataFrame, ret: str = "ret", confidence: float = 0.95, draws: int = 10_000, seed: int = 42, per_task: int = 1_000) -> DataFrame:
    """``symbol, method, var, lo, hi``: mean and 95 % interval of the quantile over resamples; a task takes ``per_task`` of a symbol's resamples.

    A resample of sorted returns is one of their places, so tasks draw places, for which they need the number of returns only, and find the places that the quantile lies between. The returns themselves
    are ranked once and meet these places in a join.
    """
    known = df.where(F.col(ret).isNotNull()).select("symbol", F.col(ret).cast("double").alias("r"))
    chunks = -(-draws // per_task)
    tasks = known.groupBy("symbol").agg(F.count("r").alias("n")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    tasks = tasks.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, 200), "symbol", "chunk")

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, rng = row["n"], np.random.default_rng([seed, row["chunk"]])
                count, at = min(per_task, draws - row["chunk"] * per_task), (1 - confidence) * (n - 1)
                pairs = np.array([resampled_ranks(rng, n, at) for _ in range(count)], dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([row["symbol"]] * count, pa.string()), pa.array([row["chunk"]] * count, pa.int32()), pa.array(np.arange(count), pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(count, at - math.floor(at)))], names=["symbol", "chunk", "k", "first", "second", "share"])

    ranks = materialise(tasks.mapInArrow(resample, "symbol string, chunk int, k int, first long, second long, share double"), "resamples")
    asked = ranks.select("symbol", F.explode(F.array("first", "second")).alias("place")).distinct()
    values = materialise(places(known, "place", ["r"]).join(asked, ["symbol", "place"]).select("symbol", "place", "r"), "quantiles")
    side = lambda c: values.select("symbol", F.col("place").alias(c), F.col("r").alias(f"r_{c}"))
    both = ranks.join(side("first"), ["symbol", "first"]).join(side("second"), ["symbol", "second"])
    a, b, t = F.col("r_first"), F.col("r_second"), F.col("share")
    each = both.select("symbol", (-F.when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t)).alias("v"))  # as numpy interpolates
    return each.groupBy("symbol").agg(F.lit("bootstrap").alias("method"), F.avg("v").alias("var"), F.percentile("v", F.lit(0.025)).alias("lo"), F.percentile("v", F.lit(0.975)).alias("hi"))


def var_all(df: DataFrame, ret: str = "ret", confidence: float = 0.95) -> DataFrame:
    """The closed-form methods in one table. Write it before grouping it by symbol again: Spark 4.1 takes this union for one partitioned table, also where its parts were coalesced differently."""
    return var_parametric(df, ret, confidence).unionByName(var_cornish_fisher(df, ret, confidence)).unionByName(var_historical(df, ret, confidence))


GARCH = "symbol string, mu double, omega double, alpha double, beta double, persistence double, nu double, aic double, bic double, long_run_vol double, current_vol double"


def garch_fit(df: DataFrame, ret: str = "ret", student: bool = True) -> DataFrame:
    """GARCH(1,1) per symbol; series under 30 returns give nulls."""

    names = [f.split()[0] for f in GARCH.split(", ")[1:]]

    def one(key: tuple, table: pa.Table) -> pa.Table:
        r = table.select(["ts", ret]).sort_by("ts")[ret].to_numpy().astype(float)
        r, f = r[~np.isnan(r)], {}
        if len(r) >= 30 and r.std() > 0:
            f = ec.garch(r, student)
            f["current_vol"] = f["vol"][-1]
        return pa.table({"symbol": pa.array([key[0].as_py()], pa.string()), **{k: pa.array([f.get(k)], pa.float64(), from_pandas=True) for k in names}})

    return df.select("symbol", "ts", ret).groupBy("symbol").applyInArrow(one, GARCH)


def garch_var(df: DataFrame, ret: str = "ret", confidence: float = 0.95) -> DataFrame:
    """One-step VaR from the conditional deviation and a t quantile whose degrees of freedom come from the sample kurtosis."""
    fits = garch_fit(df, ret).select("symbol", "current_vol")
    m = df.groupBy("symbol").agg(F.avg(ret).alias("mu"), F.kurtosis(ret).alias("k"))

    @F.pandas_udf("double")
    def quantile(k: pd.Series) -> pd.Series:
        nu = np.where(k > 0, np.maximum(4, 6 / k.where(k > 0, 1) + 4), 30.0)
        return pd.Series([ec.t_quantile(1 - confidence, float(v)) for v in nu])

    return fits.join(m, "symbol").select("symbol", (-(F.col("mu") + quantile("k") * F.col("current_vol"))).alias("var"), "current_vol")


def differences_tested(df: DataFrame, grid: list[float], max_lag: int | None = None, chunk: int = 50_000) -> DataFrame:
    """``symbol, d, n, p_value, correlation`` of (symbol, ts, x): per order of differencing, the number of differences, their ADF test and their correlation with x (null up to 10).

    The series is numbered and written once. A task takes a chunk with the rows that the widest weights reach back to, and makes the differences of all orders in memory: first their moments and their last
    values, which the chunks after need, then the products of the test. Differences are neither written nor shuffled.
    """
    weights = {d: ec.ffd_weights(d) for d in dict.fromkeys(grid)}
    back = max(map(len, weights.values())) - 1
    size = max(chunk, back, 1)
    placed = materialise(places(df.where("symbol is not null"), "i").select("symbol", "i", F.col("x").cast("double").alias("x")), "placed")
    most = most_lags((placed.agg(F.max("i")).first()[0] or 0) + 1, max_lag) + 1
    home = F.floor(F.col("i") / size)
    spread = placed.withColumn("home", home).withColumn("chunk", F.explode(F.when(F.col("i") % size >= size - back, F.array(home, home + 1)).otherwise(F.array(home)) if back else F.array(home)))

    def differences(table: pa.Table) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """By order, the differences of the chunk's own rows that are there, and these rows' values."""
        table = table.sort_by("i")
        x = table["x"].to_numpy().astype(float)
        halo, gaps = int((table["home"].to_numpy() < table["chunk"].to_numpy()).sum()), np.concatenate([[0], np.cumsum(np.isnan(x))])
        for d, w in weights.items():
            first = max(halo, len(w) - 1)
            if first >= len(x):
                yield d, np.zeros(0), np.zeros(0)
                continue
            full = gaps[first + 1 :] == gaps[first + 1 - len(w) : len(gaps) - len(w)]
            with np.errstate(invalid="ignore"):
                y = np.convolve(x[first - len(w) + 1 :], w, "valid")
            yield d, y[full], x[first:][full]

    def measure(table: pa.Table) -> pa.Table:
        out = []
        for d, y, x in differences(table):
            z = y[~np.isnan(y)]
            if len(y):
                with np.errstate(invalid="ignore"):
                    mx, my = x.mean(), y.mean()
                    m = [len(y), mx, my, ((x - mx) ** 2).sum(), ((y - my) ** 2).sum(), ((x - mx) * (y - my)).sum()]
                out.append((d, m, len(z), z.mean() if len(z) else 0.0, z.min(initial=np.inf), z.max(initial=-np.inf), z[:most], z[-most:]))
        kinds = (pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)]
        n = len(out)
        return pa.table([pa.array([table["symbol"][0].as_py()] * n, pa.string()), pa.array([table["chunk"][0].as_py()] * n, pa.int64()), *columns], names=["symbol", "chunk", "d", "m", "n", "mean", "lo", "hi", "head", "tail"])

    measured = spread.groupBy("symbol", "chunk").applyInArrow(measure, "symbol string, chunk long, d double, m array<double>, n long, mean double, lo double, hi double, head array<double>, tail array<double>")

    def chain(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        """What each chunk needs of the whole series of differences, and of the chunks before."""
        g = g.sort_values("chunk", ignore_index=True)
        c, n = np.stack(g["m"]), g["n"].to_numpy()
        rows = c[:, 0].sum()
        with np.errstate(all="ignore"):
            mx, my = (c[:, 0] @ c[:, 1]) / rows, (c[:, 0] @ c[:, 2]) / rows
            xx, yy, xy = (c[:, 3] + c[:, 0] * (c[:, 1] - mx) ** 2).sum(), (c[:, 4] + c[:, 0] * (c[:, 2] - my) ** 2).sum(), (c[:, 5] + c[:, 0] * (c[:, 1] - mx) * (c[:, 2] - my)).sum()
            correlation = xy / np.sqrt(xx * yy) if rows > 10 else np.nan
        total, lags = int(n.sum()), most_lags(int(n.sum()), max_lag)
        usable = total >= 10 and g["hi"].max() > g["lo"].min()
        before, head, earlier = [], np.zeros(0), np.zeros(0)
        for first, last in zip(g["head"], g["tail"], strict=True):
            before.append(earlier)
            head = np.concatenate([head, first])[: lags + 1] if len(head) <= lags else head
            earlier = np.concatenate([earlier, last])[-lags - 1 :]
        k = len(g)
        return pd.DataFrame({
            "symbol": [key[0]] * k, "chunk": g["chunk"], "d": [key[1]] * k, "rows": [int(rows)] * k, "correlation": [float(correlation)] * k, "usable": [bool(usable)] * k, "mean": [float(n @ g["mean"].to_numpy()) / total if total else 0.0] * k,
            "lags": [lags] * k, "before": before, "head": [head if not i else np.zeros(0) for i in range(k)], "start": [not i for i in range(k)],
        })

    chained = materialise(measured.groupBy("symbol", "d").applyInPandas(chain, "symbol string, chunk long, d double, rows long, correlation double, usable boolean, mean double, lags int, before array<double>, head array<double>, start boolean"), "chunks")

    def products(table: pa.Table, needs: pa.Table) -> pa.Table:
        known, out = {row["d"]: row for row in needs.to_pylist()}, []
        for d, y, _ in differences(table) if table.num_rows and known else ():
            row = known.get(d)
            if row is None:
                continue
            lags = row["lags"]
            z = np.concatenate([np.array(row["before"], float), y[~np.isnan(y)]]) - row["mean"]
            m, rows = np.zeros((lags + 3, lags + 3)), max(len(z) - 1 - lags, 0)
            for a in range(0, rows, 8_192):
                w = adf_rows(z[a : min(a + 8_192, rows) + lags + 1], lags)
                m += w.T @ w
            out.append((row["symbol"], d, rows, m[np.triu_indices(lags + 3)], np.array(row["head"], float) - row["mean"]))
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["symbol", "d", "rows", "m", "head"])

    parts = spread.groupBy("symbol", "chunk").cogroup(chained.where("usable").select("symbol", "chunk", "d", "mean", "lags", "before", "head").groupBy("symbol", "chunk")).applyInArrow(products, "symbol string, d double, rows long, m array<double>, head array<double>")

    def finish(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        flat, rows = np.sum(np.stack(g["m"]), 0), int(g["rows"].sum())
        size = (math.isqrt(8 * len(flat) + 1) - 1) // 2
        m = np.zeros((size, size))
        m[np.triu_indices(size)] = flat
        m = m + np.triu(m, 1).T
        p = choose_and_test(m, rows, np.asarray(max(g["head"], key=len), float))[1]
        return pd.DataFrame({"symbol": [key[0]], "d": [key[1]], "p_value": [p]})

    tested = parts.groupBy("symbol", "d").applyInPandas(finish, "symbol string, d double, p_value double")
    return chained.where("start").join(tested, ["symbol", "d"], "left").select("symbol", "d", F.col("rows").alias("n"), F.coalesce("p_value", F.lit(1.0)).alias("p_value"), F.nanvl("correlation", F.lit(None).cast("double")).alias("correlation"))


def minimum_d(df: DataFrame, x: str = "close", grid: list[float] | None = None, log: bool = False, least: int = 20, max_lag: int | None = None, min_corr: float | None = None) -> DataFrame:
    """The least order of fractional differencing that passes ADF at 5 %: ``symbol, d, p_value, correlation``.

    With ``min_corr`` an order that keeps that correlation with the series is preferred, then any stationary one, then 0.5; without, the greatest order stands in.
    """
    grid = [float(d) for d in grid or [round(0.05 * k, 2) for k in range(21)]]
    value = F.ln(x) if log else F.col(x).cast("double")
    tried = differences_tested(df.select("symbol", "ts", value.alias("x")), grid, max_lag).where(F.col("n") >= least)
    good = F.col("p_value") < 0.05
    pick = F.min_by(F.struct("d", "p_value", "correlation"), F.when(good, F.col("d")))
    if min_corr is None:
        best = F.coalesce(pick, F.max_by(F.struct("d", "p_value", "correlation"), "d"))
    else:
        keeps = F.min_by(F.struct("d", "p_value", "correlation"), F.when(good & (F.col("correlation") >= min_corr), F.col("d")))
        none = F.struct(F.lit(0.5).alias("d"), F.lit(None).cast("double").alias("p_value"), F.lit(None).cast("double").alias("correlation"))
        best = F.coalesce(keeps, pick, none)
    return tried.groupBy("symbol").agg(best.alias("b")).select("symbol", "b.*")


def memory_kept(df: DataFrame, d: float, x: str = "close") -> DataFrame:
    """``symbol, correlation`` of a series with its fractional difference."""
    return frac_diff(df, d, x).where("frac_diff is not null").groupBy("symbol").agg(F.corr(x, "frac_diff").alias("correlation"))


def series_structure(df: DataFrame, price: str = "close") -> DataFrame:
    """One row per symbol: ADF of ln prices, Hurst, volatility, verdict, tails and VaR in nested fields."""
    df = df.withColumn("lp", F.ln(price)).withColumn("ret", s.ret(price))
    v = materialise(var_all(df), "methods").groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("method", "var"))).alias("var"))
    out = adf_test(df, "lp").join(hurst(df, "lp"), "symbol").join(volatility(df), "symbol").join(fat_tails(df), "symbol").join(v, "symbol")
    verdict = F.when(F.col("hurst") < 0.45, "mean reverting").when(F.col("hurst") > 0.55, "trending").otherwise("random walk")
    return out.select(
        "symbol", F.struct("adf_stat", "p_value", "is_stationary").alias("adf"), "hurst", "volatility", verdict.alias("structure"), F.struct("skewness", "excess_kurtosis", "jb_stat", "jb_p", "tail_class").alias("tails"), "var",
    )


def engle_granger(pairs: DataFrame) -> DataFrame:
    """Cointegration of (symbol, ts, s1, s2): least squares of s1 on s2, then ADF of the spread: ``symbol, beta, alpha, correlation, adf_stat, p_value, is_cointegrated``."""
    fit = pairs.groupBy("symbol").agg(F.regr_slope("s1", "s2").alias("beta"), F.regr_intercept("s1", "s2").alias("alpha"), F.corr("s1", "s2").alias("correlation"))
    spread = pairs.join(fit, "symbol").withColumn("spread", F.col("s1") - F.col("beta") * F.col("s2") - F.col("alpha"))
    return fit.join(adf_test(spread, "spread"), "symbol").select("symbol", "beta", "alpha", "correlation", "adf_stat", "p_value", (F.col("p_value") < 0.05).alias("is_cointegrated"))
