"""Forecasts per symbol and model, an ensemble over them, and Monte-Carlo fans."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import econometrics as ec
from .running import in_order

PATHS = "symbol string, model string, step int, yhat double, lo double, hi double, rmse double"
MODELS = ("arma", "holt", "garch", "ridge")
Z90 = 1.645


def _arma(x: np.ndarray, h: int) -> tuple:
    r = np.diff(x) / x[:-1]
    cut = int(0.8 * len(r))
    err = ec.arma(r[:cut], 1)[2]
    mean, sd, _ = ec.arma(r, h)
    path = lambda v: x[-1] * np.cumprod(1 + v)
    return path(mean), path(mean - Z90 * sd), path(mean + Z90 * sd), err


def _holt(x: np.ndarray, h: int) -> tuple:
    cut = int(0.8 * len(x))
    err = math.sqrt(float(np.mean((x[cut:] - ec.damped_holt(x[:cut], len(x) - cut)) ** 2)))
    y = ec.damped_holt(x, h)
    band = Z90 * np.std(np.diff(x) / x[:-1], ddof=1) * x[-1] * np.sqrt(np.arange(1, h + 1))
    return y, y - band, y + band, err


def _garch(x: np.ndarray, h: int) -> tuple:
    r = np.diff(x) / x[:-1]
    b = np.polyfit(r[:-1], r[1:], 1) if len(r) > 3 and np.ptp(r) > 0 else np.array([0.0, r.mean()])
    e = r[1:] - np.polyval(b, r[:-1])
    g = ec.garch(e, student=False)
    means, last = [], r[-1]
    for _ in range(h):
        last = b[0] * last + b[1]
        means.append(last)
    var = [g["omega"] / 1e4 + g["alpha"] * e[-1] ** 2 + g["beta"] * g["vol"][-1] ** 2]
    for _ in range(h - 1):
        var.append(g["omega"] / 1e4 + g["persistence"] * var[-1])
    spread = Z90 * np.sqrt(np.cumsum(var))
    return x[-1] * np.cumprod(1 + np.array(means)), x[-1] * np.exp(-spread), x[-1] * np.exp(spread), float(np.std(e, ddof=1) * 100)


def _design(x: np.ndarray) -> np.ndarray:
    """Features of the last row: lagged returns, deviations, distances from averages, momentum."""
    r = np.diff(x) / x[:-1]
    return np.array([1.0, *[r[-k] for k in (1, 2, 3, 5)], r[-5:].std(), r[-20:].std(), x[-1] / x[-20:].mean() - 1, x[-1] / x[-20] - 1])


def _designs(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``_design`` of the series up to each of the given places, which have 20 values before them."""
    r = np.diff(v) / v[:-1]
    fives, twenties, prices = sliding_window_view(r, 5)[at - 5], sliding_window_view(r, 20)[at - 20], sliding_window_view(v, 20)[at - 19]
    return np.column_stack([np.ones(len(at)), *[r[at - k] for k in (1, 2, 3, 5)], fives.std(1), twenties.std(1), v[at] / prices.mean(1) - 1, v[at] / v[at - 19] - 1])


class Ridge:
    """A ridge regression of next returns on ``_design`` for a series of ``n`` prices that come in order, part by part; holds sums of products, the last prices and a part.

    Coefficients of the first 0.8 of the rows give the error on the rest, those of all rows the path.
    """

    FIRST, BACK, PENALTY = 25, 60, 1.0

    def __init__(self, n: int):
        self.cut = max(int(0.8 * (n - 1 - self.FIRST)), 1)
        self.seen, self.tail, self.rows, self.tested, self.miss = 0, np.zeros(0), 0, 0, 0.0
        self.zz, self.zy, self.sums, self.early = np.zeros((9, 9)), np.zeros(9), np.zeros(2), None

    def _solve(self) -> np.ndarray:
        return np.linalg.solve(self.zz + self.PENALTY * np.eye(9), self.zy)

    def take(self, x: np.ndarray) -> None:
        v = np.concatenate([self.tail, x])
        begin = self.seen - len(self.tail)
        at = np.arange(max(self.FIRST, self.seen - 1) - begin, len(v) - 1)  # places whose next price is here
        self.seen, self.tail = self.seen + len(x), v[-self.BACK :]
        if not len(at):
            return
        z, y = _designs(v, at), v[at + 1] / v[at] - 1
        before = min(max(self.cut - self.rows, 0), len(y))
        for a, b in ((0, before), (before, len(y))):
            if a == b:
                continue
            if self.rows >= self.cut:
                self.early = self._solve() if self.early is None else self.early
                self.miss, self.tested = self.miss + float(((y[a:b] - z[a:b] @ self.early) ** 2).sum()), self.tested + b - a
            self.zz, self.zy, self.rows = self.zz + z[a:b].T @ z[a:b], self.zy + z[a:b].T @ y[a:b], self.rows + b - a
        self.sums += [y.sum(), (y * y).sum()]

    def forecast(self, h: int) -> tuple:
        sd = math.sqrt(max(self.sums[1] / self.rows - (self.sums[0] / self.rows) ** 2, 0.0))
        err, w, path = math.sqrt(self.miss / self.tested) if self.tested else sd, self._solve(), list(self.tail)
        for _ in range(h):
            path.append(path[-1] * (1 + float(np.clip(_design(np.array(path[-60:])) @ w, -0.5, 0.5))))
        out = np.array(path[-h:])
        band = Z90 * sd * np.sqrt(np.arange(1, h + 1)) * self.tail[-1]
        return out, out - band, out + band, err


def _ridges(df: DataFrame, horizon: int, least: int) -> DataFrame:
    """Paths of the ridge regression from (symbol, ts, x, n), n the length of the series."""

    def begin() -> Callable[[pa.RecordBatch | None], pa.RecordBatch | None]:
        model, symbol = None, None

        def take(batch: pa.RecordBatch | None) -> pa.RecordBatch | None:
            nonlocal model, symbol
            if batch is None:
                return pa.RecordBatch.from_struct_array(_rows(symbol, "ridge", *model.forecast(horizon)).to_struct_array().combine_chunks())
            if model is None:
                model, symbol = Ridge(batch.column("n")[0].as_py()), batch.column("symbol")[0].as_py()
            model.take(batch.column("x").to_numpy(zero_copy_only=False).astype(float))
            return None

        return take

    return in_order(df.where(F.col("n") >= least), begin, PATHS)


def _rows(symbol: str, model: str, y: np.ndarray, lo: np.ndarray, hi: np.ndarray, err: float) -> pa.Table:
    n = len(y)
    return pa.table({
        "symbol": pa.array([symbol] * n, pa.string()), "model": pa.array([model] * n, pa.string()), "step": pa.array(np.arange(1, n + 1), pa.int32()),
        **{c: pa.array(np.asarray(v, float), pa.float64(), from_pandas=True) for c, v in (("yhat", y), ("lo", lo), ("hi", hi), ("rmse", np.full(n, err)))},
    })


RUN = {"arma": _arma, "holt": _holt, "garch": _garch}


def forecasts(df: DataFrame, horizon: int = 30, models: tuple[str, ...] = MODELS, price: str = "close", least: int = 60) -> DataFrame:
    """Long table of paths with 90 % bands and validation errors, a task per symbol and model; the ridge regression takes a series in parts. Series under ``least`` rows give none."""
    known = df.where(F.col(price).isNotNull()).select("symbol", "ts", F.col(price).alias("x"))
    whole, parts = [m for m in models if m != "ridge"], []
    tasks = known.withColumn("model", F.explode(F.array(*[F.lit(m) for m in whole]))) if whole else None

    def one(key: tuple, table: pa.Table) -> pa.Table:
        symbol, model = (k.as_py() for k in key)
        x = table.select(["ts", "x"]).sort_by("ts")["x"].to_numpy().astype(float)
        return _rows(symbol, model, *(RUN[model](x, horizon) if len(x) >= least else ([], [], [], math.nan)))

    if tasks is not None:
        parts.append(tasks.groupBy("symbol", "model").applyInArrow(one, PATHS))
    if "ridge" in models:
        parts.append(_ridges(known.join(known.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), "symbol"), horizon, max(least, Ridge.FIRST + 2)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def analyst_path(targets: DataFrame, horizon: int = 30) -> DataFrame:
    """Straight lines from ``last`` to ``target`` (with ``low``, ``high``) as a model of its own; targets that are not positive give none."""
    df = targets.where("target > 0").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    line = lambda c: F.col("last") + (F.coalesce(F.col(c), F.col("target")) - F.col("last")) * F.col("step") / horizon
    return df.select("symbol", F.lit("analyst").alias("model"), "step", line("target").alias("yhat"), line("low").alias("lo"), line("high").alias("hi"), (F.abs(F.col("target") - F.col("last")) * 0.1).alias("rmse"))


def reweighted(paths: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Validation errors scaled by rules on (symbol, beta, pe, forward_pe, margin_up): a high beta trusts volatility models, a low one smooth models, a cheap forward earnings ratio or rising margin the analysts."""
    c = F.col
    factor = (
        F.when((c("beta") > 1.5) & (c("model") == "garch"), 0.7).when((c("beta") < 0.7) & c("model").isin("holt", "arma"), 0.8)
        .when((F.try_divide(c("forward_pe"), c("pe")) < 0.85) & (c("model") == "analyst"), 0.7).when(c("margin_up") & (c("model") == "analyst"), 0.85).otherwise(1.0)
    )
    return paths.join(fundamentals, "symbol", "left").withColumn("rmse", c("rmse") * factor).select(paths.columns)


def ensemble(paths: DataFrame) -> DataFrame:
    """Mean path of each symbol with weights 1 / rmse (1e-3 where that is missing or not positive)."""
    w = 1 / F.when(F.col("rmse") > 0, F.col("rmse")).otherwise(1e-3)
    mean = lambda c: (F.sum(F.col(c) * w) / F.sum(w)).alias(c)
    return paths.where("yhat is not null").groupBy("symbol", "step").agg(mean("yhat"), mean("lo"), mean("hi"), F.count(F.lit(1)).alias("n_models"))


def monte_carlo(df: DataFrame, horizon: int = 30, paths: int = 20_000, price: str = "close", seed: int = 42) -> DataFrame:
    """Geometric Brownian paths from each symbol's returns: percentiles per step and chances at the end: ``symbol, step, p5 .. p95, p_gain, p_loss_5, p_loss_10``.

    Normal draws come from a hash of seed, symbol, path and step, so reruns agree whatever the partitions; cumulative sums run per path.
    """
    from ..functions import series as s

    m = df.withColumn("__r", F.ln(F.try_divide(F.col(price), s.lag(price)))).groupBy("symbol").agg(F.avg("__r").alias("mu"), F.stddev_samp("__r").alias("sd"), F.max_by(price, "ts").alias("last"))
    grid = df.sparkSession.range(paths).withColumnRenamed("id", "path").crossJoin(F.broadcast(m)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "symbol", "path", "step"), F.lit(1 << 52)) + 0.5) / (1 << 52)
    z = F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * math.pi * u(2))
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", "path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    walk = grid.withColumn("x", F.col("last") * F.exp(F.sum(F.col("mu") + F.col("sd") * z).over(w)))
    gain = F.col("x") / F.col("last") - 1
    share = lambda cond: F.avg(cond.cast("double"))
    return walk.groupBy("symbol", "step").agg(
        *[F.percentile_approx("x", q, 2000).alias(f"p{int(q * 100)}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)], share(gain > 0).alias("p_gain"), share(gain < -0.05).alias("p_loss_5"), share(gain < -0.1).alias("p_loss_10"),
    )
