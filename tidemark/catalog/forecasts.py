"""Section 2.11: forecasting and simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as op
from ..operators.learners import learner_paths
from .book import Book, rounded

book = Book()


def bars(df):
    return df.select("symbol", "ts", (100 + F.col("price") / 50).alias("close"))


def _model(name):
    def run(df):
        return rounded(op.forecasts(bars(df), 10, (name,)), "symbol", "model", "step", yhat="yhat", lo="lo", hi="hi", rmse="rmse")

    return run


for _id, _name in (("X1_arma", "arma"), ("X2_damped_holt", "holt"), ("X3_garch_path", "garch"), ("X4_ridge", "ridge")):
    book.add(_id, "ticks")(_model(_name))


@book.add("X4_learners", "ticks")
def _(df):
    return rounded(learner_paths(bars(df)), "symbol", "model", "step", yhat="yhat", lo="lo", hi="hi", rmse="rmse")


@book.add("X6_monte_carlo", "ticks")
def _(df):
    return op.monte_carlo(bars(df), 10)


TARGET = "t AS (SELECT symbol, arg_max(price, ts) AS last, avg(price) AS target, min(price) AS low, max(price) AS high FROM ticks GROUP BY 1)"


def targets(df):
    return df.groupBy("symbol").agg(F.max_by("price", "ts").alias("last"), F.avg("price").alias("target"), F.min("price").alias("low"), F.max("price").alias("high"))


@book.add(
    "X7_analyst_path", "ticks",
    "SELECT symbol, 'analyst' AS model, CAST(step AS INTEGER) AS step, round(last + (target - last) * step / 10, 6) AS yhat, round(last + (low - last) * step / 10, 6) AS lo, round(last + (high - last) * step / 10, 6) AS hi, round(abs(target - last) * 0.1, 6) AS rmse"
    " FROM t, (SELECT unnest(range(1, 11)) AS step)", TARGET,
)
def _(df):
    return rounded(op.analyst_path(targets(df), 10), "symbol", "model", "step", yhat="yhat", lo="lo", hi="hi", rmse="rmse")


FUND = "f AS (SELECT symbol, CASE WHEN symbol < 'm' THEN 2.0 ELSE 0.5 END AS beta FROM ticks GROUP BY 1), p AS (SELECT symbol, model, CAST(step AS INTEGER) AS step, price AS yhat, rmse FROM (SELECT symbol, CAST(size AS INTEGER) AS step, avg(price) AS price FROM ticks GROUP BY 1, 2), (SELECT unnest(['garch', 'holt']) AS model, unnest([1.0::DOUBLE, 2.0::DOUBLE]) AS rmse))"


def _paths(df):
    base = df.groupBy("symbol", F.col("size").cast("int").alias("step")).agg(F.avg("price").alias("yhat"))
    models = df.sparkSession.createDataFrame([("garch", 1.0), ("holt", 2.0)], "model string, rmse double")
    return base.crossJoin(F.broadcast(models)).select("symbol", "model", "step", "yhat", F.col("yhat").alias("lo"), F.col("yhat").alias("hi"), "rmse")


@book.add("X8_reweighted", "ticks", "SELECT symbol, model, step, round(yhat, 6) AS yhat, round(rmse * CASE WHEN beta > 1.5 AND model = 'garch' THEN 0.7 WHEN beta < 0.7 AND model = 'holt' THEN 0.8 ELSE 1 END, 6) AS rmse FROM p JOIN f USING (symbol)", FUND)
def _(df):
    f = df.select("symbol").distinct().select("symbol", F.when(F.col("symbol") < "m", 2.0).otherwise(0.5).alias("beta"), F.lit(None).cast("double").alias("pe"), F.lit(None).cast("double").alias("forward_pe"), F.lit(None).cast("boolean").alias("margin_up"))
    return rounded(op.reweighted(_paths(df), f), "symbol", "model", "step", yhat="yhat", rmse="rmse")


@book.add("X9_ensemble", "ticks", "SELECT symbol, step, round(sum(yhat * CASE model WHEN 'garch' THEN 1.5 ELSE 1 END / rmse) / sum(CASE model WHEN 'garch' THEN 1.5 ELSE 1 END / rmse), 6) AS yhat, count(*) AS n_models FROM p GROUP BY 1, 2", FUND)
def _(df):
    return rounded(op.ensemble(_paths(df)), "symbol", "step", "n_models", yhat="yhat")


@book.add("X9_forecast_ensemble", "ticks")
def _(df):
    return rounded(op.ensemble(op.forecasts(bars(df), 10)), "symbol", "step", "n_models", yhat="yhat", lo="lo", hi="hi")
