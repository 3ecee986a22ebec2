"""Regressors of the next return, learned on one table of all symbols, and their recursive paths.

A model sees every symbol's rows (features of ``windows.forecast_features``), so learning is one distributed fit per learner, not one per symbol. A
path feeds each forecast back as the next price: a round computes features of the last row of every (symbol, model) from a bounded tail of prices,
asks the models, and appends a row to each tail.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as s
from ..sources.market import materialise
from .forecast import Z90
from .learning import spread
from .windows import forecast_features

LEARNERS = ("forest", "boosting", "ridge")
#: Rows before a row that its features need.
TAIL = 64


def regressor(name: str, features: list[str], seed: int = 42, **options: object) -> Pipeline:
    """forest: 150 trees; boosting: 200 rounds of depth 5 at 0.05 on samples of 0.8; ridge: squared penalty. ``options`` replace parameters of the learner."""
    made: Estimator
    common = {"labelCol": "target", "featuresCol": "scaled", "predictionCol": "yhat"}
    if name == "forest":
        made = RandomForestRegressor(**{"numTrees": 150, "maxDepth": 8, "featureSubsetStrategy": "onethird", "seed": seed, **common, **options})
    elif name == "boosting":
        made = GBTRegressor(**{"maxIter": 200, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": seed, **common, **options})
    elif name == "ridge":
        made = LinearRegression(**{"regParam": 1e-3, "elasticNetParam": 0.0, "solver": "normal", **common, **options})
    else:
        raise ValueError(f"no learner {name!r}")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), made])


def learning_table(df: DataFrame, price: str = "close") -> tuple[DataFrame, list[str]]:
    """Features, and ``target``, the return of the next row (null on a series' last row); rows that lack a feature left out."""
    bars = df.where(F.col(price) > 0).select("symbol", "ts", F.col(price).cast("double").alias("price"))
    feats = forecast_features(bars, "price").withColumn("target", F.try_divide(s.lead("price"), F.col("price")) - 1)
    names = [c for c in feats.columns if c not in (*bars.columns, "target")]
    return feats.na.drop(subset=names), names


@dataclass
class Learners:
    """Learners fitted on the first part of each symbol's rows; ``errors`` are root mean squared errors of returns over the rest."""

    models: dict[str, PipelineModel] = field(default_factory=dict)
    features: list[str] = field(default_factory=list)
    errors: DataFrame | None = None

    @classmethod
    def train(cls, df: DataFrame, price: str = "close", learners: tuple[str, ...] = LEARNERS, share: float = 0.8, **options: dict) -> Learners:
        """``options`` are parameters by learner."""
        table, names = learning_table(df, price)
        known = table.where("target is not null").withColumn("__p", F.percent_rank().over(Window.partitionBy("symbol").orderBy("ts")))
        known = materialise(known.select("symbol", "ts", *names, "target", "__p"), "learning")
        one, parts, first = cls(features=names), [], known.where(F.col("__p") < share)
        for name in learners:
            est = regressor(name, names, **options.get(name, {}))
            training = (spread(first, 50_000, 24, True) if name == "boosting" else spread(first, 10_000, 96, True)).persist()  # boosting passes some thousand times over its rows: few tasks, as in learning.fit
            one.models[name] = est.fit(training)
            training.unpersist()
            tested = one.models[name].transform(known.where(F.col("__p") >= share))
            parts.append(tested.groupBy("symbol").agg(F.sqrt(F.avg(F.pow(F.col("yhat") - F.col("target"), 2))).alias("rmse"), F.count(F.lit(1)).alias("n")).withColumn("model", F.lit(name)))
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        one.errors = materialise(out.select("symbol", "model", "rmse", "n"), "errors")
        return one

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows of (model, features) with ``yhat``."""
        parts = [m.transform(rows.where(F.col("model") == name)).drop("raw", "scaled") for name, m in self.models.items()]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    def paths(self, df: DataFrame, horizon: int = 30, price: str = "close") -> DataFrame:
        """Long table of paths as in ``forecast.forecasts``; bands grow with the root of the step and the model's error. Symbols with too few rows for features give none."""
        bars = df.where(F.col(price) > 0).select("symbol", "ts", F.col(price).cast("double").alias("price"))
        back = F.row_number().over(s.whole().orderBy(F.desc("ts")))
        ends = bars.groupBy("symbol").agg(F.max_by("price", "ts").alias("last"))
        models = df.sparkSession.createDataFrame([(m,) for m in self.models], "model string")
        # a series per symbol and model; places stand for times, which the next steps do not have
        tail = bars.withColumn("__k", back).where(F.col("__k") <= TAIL).select("symbol", (-F.col("__k").cast("long")).alias("place"), "price").crossJoin(F.broadcast(models))
        tail = materialise(tail, "tail")
        for step in range(1, horizon + 1):
            series = tail.where(F.col("place") >= step - 1 - TAIL).select(F.struct("symbol", "model").alias("symbol"), F.col("place").alias("ts"), "price")
            last = forecast_features(series, "price").where(F.col("ts") == step - 2).na.drop(subset=self.features)
            asked = self.predict(last.select("symbol.symbol", "symbol.model", "price", *self.features))
            new = asked.select("symbol", F.lit(step - 1).cast("long").alias("place"), (F.col("price") * (1 + F.col("yhat"))).alias("price"), "model")
            tail = materialise(tail.unionByName(new), "tail")
        found = tail.where("place >= 0").withColumn("step", (F.col("place") + 1).cast("int"))
        band = Z90 * F.col("rmse") * F.sqrt(F.col("step").cast("double")) * F.col("last")
        both = found.join(ends, "symbol").join(self.errors, ["symbol", "model"], "left")
        return both.select("symbol", "model", "step", F.col("price").alias("yhat"), (F.col("price") - band).alias("lo"), (F.col("price") + band).alias("hi"), "rmse")


def learner_paths(df: DataFrame, horizon: int = 30, price: str = "close", learners: tuple[str, ...] = LEARNERS, **options: dict) -> DataFrame:
    """Train and forecast in one go."""
    return Learners.train(df, price, learners, **options).paths(df, horizon, price)
