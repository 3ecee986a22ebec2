"""Models on feature tables with pyspark.ml: training, cross-validation, importance, stacking, meta-labels, and Sharpe inference.

Labels are 0 and 1 (drop or merge other outcomes first). A feature table has (symbol, ts), the features, ``label`` and,
for weighted fits, ``w``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import econometrics as ec
from ..functions import series as s
from ..sources.market import materialise
from .metrics import sharpe

EULER = 0.5772156649015329


def balanced(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Add ``cw``: n / (2 n_c), times the weight column. Rows without a label have no class and go."""
    n = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    w = F.coalesce(*[F.when(F.col("label") == k, F.lit(sum(n.values()) / (2 * c))) for k, c in n.items() if k is not None], F.lit(None).cast("double"))
    return df.where("label is not null").withColumn("cw", w * F.col(weight) if weight else w)


def forest(features: list[str], trees: int = 500, depth: int = 5, leaf: int = 50, seed: int = 42) -> Pipeline:
    """Random forest on class-balanced weights (``cw``)."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), RandomForestClassifier(labelCol="label", weightCol="cw", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=seed)])


def boosting(features: list[str], rounds: int = 100, depth: int = 3, rate: float = 0.05, sample: float = 0.8, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), GBTClassifier(labelCol="label", weightCol="cw", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=sample, seed=seed)])


def logistic(features: list[str]) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol="label", weightCol="cw")])


def spread(df: DataFrame, rows: int = 10_000, most: int = 96, stored: bool = False) -> DataFrame:
    """df written once, unless it is ``stored`` already (a selection of a written table), and dealt by symbol and time to tasks of about ``rows`` rows, of which there are ``most`` until each has five times as many, then more; sorted, so what a task holds depends on the rows only. A table that comes from windows has as many tasks as symbols."""
    df = df if stored else materialise(df, "training")
    n = df.count()
    return df.repartition(max(min(1 + n // rows, most), n // (5 * rows)), "symbol", "ts").sortWithinPartitions("symbol", "ts")


def fit(estimator: Estimator, df: DataFrame, weight: str | None = None, stored: bool = False) -> Transformer:
    """``estimator`` on class-balanced rows; ensembles of trees, which pass over the rows for each level of their trees, get them dealt evenly to tasks. Boosting passes for one tree at a time, some hundred times: few tasks with more rows."""
    stages = estimator.getStages() if isinstance(estimator, Pipeline) else []
    if any(isinstance(x, GBTClassifier) for x in stages):
        df = spread(df, 50_000, 24, stored)
    elif any(isinstance(x, RandomForestClassifier) for x in stages):
        df = spread(df, 10_000, 96, stored)
    else:
        return estimator.fit(balanced(df, weight))
    df = df.persist()  # else the rows are shuffled again for each of the fit's passes that begin at the table
    try:
        return estimator.fit(balanced(df, weight))
    finally:
        df.unpersist()


def in_threads(spark: SparkSession, f: Callable, items: list, n: int = 6) -> list:
    """f of each item, ``n`` at a time, as the cross-validator of pyspark.ml does it: a fit is many small jobs, which leave most cores idle."""
    with ThreadPool(max(min(n, len(items)), 1)) as pool:
        return pool.map(inheritable_thread_target(spark)(f), items, 1)


def scored(model: Transformer, df: DataFrame) -> DataFrame:
    """df with ``p`` (probability of 1) and ``pred``."""
    out = model.transform(df)
    return out.withColumn("p", vector_to_array("probability")[1]).withColumn("pred", F.col("prediction").cast("int")).select(*df.columns, "p", "pred")


def confusion(df: DataFrame, *keys: str) -> DataFrame:
    """Accuracy, precision, recall, F1 and log loss of (label, pred, p), per keys."""
    y, z = F.col("label") == 1, F.col("pred") == 1
    p = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-15)), F.lit(1e-15))
    m = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y & z).alias("tp"), F.count_if(~y & z).alias("fp"), F.count_if(y & ~z).alias("fn"), F.avg((y == z).cast("double")).alias("accuracy"),
        F.avg(-F.when(y, F.ln(p)).otherwise(F.ln(1 - p))).alias("log_loss"),
    )
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    m = m.withColumns({"precision": zero(F.col("tp"), F.col("tp") + F.col("fp")), "recall": zero(F.col("tp"), F.col("tp") + F.col("fn"))})
    return m.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("tp", "fp", "fn")


def auc(df: DataFrame) -> float:
    return BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label").evaluate(df)


def evaluate(df: DataFrame, ret: str | None = None, periods: int = 252) -> DataFrame:
    """Confusion measures per symbol and, with a return column, those of the strategy ret * (2 pred - 1): Sharpe, PSR, greatest drawdown, win rate."""
    out = confusion(df, "symbol")
    if ret is None:
        return out
    df = df.withColumn("sr", F.col(ret) * (2 * F.col("pred") - 1)).withColumn("__g", F.sum(F.ln(1 + F.greatest("sr", F.lit(-0.999)))).over(s.upto()))
    df = df.withColumn("__dd", F.exp(F.col("__g") - F.max("__g").over(s.upto())) - 1)
    m = df.groupBy("symbol").agg(
        sharpe("sr", periods).alias("sharpe"), psr(F.try_divide(F.avg("sr"), F.stddev_samp("sr")), F.lit(0.0), F.count("sr"), F.skewness("sr"), F.kurtosis("sr") + 3).alias("psr"), F.min("__dd").alias("max_drawdown"), F.avg((F.col("sr") > 0).cast("double")).alias("win_rate"),
    )
    return out.join(m, "symbol")


def roles_of(folds: DataFrame) -> DataFrame:
    """``symbol, ts, fold, role`` of folds, once for all rows of one time, which share their role: test if one of them has that."""
    at = "t0" if "t0" in folds.columns else "ts"
    return folds.select("symbol", F.col(at).alias("ts"), "fold", "role").repartition("symbol", "ts").groupBy("symbol", "ts", "fold").agg(F.min("role").alias("role"))


def in_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """df with ``fold`` and ``role``, a row for each fold it has a role in."""
    return df.join(roles_of(folds), ["symbol", "ts"])


def usable(both: DataFrame, least_train: int = 1, least_test: int = 1) -> list[int]:
    """The folds with so many rows."""
    sizes = {(r["fold"], r["role"]): r["n"] for r in both.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [k for k in sorted({f for f, _ in sizes}) if sizes.get((k, "train"), 0) >= least_train and sizes.get((k, "test"), 0) >= least_test]


def part(both: DataFrame, fold: int, role: str) -> DataFrame:
    return both.where((F.col("fold") == fold) & (F.col("role") == role))


def cross_validate(estimator: Estimator, df: DataFrame, folds: DataFrame, weight: str | None = None, least_train: int = 10, least_test: int = 5) -> DataFrame:
    """Measures per fold, folds from (symbol, t0 or ts, fold, role). Folds with too few rows are left out. A row is written once, with the list of its roles."""
    listed = roles_of(folds).groupBy("symbol", "ts").agg(F.collect_list(F.struct("fold", "role")).alias("__roles"))
    both = materialise(df.na.drop().join(listed, ["symbol", "ts"]), "folds")
    inside = lambda k, role: both.where(F.exists("__roles", lambda x: (x["fold"] == k) & (x["role"] == role))).drop("__roles")

    def measure(k: int) -> DataFrame:
        m = fit(estimator.copy(), inside(k, "train"), weight, stored=True)
        return confusion(scored(m, inside(k, "test"))).withColumn("fold", F.lit(k))

    found = in_threads(df.sparkSession, measure, usable(both.select(F.explode("__roles").alias("x")).select("x.*"), least_train, least_test))
    return reduce(DataFrame.unionByName, found) if found else df.sparkSession.createDataFrame([], "n long, accuracy double, log_loss double, precision double, recall double, f1 double, fold int")


def importance_mdi(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """``feature, importance`` by mean decrease of impurity."""
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, model.stages[-1].featureImportances.toArray(), strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def shuffled(df: DataFrame, *columns: str, keys: tuple[str, ...] = ("symbol",), seed: int = 1) -> DataFrame:
    """df with the values of some columns dealt anew, together, among the rows of equal keys."""
    rest = [c for c in df.columns if c not in (*keys, "ts")]  # rows of one time come in an order of their hashes, as values in order would meet their like
    order = lambda salt: F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("ts", F.lit(salt)), "ts", F.xxhash64(*rest, F.lit(salt)), *rest))
    values = df.select(*keys, order(seed).alias("__k"), *[F.col(c).alias(f"__v_{c}") for c in columns])
    return df.withColumn("__k", order(seed + 1)).join(values, [*keys, "__k"]).select(*[F.col(f"__v_{c}").alias(c) if c in columns else c for c in df.columns])


def importance_mda(estimator: Estimator, df: DataFrame, folds: DataFrame, features: list[str]) -> DataFrame:
    """``feature, importance``: the drop of accuracy on test rows when a feature is shuffled, summed over folds that have both roles.

    A feature is shuffled within a fold's test rows of a symbol. Each test row is scored as it is and once per feature, in one pass."""
    spark = df.sparkSession
    both = materialise(in_folds(df, folds).na.drop(), "folds")
    other = [f"__other_{f}" for f in features]
    test = both.where("role = 'test'").select("*", *[F.col(f).alias(o) for f, o in zip(features, other, strict=True)])
    test = materialise(shuffled(test, *other, keys=("fold", "symbol")), "shuffled")
    variants = [F.struct(F.lit(f or "").alias("without"), *[F.col(f"__other_{g}" if g == f else g).alias(g) for g in features]) for f in (None, *features)]

    def drops(k: int) -> list[tuple[str, float]]:
        m = fit(estimator.copy(), part(both, k, "train").drop("fold", "role"))
        rows = test.where(F.col("fold") == k).select("label", F.explode(F.array(*variants)).alias("x")).select("label", "x.*")
        accuracy = {r["without"]: r["accuracy"] for r in confusion(scored(m, rows), "without").collect()}
        return [(f, accuracy[""] - accuracy[f]) for f in features]

    rows = [x for found in in_threads(spark, drops, usable(both)) for x in found]
    return spark.createDataFrame(rows, "feature string, importance double").groupBy("feature").agg(F.sum("importance").alias("importance")).orderBy(F.desc("importance"), "feature")


def importance_sfi(df: DataFrame, folds: DataFrame, features: list[str]) -> DataFrame:
    """``feature, mean, std``: cross-validated accuracy of a model on each feature alone. Rows are dealt to folds once for all features."""
    spark = df.sparkSession
    both = materialise(in_folds(df.select("symbol", "ts", *features, "label"), folds), "folds")
    alone = {f: both.select("symbol", "ts", f, "label", "fold", "role").na.drop() for f in features}

    def measure(fk: tuple[str, int]) -> DataFrame:
        f, k = fk
        m = fit(logistic([f]), part(alone[f], k, "train"))
        return confusion(scored(m, part(alone[f], k, "test"))).select(F.lit(f).alias("feature"), "accuracy")

    kept = in_threads(spark, lambda f: [(f, k) for k in usable(alone[f], 10, 5)], features)
    found = in_threads(spark, measure, [x for fks in kept for x in fks])
    names = spark.createDataFrame([(f,) for f in features], "feature string")
    scores = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "feature string, accuracy double")
    return names.join(scores, "feature", "left").groupBy("feature").agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))


@dataclass
class Stack:
    """Base models whose probabilities a logistic regression combines."""

    bases: list[Transformer] = field(default_factory=list)
    top: Transformer | None = None

    @classmethod
    def train(cls, estimators: list[Estimator], df: DataFrame) -> Stack:
        df = materialise(df, "stack")
        one = cls([fit(e, df, stored=True) for e in estimators])
        one.top = fit(logistic([f"p{i}" for i in range(len(estimators))]), materialise(one.probabilities(df), "probabilities"))
        return one

    def probabilities(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.bases):
            out = scored(m, out).withColumnRenamed("p", f"p{i}").drop("pred")
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        return scored(self.top, self.probabilities(df))


def contributions(stack: Stack, df: DataFrame) -> DataFrame:
    """``model`` and the evaluation of each base model (``base_0`` ..) and of the stack. Rows are scored by each model once."""
    rows = materialise(stack.probabilities(df), "probabilities")
    found = {f"base_{i}": rows.select("label", F.col(f"p{i}").alias("p"), (F.col(f"p{i}") > 0.5).cast("int").alias("pred")) for i in range(len(stack.bases))}
    found["stack"] = scored(stack.top, rows).select("label", "p", "pred")
    return reduce(DataFrame.unionByName, [confusion(x.withColumn("model", F.lit(n)), "model") for n, x in found.items()])


def bet_size(p: Column, threshold: float = 0.5) -> Column:
    """clip(2p - 1, 0, 1) where p reaches the threshold, else 0."""
    return F.when(p >= threshold, F.least(F.greatest(2 * p - 1, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def meta_decisions(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """From ``side`` and ``p``: ``take``, ``size``, ``final`` side and ``action``."""
    take = (F.col("p") >= threshold).cast("int")
    return df.withColumns({"take": take, "size": bet_size(F.col("p"), threshold), "final": F.col("side") * take}).withColumn("action", F.when(F.col("final") == 1, "BUY").when(F.col("final") == -1, "SELL").otherwise("PASS"))


def phi(z: Column) -> Column:
    from .risk import phi as normal

    return normal(z)


def psr(sr: Column, benchmark: Column, n: Column, skew: Column, kurtosis: Column) -> Column:
    """Probability that the true Sharpe ratio exceeds the benchmark; both per period, kurtosis 3 for a normal. 0.5 where the variance is not positive."""
    var = (1 + 0.5 * sr * sr - skew * sr + (kurtosis - 3) / 4 * sr * sr) / n
    return F.when(var <= 0, 0.5).otherwise(phi(F.try_divide(sr - benchmark, F.sqrt(var))))


def expected_max_sharpe(trials: int, sd: float = 1.0) -> float:
    """Expected greatest of a number of independent trials' Sharpe ratios with mean 0; 0 for one trial."""
    if trials <= 1:
        return 0.0
    return sd * ((1 - EULER) * ec.PHI.inv_cdf(1 - 1 / trials) + EULER * ec.PHI.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(sr: Column, sd: float, trials: int, n: Column, skew: Column, kurtosis: Column) -> Column:
    """PSR against the expected maximum of the trials."""
    return psr(sr, F.lit(expected_max_sharpe(trials, sd)), n, skew, kurtosis)


def deflated_excess(sr: float, trials: int, n: int, skew: float = 0.0, kurtosis: float = 3.0) -> dict:
    """Sharpe over the expected maximum of unit-variance trials, its chance, and whether that is below 5 %."""
    top = expected_max_sharpe(trials)
    var = (1 + 0.5 * sr * sr - skew * sr + (kurtosis - 3) / 4 * sr * sr) / max(n, 1)
    p = 1 - ec.PHI.cdf((sr - top) / math.sqrt(var)) if var > 0 else 0.5
    return {"dsr": sr - top, "expected_max": top, "probability_by_chance": p, "is_significant": p < 0.05}


def deflated_excess_of(sr: Column, trials: int, n: Column, skew: Column, kurtosis: Column) -> dict[str, Column]:
    """``deflated_excess`` over columns: one Sharpe ratio per row."""
    top = expected_max_sharpe(trials)
    p = 1 - psr(sr, F.lit(top), n, skew, kurtosis)
    return {"dsr": sr - top, "expected_max": F.lit(top), "probability_by_chance": p, "is_significant": p < 0.05}


def orthogonal(df: DataFrame, features: list[str], share: float = 0.95) -> tuple[DataFrame, list[str]]:
    """Standardise and rotate to the fewest components that keep ``share`` of the variance: ``pc_1`` .. and the constant ``explained_variance``. Nulls count as 0."""
    filled = df.na.fill(0.0, subset=features)
    p = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__v"), StandardScaler(inputCol="__v", outputCol="__z", withMean=True), PCA(k=len(features), inputCol="__z", outputCol="__pc")]).fit(filled)
    ratio = p.stages[-1].explainedVariance.toArray()
    run, k = 0.0, 0
    while k < len(ratio) and run <= share:
        run, k = run + float(ratio[k]), k + 1
    names = [f"pc_{i + 1}" for i in range(k)]
    out = p.transform(filled).withColumn("__a", vector_to_array("__pc"))
    return out.select(*df.columns, *[F.col("__a")[i].alias(n) for i, n in enumerate(names)], F.lit(run).alias("explained_variance")), names


def validate_strategy(cv: DataFrame, sr: float, trials: int, n: int) -> dict:
    """Three checks: accuracy over 0.5 on average, deviation of folds under 0.1, and a significant deflated Sharpe."""
    m = cv.agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("sd")).first()
    d = deflated_excess(sr, trials, n)
    checks = {"beats_chance": (m["mean"] or 0) > 0.5, "stable": (m["sd"] or 1) < 0.1, "significant": d["is_significant"]}
    return {**checks, "passes": all(checks.values()), "mean_accuracy": m["mean"], **d}
