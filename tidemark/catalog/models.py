"""Section 2.9: models, importance, evaluation, Sharpe statistics."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..functions import series as s
from ..operators import learning as op
from ..operators import weights
from ..plans import pipelines
from ..sources.market import materialise, shared_path
from .book import Book, phi_sql, rounded

book = Book()
FEATURES = ["ret_1", "ret_5", "z_20", "size"]


def table(df):
    df = df.withColumns({"ret_1": s.ret("price"), "ret_5": s.ret("price", 5), "z_20": s.zscore("price", 20), "label": (s.lead("price") > F.col("price")).cast("int"), "next_ret": F.try_divide(s.lead("price"), F.col("price")) - 1})
    return df.select("symbol", "ts", *FEATURES, "label", "next_ret").na.drop(subset=[*FEATURES, "label"])  # a price of 0 has a label, but no next return


def split(df):
    df = weights.temporal_split(table(df))
    return (df.where(F.col("role") == r).drop("role") for r in ("train", "test"))


def spans(df):
    return df.withColumn("t1", F.lead("ts", 2).over(s.by())).where("t1 is not null").select("symbol", F.col("ts").alias("t0"), "t1")


def measured(estimator, df):
    train, test = split(df)
    return rounded(op.evaluate(op.scored(op.fit(estimator, train), test)), "symbol", "n", **{c: c for c in ("accuracy", "precision", "recall", "f1", "log_loss")})


@book.add("M1_random_forest", "ticks")
def _(df):
    return measured(op.forest(FEATURES), df)


@book.add("M2_boosting", "ticks")
def _(df):
    return measured(op.boosting(FEATURES), df)


@book.add("M3_stacking", "ticks")
def _(df):
    train, test = split(df)
    stack = op.Stack.train([op.forest(FEATURES), op.logistic(FEATURES)], train)
    return rounded(op.confusion(stack.predict(test), "symbol"), "symbol", "n", accuracy="accuracy", f1="f1")


@book.add("M13_base_contributions", "ticks")
def _(df):
    train, test = split(df)
    stack = op.Stack.train([op.forest(FEATURES), op.logistic(FEATURES)], train)
    return rounded(op.contributions(stack, test), "model", "n", accuracy="accuracy", f1="f1", log_loss="log_loss")


@book.add("S30_model_round_trip", "ticks")
def _(df):
    train, test = split(df)
    path = shared_path(df.sparkSession, "model")
    op.fit(op.forest(FEATURES, trees=100), train).write().save(path)
    return rounded(op.scored(PipelineModel.load(path), test), "symbol", "ts", p="p")


BETS = "t AS (SELECT symbol, ts, size / 100 AS p, CASE WHEN price > 50 THEN 1 ELSE -1 END AS side FROM ticks)"


@book.add(
    "M4_bet_sizing", "ticks",
    "SELECT symbol, ts, CAST(p >= 0.5 AS INTEGER) AS take, round(CASE WHEN p >= 0.5 THEN least(greatest(2 * p - 1, 0), 1) ELSE 0 END, 6) AS bet, side * CAST(p >= 0.5 AS INTEGER) AS final,"
    " CASE side * CAST(p >= 0.5 AS INTEGER) WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' ELSE 'PASS' END AS action FROM t", BETS,
)
def _(df):
    out = op.meta_decisions(df.select("symbol", "ts", (F.col("size") / 100).alias("p"), F.when(F.col("price") > 50, 1).otherwise(-1).alias("side")))
    return out.select("symbol", "ts", "take", F.round("size", 6).alias("bet"), "final", "action")


@book.add("M5_meta_pipeline", "ticks")
def _(df):
    bars = df.select("symbol", "ts", (100 + F.col("price")).alias("close"), (101 + F.col("price")).alias("high"), (99 + F.col("price")).alias("low"), (1 + F.col("size")).alias("volume"))
    return rounded(pipelines.MetaPipeline(trees=100).fit(bars).predict(bars), "symbol", "ts", "side", "take", "action", p="p")


@book.add("M6_importance_mdi", "ticks")
def _(df):
    train, _ = split(df)
    return op.importance_mdi(op.fit(op.forest(FEATURES), train), FEATURES, df.sparkSession)


@book.add("M7_importance_mda", "ticks")
def _(df):
    return op.importance_mda(op.logistic(FEATURES), table(df).drop("next_ret"), weights.purged_kfold(spans(df), 3), FEATURES)


@book.add("M8_importance_sfi", "ticks")
def _(df):
    return op.importance_sfi(table(df).drop("next_ret"), weights.purged_kfold(spans(df), 3), FEATURES)


def sharpe_moments(df):
    r = F.col("price") / 100 - 0.49
    return df.groupBy("symbol").agg((F.avg(r) / F.stddev_samp(r)).alias("sr"), F.count(r).alias("n"), F.skewness(r).alias("g"), (F.kurtosis(r) + 3).alias("k"))


SHARPE = (
    "r AS (SELECT symbol, price / 100 - 0.49::DOUBLE AS r, avg(price / 100 - 0.49::DOUBLE) OVER (PARTITION BY symbol) AS mu, stddev_pop(price / 100 - 0.49::DOUBLE) OVER (PARTITION BY symbol) AS sd FROM ticks),"
    " q AS (SELECT symbol, avg(r) / stddev_samp(r) AS sr, count(r) AS n, avg(power((r - mu) / sd, 3)) AS g, avg(power((r - mu) / sd, 4)) AS k FROM r GROUP BY 1), m AS (SELECT *, (1 + 0.5 * sr * sr - g * sr + (k - 3) / 4 * sr * sr) / n AS v FROM q)"
)


@book.add("M9_probabilistic_sharpe", "ticks", f"SELECT symbol, round({phi_sql('a')}, 6) AS psr, round({phi_sql('b')}, 6) AS dsr FROM (SELECT symbol, sr / sqrt(v) AS a, (sr - {op.expected_max_sharpe(10, 0.02)!r}) / sqrt(v) AS b FROM m)", SHARPE)
def _(df):
    m = sharpe_moments(df)
    return rounded(m, "symbol", psr=op.psr(F.col("sr"), F.lit(0.0), F.col("n"), F.col("g"), F.col("k")), dsr=op.deflated_sharpe(F.col("sr"), 0.02, 10, F.col("n"), F.col("g"), F.col("k")))


@book.add(
    "M10_deflated_sharpe", "ticks",
    f"SELECT symbol, trials, round({phi_sql('z')}, 6) AS dsr FROM (" + " UNION ALL ".join(f"SELECT symbol, {t} AS trials, (sr - {op.expected_max_sharpe(t, 0.02)!r}) / sqrt(v) AS z FROM m" for t in (1, 10, 100)) + ")", SHARPE,
)
def _(df):
    m = sharpe_moments(df)
    found = [m.select("symbol", F.lit(t).alias("trials"), F.round(op.deflated_sharpe(F.col("sr"), 0.02, t, F.col("n"), F.col("g"), F.col("k")), 6).alias("dsr")) for t in (1, 10, 100)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _excess_sql(t: int) -> str:
    return f"SELECT symbol, {t} AS trials, sr - {op.expected_max_sharpe(t)!r} AS dsr, (sr - {op.expected_max_sharpe(t)!r}) / sqrt(v) AS z FROM m"


@book.add(
    "M11_deflated_excess", "ticks", f"SELECT symbol, trials, round(dsr, 6) AS dsr, round(1 - {phi_sql('z')}, 6) AS p, 1 - {phi_sql('z')} < 0.05 AS significant FROM (" + " UNION ALL ".join(_excess_sql(t) for t in (1, 10, 100)) + ")", SHARPE,
)
def _(df):
    m, found = sharpe_moments(df), []
    for t in (1, 10, 100):
        d = op.deflated_excess_of(F.col("sr"), t, F.col("n"), F.col("g"), F.col("k"))
        found.append(m.select("symbol", F.lit(t).alias("trials"), F.round(d["dsr"], 6).alias("dsr"), F.round(d["probability_by_chance"], 6).alias("p"), d["is_significant"].alias("significant")))
    return found[0].unionByName(found[1]).unionByName(found[2])


EVAL = "t AS (SELECT symbol, CAST(price > 50 AS INTEGER) AS label, CAST(size > 50 AS INTEGER) AS pred, (size + 0.5) / 100 AS p FROM ticks), m AS (SELECT symbol, count(*) AS n, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn, avg(CAST(label = pred AS INTEGER)) AS acc, avg(-CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END) AS ll FROM t GROUP BY 1)"


@book.add(
    "M12_evaluation", "ticks",
    "SELECT symbol, n, round(acc, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(ll, 6) AS log_loss FROM m", EVAL,
)
def _(df):
    t = df.select("symbol", (F.col("price") > 50).cast("int").alias("label"), (F.col("size") > 50).cast("int").alias("pred"), ((F.col("size") + 0.5) / 100).alias("p"))
    return rounded(op.confusion(t, "symbol"), "symbol", "n", **{c: c for c in ("accuracy", "precision", "recall", "f1", "log_loss")})


@book.add("M14_validate_strategy", "ticks")
def _(df):
    cv = op.cross_validate(op.logistic(FEATURES), table(df).drop("next_ret"), weights.purged_kfold(spans(df), 3))
    cv = materialise(cv, "folds")
    train, test = split(df)
    ret = F.when(F.col("p") > 0.5, F.col("next_ret")).otherwise(-F.col("next_ret"))
    r = op.scored(op.fit(op.logistic(FEATURES), train), test).agg(F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("sd"), F.count(ret).alias("n")).first()
    v = op.validate_strategy(cv, r["mean"] / r["sd"] if r["sd"] else 0.0, cv.count() + 1, r["n"])  # each fitted model is a trial
    return df.sparkSession.createDataFrame([(bool(v["passes"]), float(v["mean_accuracy"]), float(v["dsr"]))], "passes boolean, mean_accuracy double, dsr double")


@book.add("M15_orthogonal_features", "ticks")
def _(df):
    out, names = op.orthogonal(table(df), FEATURES)
    return out.select("symbol", "ts", *[F.round(F.abs(n), 6).alias(n) for n in names], F.round("explained_variance", 6).alias("explained_variance"))


@book.add("M16_feature_table", "brand")
def _(df):
    out, names = pipelines.feature_table(df)
    return rounded(out, "symbol", "ts", **{n: F.col(n).cast("double") for n in names})


@book.add("M17_research_pipeline", "ticks")
def _(df):
    bars = df.select("symbol", "ts", (100 + F.col("price")).alias("close"), (101 + F.col("price")).alias("high"), (99 + F.col("price")).alias("low"), (1 + F.col("size")).alias("volume"))
    p = pipelines.ResearchPipeline(least_bars=100).fit(bars)
    return p.result.test


@book.add("M18_meta_labelling", "brand")
def _(df):
    p = pipelines.MetaPipeline(trees=100, threshold=0.55).fit(df)
    return rounded(p.predict(df), "symbol", "ts", "side", "take", "action", p="p", size="size")


@book.add("C10_cross_validation", "ticks")
def _(df):
    return op.cross_validate(op.logistic(FEATURES), table(df).drop("next_ret"), weights.purged_kfold(spans(df), 3))
