"""Sample weights from overlapping labels, and cross-validation folds that respect them."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series as s
from .intervals import broadcast_if_small, concurrency, sums_over_life


def indicator(bars: DataFrame, spans: DataFrame) -> DataFrame:
    """The indicator matrix in long form: a row (symbol, ts, label_id) per bar of each span (symbol, label_id, i0, i1 as bar numbers)."""
    at = bars.select("symbol", "ts", s.position().alias("i"))
    return spans.where("i1 is not null").select("symbol", "label_id", F.explode(F.sequence("i0", "i1")).alias("i")).join(at, ["symbol", "i"]).select("symbol", "ts", "label_id")


def average_uniqueness(bars: DataFrame, spans: DataFrame) -> DataFrame:
    """Per span (symbol, t0, t1): ``avg_uniqueness``, the mean over its life of 1 / concurrency."""
    c = concurrency(bars, spans).withColumn("u", F.try_divide(F.lit(1.0), F.nullif(F.col("concurrency"), F.lit(0))))
    return sums_over_life(c, spans, "u").select("symbol", "t0", "t1", F.try_divide("total", "n").alias("avg_uniqueness"))


def weights_by_return(bars: DataFrame, spans: DataFrame, price: str = "close") -> DataFrame:
    """Per span: ``w_return``, the absolute sum of log returns over concurrency in its life, scaled to sum to the number of spans per symbol."""
    c = concurrency(bars, spans).join(bars.select("symbol", "ts", s.log_ret(price).alias("lr")), ["symbol", "ts"])
    c = c.withColumn("x", F.try_divide(F.col("lr"), F.nullif(F.col("concurrency"), F.lit(0))))
    w = sums_over_life(c, spans, "x").withColumn("w", F.abs("total"))
    return w.select("symbol", "t0", "t1", F.coalesce(F.try_divide(F.col("w") * F.count("w").over(s.whole()), F.sum("w").over(s.whole())), F.lit(1.0)).alias("w_return"))


def weights_by_decay(spans: DataFrame, factor: float = 1.0) -> DataFrame:
    """Per span: ``w_decay``, factor^(n - 1 - position) scaled to sum to n. A factor over 1 favours old spans."""
    order = s.whole().orderBy("t0")
    df = spans.withColumn("__n", F.count(F.lit(1)).over(s.whole())).withColumn("__w", F.pow(F.lit(float(factor)), F.col("__n") - F.row_number().over(order)))
    return df.select("symbol", "t0", "t1", (F.col("__w") * F.col("__n") / F.sum("__w").over(s.whole())).alias("w_decay"))


def combined_weights(bars: DataFrame, spans: DataFrame, price: str = "close", factor: float = 1.0) -> DataFrame:
    """Product of both weights, scaled to sum to n."""
    both = weights_by_return(bars, spans, price).join(weights_by_decay(spans, factor), ["symbol", "t0", "t1"]).withColumn("__w", F.col("w_return") * F.col("w_decay"))
    return both.select("symbol", "t0", "t1", "w_return", "w_decay", F.try_divide(F.col("__w") * F.count("__w").over(s.whole()), F.sum("__w").over(s.whole())).alias("w"))


def _folds(spans: DataFrame, k: int) -> DataFrame:
    n = F.count(F.lit(1)).over(s.whole())
    return spans.withColumn("__i", F.row_number().over(s.whole().orderBy("t0")) - 1).withColumn("__n", n).withColumn("__f", F.least(F.floor(F.col("__i") / F.floor(n / k)), F.lit(k - 1)).cast("int"))


def purged_kfold(spans: DataFrame, k: int = 5, embargo: float = 0.0) -> DataFrame:
    """Rows (symbol, fold, t0, role) of k contiguous folds; train rows whose span meets the test span are purged, and with ``embargo`` also the share of rows right after it."""
    df = _folds(spans, k)
    test = df.groupBy("symbol", F.col("__f").alias("fold")).agg(F.min("t0").alias("s"), F.max(F.coalesce("t1", "t0")).alias("e"), F.max("__i").alias("last"))
    both = df.join(broadcast_if_small(test), "symbol")
    role = F.when(F.col("__f") == F.col("fold"), "test").when(
        ~((F.coalesce("t1", "t0") < F.col("s")) | (F.col("t0") > F.col("e"))) | ((F.col("__i") > F.col("last")) & (F.col("__i") <= F.col("last") + F.floor(F.col("__n") * embargo))), None
    ).otherwise("train")
    return both.select("symbol", "fold", "t0", role.alias("role")).where("role is not null")


def combinatorial_purged(spans: DataFrame, n_groups: int = 10, k: int = 2, purge: str = "span") -> DataFrame:
    """Rows (symbol, split, t0, role) of all choices of k test groups. ``span`` purges train rows that meet the hull of the test rows, ``block`` only those that meet a test group's own span."""
    df = _folds(spans, n_groups)
    groups = df.groupBy("symbol", F.col("__f").alias("g")).agg(F.min("t0").alias("s"), F.max(F.coalesce("t1", "t0")).alias("e"))
    choices = spans.sparkSession.createDataFrame([(i, list(c)) for i, c in enumerate(itertools.combinations(range(n_groups), k))], "split int, chosen array<int>")
    test = groups.join(F.broadcast(choices), F.array_contains("chosen", F.col("g"))).groupBy("symbol", "split", "chosen").agg(F.collect_list(F.struct("s", "e")).alias("blocks"), F.min("s").alias("lo"), F.max("e").alias("hi"))
    both = df.join(broadcast_if_small(test), "symbol")
    t1 = F.coalesce("t1", "t0")
    meets = ~((t1 < F.col("lo")) | (F.col("t0") > F.col("hi"))) if purge == "span" else F.exists("blocks", lambda b: ~((t1 < b["s"]) | (F.col("t0") > b["e"])))
    role = F.when(F.array_contains("chosen", F.col("__f")), "test").when(meets, None).otherwise("train")
    return both.select("symbol", "split", "t0", role.alias("role")).where("role is not null")


def forward_kfold(bars: DataFrame, k: int = 5, purge: int = 0, embargo: float = 0.0) -> DataFrame:
    """Rows (symbol, fold, ts, role) where train rows end ``purge`` rows and an embargo (a share of the test start) before the test fold; the first fold has none and is left out."""
    df = bars.withColumn("__i", s.position()).withColumn("__n", F.count(F.lit(1)).over(s.whole()))
    df = df.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k - 1)))).withColumn("__size", F.floor(F.col("__n") / k)).withColumn("__lo", F.col("fold") * F.col("__size"))
    hi = F.when(F.col("fold") == k - 1, F.col("__n")).otherwise(F.col("__lo") + F.col("__size"))
    role = F.when((F.col("__i") >= F.col("__lo")) & (F.col("__i") < hi), "test").when(F.col("__i") < F.col("__lo") - purge - F.floor(F.col("__lo") * embargo), "train")
    return df.select("symbol", "fold", "ts", role.alias("role")).where("role is not null")


def temporal_split(bars: DataFrame, share: float = 0.8) -> DataFrame:
    """Add ``role``: the first share of each series trains."""
    n = F.count(F.lit(1)).over(s.whole())
    return bars.withColumn("role", F.when(s.position() < F.floor(n * share), "train").otherwise("test"))


def parts_in_time(df: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The train and test rows of ``temporal_split``, by the time at which a series' test rows begin: only symbols and times are sorted, not whole rows. Rows of one time stay together, as test rows where they are cut."""
    at = df.select("symbol", "ts").withColumns({"__i": s.position(), "__n": F.count(F.lit(1)).over(s.whole())})
    cut = at.where(F.col("__i") == F.floor(F.col("__n") * share)).select("symbol", F.col("ts").alias("__cut"))
    both = df.join(broadcast_if_small(cut), "symbol")
    return both.where("ts < __cut").drop("__cut"), both.where("ts >= __cut").drop("__cut")
