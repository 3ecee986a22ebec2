"""Sampled bars and bucketed order-flow measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series as s


def dollar_bars(df: DataFrame, threshold: float = 1e6, price: str = "price", size: str = "size") -> DataFrame:
    """Bars of about ``threshold`` traded value: bar = floor(running value / threshold), so a bar opens at the row that crosses; ids may skip.

    Rows of one time count as one. The running value is a decimal of ten places: one in doubles is a little off where it reaches a multiple of the threshold exactly.

    ``symbol, bar_id, ts`` (last), ``open, high, low, close, volume, dollar_volume``.
    """
    value = F.col(price) * F.col(size)
    total, step = F.sum(value.cast("decimal(28,10)")).over(s.by()), F.lit(repr(float(threshold))).cast("decimal(28,10)")
    df = df.withColumns({"__v": value, "__total": total})
    df = df.withColumn("bar_id", ((F.col("__total") - F.pmod("__total", step)) / step).cast("long")).drop("__total")  # a quotient of decimals would be rounded up
    return df.groupBy("symbol", "bar_id").agg(
        F.max("ts").alias("ts"), F.min_by(price, "ts").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, "ts").alias("close"),
        F.sum(size).alias("volume"), F.sum("__v").alias("dollar_volume"),
    )


def time_bars(df: DataFrame, width: str = "1 minute", price: str = "price", size: str = "size") -> DataFrame:
    """Open, high, low, close and volume per time window that has trades."""
    return df.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by(price, "ts").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, "ts").alias("close"), F.sum(size).alias("volume"),
    ).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def most_active(df: DataFrame) -> DataFrame:
    """The symbol with the most rows, the first by name among equals."""
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "symbol").limit(1)


def vpin(df: DataFrame, bucket_size: float = 50_000, n_buckets: int = 50, price: str = "price", size: str = "size") -> DataFrame:
    """Add ``vpin``: order-flow imbalance over the last n volume buckets, each bar with its bucket's value.

    Bars that rise are buys, bars that fall are sells, others count only in the total. Buckets are whole: bars early in one see its end.
    """
    df = df.withColumn("__d", s.change(price)).withColumn("bucket", F.floor(s.cumsum(size) / bucket_size))
    side = lambda up: F.coalesce(F.sum(F.when(F.col("__d") > 0 if up else F.col("__d") < 0, F.col(size))), F.lit(0.0))
    buckets = df.groupBy("symbol", "bucket").agg(F.abs(side(True) - side(False)).alias("imbalance"), F.sum(size).alias("total"))
    w = s.whole().orderBy("bucket").rowsBetween(1 - n_buckets, 0)
    v = F.when(F.count("total").over(w) == n_buckets, F.try_divide(F.sum("imbalance").over(w), F.sum("total").over(w)))
    return df.join(buckets.select("symbol", "bucket", v.alias("vpin")), ["symbol", "bucket"]).drop("__d")
