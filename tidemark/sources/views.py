"""Series views over the star schema: bars, ticks and pairs with the columns (symbol, ts, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the order flow: one series."""
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    ).withColumn("symbol", F.lit("ALL"))


def ticks(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    """Trades: price and size by event type, or by another column as text."""
    return read(spark, sf_dir, "events").select(
        F.col(symbol).cast("string").alias("symbol"), "ts", F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("size"),
    )


def brand_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per brand: 25 series; the close is the middle of the day's range, which no order of rows changes."""
    line = read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).groupBy(F.col("p_brand").alias("symbol"), F.col("l_shipdate").alias("ts")).agg(
        ((F.max("p") + F.min("p")) / 2).alias("close"), F.max("p").alias("high"), F.min("p").alias("low"), F.sum("l_quantity").alias("volume"),
    )


#: The same views for the SQL checks, as common table expressions.
SQL = {
    "daily": """daily AS (
        SELECT 'ALL' AS symbol, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
               arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM orders GROUP BY o_orderdate)""",
    "ticks": """ticks AS (
        SELECT event_type AS symbol, ts, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size FROM events)""",
    "user_ticks": """user_ticks AS (
        SELECT CAST(user_id AS VARCHAR) AS symbol, ts, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size FROM events)""",
    "brand": """brand AS (
        SELECT p_brand AS symbol, l_shipdate AS ts, (max(l_extendedprice / l_quantity) + min(l_extendedprice / l_quantity)) / 2 AS close, max(l_extendedprice / l_quantity) AS high,
               min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS volume
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
}
