"""Section 2.3: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series as s
from ..operators import intervals, running
from ..sources.views import read, ticks
from .book import Book, rounded

book = Book()
HALVES = "a AS (SELECT symbol, ts, price FROM ticks WHERE size >= 20), b AS (SELECT symbol, ts, size FROM ticks WHERE size <= 80)"


def halves(df):
    return df.where("size >= 20").select("symbol", "ts", "price"), df.where("size <= 80").select("symbol", "ts", "size")


@book.add("J1_index_join", "ticks", "SELECT symbol, ts, price, size FROM a JOIN b USING (symbol, ts)", HALVES)
def _(df):
    a, b = halves(df)
    return a.join(b, ["symbol", "ts"])


@book.add("J2_align_pair", "brand", "SELECT a.ts, a.close AS s1, b.close AS s2 FROM brand a JOIN brand b USING (ts) WHERE a.symbol = 'Brand#11' AND b.symbol = 'Brand#12'")
def _(df):
    a, b = (df.where(F.col("symbol") == x).select("ts", F.col("close").alias(c)) for x, c in (("Brand#11", "s1"), ("Brand#12", "s2")))
    return a.join(b, "ts", "full").na.drop().select("ts", "s1", "s2")


@book.add("J3_reindex", "ticks", "SELECT symbol, ts, price, size FROM a LEFT JOIN b USING (symbol, ts)", HALVES)
def _(df):
    a, b = halves(df)
    return a.join(b, ["symbol", "ts"], "left")


@book.add("J4_reindex_fill", "ticks", "SELECT symbol, ts, price, coalesce(size, 0) AS size FROM a LEFT JOIN b USING (symbol, ts)", HALVES)
def _(df):
    a, b = halves(df)
    return a.join(b, ["symbol", "ts"], "left").withColumn("size", F.coalesce("size", F.lit(0.0)))


@book.add("J5_column_concat", "ticks", "SELECT symbol, ts, price, size FROM a FULL JOIN b USING (symbol, ts)", HALVES)
def _(df):
    a, b = halves(df)
    return a.join(b, ["symbol", "ts"], "full")


SPANS = "b AS (SELECT symbol, ts AS t0, lead(ts, 20) OVER (PARTITION BY symbol ORDER BY ts) AS t1 FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts) % 7 = 1)"


@book.add("J6_interval_join", "ticks", "SELECT t.symbol, t.ts, count(b.t0) AS active FROM ticks t LEFT JOIN b ON t.symbol = b.symbol AND b.t1 IS NOT NULL AND t.ts BETWEEN b.t0 AND b.t1 GROUP BY 1, 2", "b AS (SELECT symbol, t0, t1 FROM (SELECT symbol, ts AS t0, lead(ts, 20) OVER (PARTITION BY symbol ORDER BY ts) AS t1, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM ticks))")
def _(df):
    spans = df.withColumn("t1", F.lead("ts", 20).over(s.by())).select("symbol", F.col("ts").alias("t0"), "t1")
    return intervals.concurrency(df.select("symbol", "ts"), spans).select("symbol", "ts", F.col("concurrency").alias("active"))


@book.add(
    "J7_overlap_anti_join", "ticks",
    "SELECT symbol, t0, t1 FROM l WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.symbol = l.symbol AND NOT (l.t1 < f.s OR l.t0 > f.e))",
    "l AS (SELECT symbol, ts AS t0, lead(ts, 5) OVER (PARTITION BY symbol ORDER BY ts) AS t1, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM ticks), f AS (SELECT symbol, min(t0) AS s, max(t0) AS e FROM l WHERE i BETWEEN 100 AND 150 GROUP BY symbol)",
)
def _(df):
    l = df.withColumn("t1", F.lead("ts", 5).over(s.by())).withColumn("i", s.position() + 1).select("symbol", F.col("ts").alias("t0"), "t1", "i")  # noqa: E741
    spans = l.where("i BETWEEN 100 AND 150").groupBy("symbol").agg(F.min("t0").alias("s"), F.max("t0").alias("e"))
    return intervals.without_overlap(l, spans).select("symbol", "t0", "t1")


@book.add("J8_lookup", None, "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf_dir):
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@book.add("J9_parameter_grid", "ticks", "SELECT symbol, p.lo, p.hi, count(*) AS n FROM ticks, (SELECT unnest([10, 20, 30]) AS lo) a, LATERAL (SELECT a.lo AS lo, unnest([60, 80]) AS hi) p WHERE size BETWEEN p.lo AND p.hi GROUP BY 1, 2, 3")
def _(df):
    grid = df.sparkSession.createDataFrame([(a, b) for a in (10, 20, 30) for b in (60, 80)], "lo int, hi int")
    return df.crossJoin(F.broadcast(grid)).where("size BETWEEN lo AND hi").groupBy("symbol", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))


@book.add(
    "J10_bucket_lookup", "ticks",
    "SELECT symbol, ts, bucket, round(bucket_size, 6) AS bucket_size FROM (SELECT *, sum(size) OVER (PARTITION BY symbol, bucket) AS bucket_size FROM (SELECT *, CAST(floor(sum(size) OVER (PARTITION BY symbol ORDER BY ts) / 1000) AS BIGINT) AS bucket FROM ticks))",
)
def _(df):
    df = df.withColumn("bucket", F.floor(s.cumsum("size") / 1000))
    sizes = df.groupBy("symbol", "bucket").agg(F.sum("size").alias("bucket_size"))
    return rounded(df.join(sizes, ["symbol", "bucket"]), "symbol", "ts", "bucket", bucket_size="bucket_size")


@book.add(
    "U5_asof_join", "ticks",
    "SELECT a.symbol, a.ts, a.price, b.ts AS since, b.price AS price_asof, b.size FROM (SELECT symbol, ts, price FROM ticks) a ASOF LEFT JOIN (SELECT symbol, ts, price, size FROM ticks WHERE size >= 90) b ON a.symbol = b.symbol AND a.ts > b.ts",
)
def _(df):
    large = df.where("size >= 90").select("symbol", "ts", F.col("ts").alias("since"), "price", "size")
    return running.asof_join(df.select("symbol", "ts", "price"), large, strict=True)


@book.add(
    "U5_extra_features", None,
    "WITH shifted AS (SELECT o_orderdate + to_days(CAST(date_diff('day', lo, hi) AS INTEGER)) AS ts, sum(o_totalprice) AS value FROM orders, (SELECT min(o_orderdate) AS lo, (SELECT min(ts) FROM events) AS hi FROM orders) GROUP BY 1)"
    " SELECT event_type AS symbol, e.ts, e.value AS price, CASE WHEN s.ts >= e.ts - INTERVAL 18 HOUR THEN round(s.value, 4) END AS value FROM events e ASOF LEFT JOIN shifted s ON e.ts >= s.ts",
)
def _(spark, sf_dir):
    t, orders = ticks(spark, sf_dir).select("symbol", "ts", "price"), read(spark, sf_dir, "orders")
    moved = orders.crossJoin(F.broadcast(orders.agg(F.min("o_orderdate").alias("lo")))).crossJoin(F.broadcast(t.agg(F.min("ts").alias("hi"))))  # one row each
    day = moved.groupBy((F.col("o_orderdate") + F.make_dt_interval(F.datediff("hi", "lo"))).alias("ts")).agg(F.round(F.sum("o_totalprice"), 4).alias("value"))
    return running.asof_join(t.withColumn("all", F.lit("ALL")), day.withColumn("all", F.lit("ALL")), ["value"], within="18 HOURS", key="all").drop("all")
