"""Section 2.13: the streaming operators over the tables; results equal the batch ones."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import learning
from ..sources.market import shared_path
from ..sources.views import ticks as tick_view
from ..streaming import live as op
from ..streaming import machines as m
from ..streaming.engine import LiveEngine
from ..streaming.feed import Feed, closing_time
from .book import SQL, Book

book = Book()


def stream(spark, sf_dir):
    raw = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("size"))


def collected(spark, df, mode="append"):
    """Run a bounded stream to its end into Parquet in the shared folder and read that; no row goes to the driver."""
    path, schema = shared_path(spark, "stream"), df.schema
    writer = df.writeStream.option("checkpointLocation", shared_path(spark, "stream-state")).outputMode(mode).trigger(availableNow=True)
    if mode == "complete":  # each batch has the whole table
        spark.createDataFrame([], schema).write.parquet(path)
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    else:
        writer = writer.format("parquet").option("path", path)
    writer.start().awaitTermination()
    return spark.read.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def appended(spark, sf_dir, build, batches=None):
    """Run ``build`` over a stream of ticks in append mode, and once more after a heartbeat, which closes what is still open.

    The stream is the events table itself, then ``batches`` (functions of the ticks), each with a start of its own.
    """
    ticks = tick_view(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    feed = Feed(spark, ticks.schema, "ticks")
    out = build(op.event_time(stream(spark, sf_dir).unionByName(feed.stream()) if batches is None else feed.stream()))
    for batch in batches or ():
        feed.put(batch(ticks))
        feed.drain(out)
    if batches is None:
        feed.drain(out)
    feed.close(out, closing_time(ticks, dt.timedelta(days=2)))
    return feed.result(out.schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


TICKS = "WITH " + SQL["ticks"]
BAR = "arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(size) AS volume"


def _windowed(name, run, sql):
    book.queries[name] = run
    book.sql[name] = f"{TICKS} {sql}"


_windowed(
    "T1_tumbling_bars", lambda spark, d: appended(spark, d, op.tumbling_bars).drop("until", "n"),
    f"SELECT symbol, time_bucket(INTERVAL 60 MINUTE, ts) AS ts, {BAR} FROM ticks GROUP BY 1, 2",
)
_windowed(
    "T1_sliding_bars", lambda spark, d: appended(spark, d, op.sliding_bars).withColumn("until", F.col("until").cast("timestamp_ntz")),
    f"SELECT symbol, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS ts, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE + INTERVAL 60 MINUTE AS until, {BAR.replace('arg_min(price, ts)', 'arg_min(price, t)').replace('arg_max(price, ts)', 'arg_max(price, t)')}, count(*) AS n"
    " FROM (SELECT *, ts AS t FROM ticks), range(4) r(k) GROUP BY 1, 2, 3",
)
_windowed(
    "T1_session_bars", lambda spark, d: appended(spark, d, lambda t: op.session_bars(t, "2 hours")).select("symbol", "ts", "open", "close", "n"),
    "SELECT symbol, min(ts) AS ts, arg_min(price, ts) AS open, arg_max(price, ts) AS close, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM ticks)) GROUP BY symbol, k",
)


def late_rows(ticks):
    """Changed copies of all ticks that lie more than a day before the last one."""
    return ticks.where(F.col("ts") < closing_time(ticks, -dt.timedelta(days=1))).withColumns({"price": F.col("price") * 1000 + 1, "size": F.col("size") + 1})


_windowed(
    "T1_late_and_repeated", lambda spark, d: appended(spark, d, lambda t: op.tumbling_bars(op.unique(t)), [lambda t: t.unionByName(t), late_rows]).drop("until"),
    f"SELECT symbol, time_bucket(INTERVAL 60 MINUTE, ts) AS ts, {BAR}, count(*) AS n FROM (SELECT DISTINCT symbol, ts, price, size FROM ticks) GROUP BY 1, 2",
)
_windowed(
    "T2_dollar_bars", lambda spark, d: appended(spark, d, lambda t: m.run_machine(t, m.DollarBars(20_000.0))).select("symbol", "bar_id", "ts", "open", "high", "low", "close", F.round("volume", 4).alias("volume")),
    "SELECT symbol, bar_id, ts, open, high, low, close, volume FROM (SELECT symbol, CAST(floor(cv / 20000.0) AS BIGINT) AS bar_id, max(ts) AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, round(sum(size), 4) AS volume FROM"
    " (SELECT *, sum(price * size) OVER (PARTITION BY symbol ORDER BY ts) AS cv FROM ticks) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_id DESC) > 1",
)
_windowed(
    "T2_cusum", lambda spark, d: appended(spark, d, lambda t: m.run_machine(t, m.Cusum(2.0))),
    """, RECURSIVE_PART placed AS (
        SELECT symbol, ts, price, lag(price) OVER (PARTITION BY symbol ORDER BY ts) AS before, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM ticks
    ), sums AS (
        SELECT symbol, i, ts, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down, 0 AS event FROM placed WHERE i = 1
        UNION ALL
        SELECT symbol, i, ts, CASE WHEN u > 2.0 THEN 0 ELSE u END, CASE WHEN u <= 2.0 AND d < -2.0 THEN 0 ELSE d END, CASE WHEN u > 2.0 THEN 1 WHEN d < -2.0 THEN -1 ELSE 0 END
        FROM (SELECT p.symbol, p.i, p.ts, CASE WHEN p.price > 0 AND p.before > 0 THEN greatest(0, up + ln(p.price / p.before)) ELSE up END AS u, CASE WHEN p.price > 0 AND p.before > 0 THEN least(0, down + ln(p.price / p.before)) ELSE down END AS d
              FROM sums s JOIN placed p ON p.symbol = s.symbol AND p.i = s.i + 1)
    ) SELECT symbol, ts, event FROM sums WHERE event <> 0""",
)
book.sql["T2_cusum"] = book.sql["T2_cusum"].replace("WITH", "WITH RECURSIVE", 1).replace("RECURSIVE_PART ", "").replace(" , placed", ", placed", 1)

WANT = "CASE WHEN size > 80 THEN 1 WHEN size < 20 THEN -1 ELSE 0 END"


def want():
    return F.when(F.col("size") > 80, 1).when(F.col("size") < 20, -1).otherwise(0)


_windowed(
    "T2_positions", lambda spark, d: appended(spark, d, lambda t: m.run_machine(t, m.Positions(), want())),
    f"""SELECT symbol, ts, price, signal, CAST(coalesce(held, 0) AS INTEGER) AS position, CAST(sum(CASE WHEN held IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS BIGINT) AS changes
        FROM (SELECT *, lag(held) OVER (PARTITION BY symbol ORDER BY ts) AS before
              FROM (SELECT *, last_value(nullif(signal, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS held FROM (SELECT symbol, ts, price, {WANT} AS signal FROM ticks)))""",
)


def third(k):
    """The k-th third, in time, of the ticks: a batch of its own."""

    def part(ticks):
        lo, hi = ticks.agg(F.min("ts"), F.max("ts")).first()
        if lo is None:
            return ticks
        cuts = [lo + (hi - lo) / 3, lo + 2 * (hi - lo) / 3]
        place = sum((F.col("ts") > c).cast("int") for c in cuts)
        return ticks.where(place == k)

    return part


#: A position without ticks for so long is closed, in seconds.
IDLE = 6 * 3600
_windowed(
    "F14_live_positions", lambda spark, d: appended(spark, d, lambda t: m.run_machine(t, m.LivePosition(IDLE), want()), [third(0), third(1), third(2)]),
    f"""SELECT symbol, ts, action, price, position, signals, trades FROM (
            WITH cut AS (
                SELECT symbol, ts, price, {WANT} AS want, lead(ts) OVER w AS next, sum(CASE WHEN ts - before <= INTERVAL {IDLE} SECOND THEN 0 ELSE 1 END) OVER w AS run
                FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM ticks) WINDOW w AS (PARTITION BY symbol ORDER BY ts)
            ), live AS (
                SELECT *, CAST(coalesce(last_value(nullif(want, 0) IGNORE NULLS) OVER (PARTITION BY symbol, run ORDER BY ts), 0) AS INTEGER) AS position,
                       CAST(count(*) OVER w AS BIGINT) AS signals, CAST(sum(abs(want)) OVER w AS BIGINT) AS trades
                FROM cut WINDOW w AS (PARTITION BY symbol ORDER BY ts)
            )
            SELECT symbol, ts, CASE want WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' ELSE 'PASS' END AS action, price, position, signals, trades FROM live
            UNION ALL
            SELECT symbol, ts + INTERVAL {IDLE} SECOND, 'CLOSE', price, 0, signals, trades FROM live WHERE position <> 0 AND (next IS NULL OR next - ts > INTERVAL {IDLE} SECOND)
        )""",
)

FEATURES = ["size", "hour", "cheap"]


def engine_rows(ticks):
    """Features of a tick alone, and for training whether its price is over 50 (which the features do not say)."""
    return ticks.select("symbol", "ts", "price", F.coalesce("size", F.lit(0.0)).alias("size"), F.hour("ts").cast("double").alias("hour"), (F.col("price") < 40).cast("double").alias("cheap"), (F.col("price") > 50).cast("int").alias("label"))


def engine_runs(spark, sf_dir, on_update=None):
    """An engine that sees the ticks in three starts on one checkpoint; the second and third are new objects."""
    ticks = tick_view(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    feed, path, engines = Feed(spark, ticks.schema, "engine"), shared_path(spark, "engine"), []
    for k in range(3):
        feed.put(third(k)(ticks))
        engines.append(LiveEngine(learning.logistic(FEATURES), path, threshold=0.6, on_update=on_update))
        engines[-1].start(engine_rows(feed.stream())).awaitTermination()
    return engines


@book.add("T3_lazy_training")
def _(spark, sf_dir):
    return engine_runs(spark, sf_dir)[-1].signals(spark).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "action", F.round("p", 6).alias("p"), "price", "batch")


_windowed(
    "T4_engine_updates",
    lambda spark, d: engine_runs(spark, d)[-1].signals(spark).groupBy("batch").agg(F.count(F.lit(1)).alias("signals"), F.max(F.col("ts").cast("timestamp_ntz")).alias("ts"), F.max_by("price", "ts").alias("price")),
    "SELECT CAST((ts > lo + (hi - lo) / 3)::INTEGER + (ts > lo + 2 * (hi - lo) / 3)::INTEGER AS BIGINT) AS batch, count(*) AS signals, max(ts) AS ts, arg_max(price, ts) AS price FROM ticks, (SELECT min(ts) AS lo, max(ts) AS hi FROM ticks) GROUP BY 1",
)
