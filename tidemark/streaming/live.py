"""Windowed bars of a stream, with watermarks and without duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .machines import Cusum


def event_time(df: DataFrame, late: str = "10 minutes") -> DataFrame:
    """ts as an instant with a watermark; rows later than that are dropped by windowed aggregates."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def unique(trades: DataFrame, *key: str) -> DataFrame:
    """Trades of a stream with a watermark, one of those that agree in ``key`` (symbol, ts, price and size by default). Keys are forgotten once the watermark has passed them; later copies are late rows then, and dropped."""
    return trades.dropDuplicatesWithinWatermark(list(key) or ["symbol", "ts", "price", "size"])


def _ohlcv(df: DataFrame, window: object) -> DataFrame:
    return df.groupBy("symbol", window.alias("w")).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n"),
    ).select("symbol", F.col("w.start").alias("ts"), F.col("w.end").alias("until"), "open", "high", "low", "close", "volume", "n")


def tumbling_bars(trades: DataFrame, width: str = "1 hour") -> DataFrame:
    return _ohlcv(trades, F.window("ts", width))


def sliding_bars(trades: DataFrame, width: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    return _ohlcv(trades, F.window("ts", width, step))


def session_bars(trades: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return _ohlcv(trades, F.session_window("ts", gap))


EVENTS = "symbol string, ts timestamp, event int"


def cusum(trades: DataFrame, threshold: float) -> DataFrame:
    """CUSUM events on log returns of a stream whose micro-batches come in order of time, with both sums and the last price as state per symbol.

    A symbol's rows of one micro-batch are sorted at once. ``machines.run_machine`` with ``Cusum`` takes rows in any order and holds one slice of time only.
    """
    step = Cusum(threshold)

    def walk(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = state.get if state.exists else None, []
        for ts, p in sorted((ts, p) for part in parts for ts, p in zip(part["ts"], part["price"], strict=True)):
            held = step.tick(held, ts, p, 0.0, lambda at, event: out.append((key[0], at, event)))
        state.update(held)
        yield pd.DataFrame(out, columns=["symbol", "ts", "event"])

    return trades.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "price").groupBy("symbol").applyInPandasWithState(walk, EVENTS, step.state, "append", GroupStateTimeout.NoTimeout)


def start(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run a stream with a callback per batch: all that is there and then an end, or a batch ``every`` so often until stopped."""
    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
