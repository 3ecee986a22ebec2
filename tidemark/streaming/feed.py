"""Streams that are started several times on one checkpoint: the folder that they read, the table that they append to, and how they end."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.market import shared_path
from .machines import state_store

#: Symbol of the rows that only move the watermark on.
HEARTBEAT = ""


class Feed:
    """A folder of batches in the order in which they were put there, read as a stream, and what the stream appends to.

    Each ``drain`` is a start of the query on the same checkpoint: it reads what came since the last one, and ends.
    """

    def __init__(self, spark: SparkSession, schema: StructType, name: str = "feed"):
        base = shared_path(spark, name)
        self.spark, self.schema = spark, schema
        self.inbox, self.table, self.checkpoint = (f"{base}/{x}" for x in ("inbox", "table", "checkpoint"))
        spark.createDataFrame([], schema).write.parquet(self.inbox)

    def put(self, batch: DataFrame) -> None:
        batch.select(self.schema.names).write.mode("append").parquet(self.inbox)

    def beat(self, at: dt.datetime) -> None:
        """A row whose time lets the watermark pass everything before. Its numbers are 0, not null, since filters may be applied before the watermark sees a row."""
        values = {"symbol": HEARTBEAT, "ts": at}
        row = [values.get(f.name, 0.0 if f.dataType.typeName() in ("double", "float") else 0 if f.dataType.typeName() in ("integer", "long") else None) for f in self.schema]
        self.put(self.spark.createDataFrame([tuple(row)], self.schema))

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.inbox)

    def drain(self, out: DataFrame) -> StreamingQuery:
        """Append ``out``, built on ``stream``, to the table until all that is there was read."""
        with state_store(self.spark):
            query = out.writeStream.format("parquet").option("path", self.table).option("checkpointLocation", self.checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    def close(self, out: DataFrame, at: dt.datetime) -> None:
        """Let the watermark pass everything before ``at`` and send what waited for that, in the batch without rows that follows."""
        self.beat(at)
        self.drain(out)

    def result(self, schema: StructType) -> DataFrame:
        """What was appended so far, without rows of heartbeats."""
        found = self.spark.read.schema(schema).parquet(self.table)
        return found.where(F.col("symbol") != HEARTBEAT) if "symbol" in schema.names else found


def closing_time(ticks: DataFrame, after: dt.timedelta) -> dt.datetime:
    """A time so long after the last tick (of now, where there is none)."""
    last = ticks.agg(F.max(F.col("ts").cast("timestamp_ntz"))).first()[0]
    return (last or dt.datetime(1970, 1, 2)) + after


def run_for(query: StreamingQuery, seconds: float) -> bool:
    """Let a query run for so long, then stop it; whether it ended by itself before."""
    done = query.awaitTermination(max(1, round(seconds)))
    if not done:
        query.stop()
    return bool(done)


class Updates(StreamingQueryListener):
    """Calls back on the progress of queries: ``on_update`` with batch id, input rows and rows a second of every batch, ``on_end`` with the error, or None."""

    def __init__(self, on_update: Callable[[dict], None], on_end: Callable[[str | None], None] | None = None, name: str | None = None):
        self.on_update, self.on_end, self.name, self.ours = on_update, on_end, name, set()

    def onQueryStarted(self, event) -> None:
        if self.name is None or event.name == self.name:
            self.ours.add(event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.runId in self.ours:
            self.on_update({"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "watermark": (p.eventTime or {}).get("watermark")})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId in self.ours and self.on_end:
            self.on_end(event.exception)
