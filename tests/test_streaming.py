"""State machines in event time, lazy training, callbacks and bounded runs."""

from __future__ import annotations

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.oracle import SF
from tidemark.catalog import streams
from tidemark.operators import learning
from tidemark.streaming import feed as fd
from tidemark.streaming import live
from tidemark.streaming import machines as m
from tidemark.streaming.engine import LiveEngine

TICKS = "symbol string, ts timestamp, price double, size double"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def ticks():
    rng = np.random.default_rng(7)
    secs = np.cumsum(rng.integers(1, 400, 300))
    secs[150:] += 30_000  # a silence
    return pd.DataFrame({"symbol": rng.choice(["A", "B"], 300), "ts": [START + dt.timedelta(seconds=int(s)) for s in secs], "price": 50 + rng.normal(size=300).cumsum(), "size": rng.integers(-1, 2, 300).astype(float)})


def run_in_batches(spark, ticks, machine, extra, parts):
    """Batches whose rows are out of order, each taken by a start of its own."""
    schema = spark.createDataFrame([], TICKS).schema
    feed = fd.Feed(spark, schema, "test")
    out = m.run_machine(live.event_time(feed.stream(), "2 hours"), machine, extra, slice_seconds=600)
    for part in parts:
        feed.put(spark.createDataFrame(part.sample(frac=1, random_state=1), schema).repartition(2))
        feed.drain(out)
    feed.close(out, ticks["ts"].max().to_pydatetime() + dt.timedelta(days=2))
    return feed.result(out.schema)


def test_order_within_and_between_batches(spark, ticks):
    """Rows of the end of one batch come with the next; all are taken in order of time."""
    swap = ticks.index.isin(range(90, 100))
    parts = [ticks[:100][~swap[:100]], pd.concat([ticks[100:200], ticks[swap]]), ticks[200:]]
    got = run_in_batches(spark, ticks, m.Cusum(0.02), "size", parts).collect()
    want = set()
    for s, g in ticks.groupby("symbol"):
        machine, held = m.Cusum(0.02), None
        for t, p in zip(g["ts"], g["price"], strict=True):
            held = machine.tick(held, t, p, 0.0, lambda at, e, s=s: want.add((s, at.to_pydatetime(), e)))
    assert want and {(r["symbol"], r["ts"], r["event"]) for r in got} == want and len(got) == len(want)


def test_positions_close_after_silence(spark, ticks):
    got = run_in_batches(spark, ticks, m.LivePosition(3600), "size", [ticks[:150], ticks[150:]]).orderBy("symbol", "ts").toPandas()
    want = []
    for s, g in ticks.groupby("symbol"):
        position = signals = trades = 0
        rows = list(g.itertuples(index=False))
        for row, after in zip(rows, [*rows[1:], None], strict=True):
            signals += 1
            if row.size:
                position, trades = int(row.size), trades + 1
            want.append((s, row.ts, ["PASS", "BUY", "SELL"][int(row.size)], position, signals, trades))
            if position and (after is None or after.ts - row.ts > pd.Timedelta(hours=1)):
                position = 0
                want.append((s, row.ts + pd.Timedelta(hours=1), "CLOSE", 0, signals, trades))
    have = list(got[["symbol", "ts", "action", "position", "signals", "trades"]].itertuples(index=False, name=None))
    assert have == want and sum(x[2] == "CLOSE" for x in want) >= 4


def test_a_restart_does_not_train_again(spark):
    engines = streams.engine_runs(spark, SF)
    assert [e.trained for e in engines] == [1, 0, 0]
    ticks = streams.engine_rows(streams.tick_view(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")))
    lo, hi = ticks.agg(F.min("ts"), F.max("ts")).first()
    model = learning.fit(learning.logistic(streams.FEATURES), ticks.where(F.col("ts") <= lo + (hi - lo) / 3))
    want = learning.scored(model, ticks).select("symbol", "ts", F.col("p").alias("q"))
    both = engines[-1].signals(spark).join(want, ["symbol", "ts"]).toPandas()
    assert len(both) == ticks.count() and np.allclose(both["p"], both["q"], atol=1e-6)
    assert (both["action"] == np.where(both["q"] >= 0.6, "BUY", np.where(both["q"] <= 0.4, "SELL", "PASS"))).all()


def test_summary_and_updates(spark):
    seen = []
    engines = streams.engine_runs(spark, SF, on_update=seen.append)
    s, rows = engines[-1].summary(spark).first(), engines[-1].signals(spark).toPandas()
    assert [u["batch"] for u in seen] == [0, 1, 2] and s["total"] == len(rows) == sum(u["BUY"] + u["SELL"] + u["PASS"] for u in seen)
    assert (s["buys"], s["sells"], s["passes"]) == tuple((rows["action"] == a).sum() for a in ("BUY", "SELL", "PASS"))
    last = rows.sort_values(["ts", "symbol"]).iloc[-1]
    assert (s["latest_action"], s["latest_price"]) == (last["action"], last["price"]) and abs(s["avg_confidence"] - rows["p"].mean()) < 1e-9


def test_too_few_rows_wait(spark, tmp_path):
    rows = spark.createDataFrame([("A", START, 1.0, 2.0, 3.0, 0.0, 1)], "symbol string, ts timestamp, price double, size double, hour double, cheap double, label int")
    e = LiveEngine(learning.logistic(streams.FEATURES), str(tmp_path / "e"))
    e.take(rows, 0)
    assert e.trained == 0 and e.signals(spark).count() == 0 and e.summary(spark).first()["total"] == 0


def test_bounded_run_and_progress(spark):
    """A run that would not end is stopped after its time, and the listener heard of every batch."""
    schema = spark.createDataFrame([], TICKS).schema
    feed = fd.Feed(spark, schema, "bounded")
    heard, ends = [], []
    listener = fd.Updates(heard.append, ends.append, name="bounded")
    spark.streams.addListener(listener)
    try:
        feed.put(spark.createDataFrame([("A", START, 1.0, 1.0)] * 7, schema))
        query = live.event_time(feed.stream()).writeStream.queryName("bounded").format("noop").option("checkpointLocation", feed.checkpoint).trigger(processingTime="1 second").start()
        assert fd.run_for(query, 6) is False and not query.isActive
        for _ in range(50):
            if ends:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sum(x["rows"] for x in heard) == 7 and ends == [None]
