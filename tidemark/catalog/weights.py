"""Section 2.8: sample weights, concurrency, cross-validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series as s
from ..operators import intervals
from ..operators import weights as op
from .book import Book, rounded

book = Book()
SPANS = (
    "b AS (SELECT symbol, ts, price AS close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, ln(price / nullif(lag(price) OVER (PARTITION BY symbol ORDER BY ts), 0)) AS lr, lead(ts, 10) OVER (PARTITION BY symbol ORDER BY ts) AS e FROM ticks),"
    " l AS (SELECT symbol, ts AS t0, e AS t1, i FROM b WHERE e IS NOT NULL),"
    " c AS (SELECT b.symbol, b.ts, any_value(lr) AS lr, count(l.t0) AS concurrency FROM b LEFT JOIN l ON b.symbol = l.symbol AND b.ts BETWEEN l.t0 AND l.t1 GROUP BY 1, 2)"
)


def spans(df):
    at = df.withColumn("i", s.position()).withColumn("t1", F.lead("ts", 10).over(s.by()))
    return at.where("t1 IS NOT NULL").select("symbol", F.col("ts").alias("t0"), "t1", "i")


def bars(df):
    return df.select("symbol", "ts", F.col("price").alias("close"))


@book.add("C1_indicator", "ticks", "SELECT b.symbol, b.ts, CAST(l.i AS INTEGER) AS label_id FROM b JOIN l ON b.symbol = l.symbol AND b.ts BETWEEN l.t0 AND l.t1", SPANS)
def _(df):
    return op.indicator(bars(df), spans(df).select("symbol", F.col("i").alias("label_id"), F.col("i").alias("i0"), (F.col("i") + 10).alias("i1")))


@book.add("C2_concurrency", "ticks", "SELECT symbol, ts, concurrency FROM c", SPANS)
def _(df):
    return intervals.concurrency(bars(df), spans(df))


@book.add("C3_average_uniqueness", "ticks", "SELECT l.symbol, l.t0, l.t1, round(avg(1.0 / nullif(c.concurrency, 0)), 6) AS avg_uniqueness FROM l JOIN c ON l.symbol = c.symbol AND c.ts BETWEEN l.t0 AND l.t1 GROUP BY 1, 2, 3", SPANS)
def _(df):
    return rounded(op.average_uniqueness(bars(df), spans(df)), "symbol", "t0", "t1", avg_uniqueness="avg_uniqueness")


WR = ", wr AS (SELECT symbol, t0, t1, w * count(*) OVER (PARTITION BY symbol) / sum(w) OVER (PARTITION BY symbol) AS w_return FROM (SELECT l.symbol, l.t0, l.t1, abs(sum(c.lr / nullif(c.concurrency, 0))) AS w FROM l JOIN c ON l.symbol = c.symbol AND c.ts BETWEEN l.t0 AND l.t1 GROUP BY 1, 2, 3))"
WD = ", wd AS (SELECT symbol, t0, t1, w * n / sum(w) OVER (PARTITION BY symbol) AS w_decay FROM (SELECT *, power(0.999, n - k) AS w FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY t0) AS k FROM l)))"


@book.add("C4_weights_by_return", "ticks", "SELECT symbol, t0, t1, round(w_return, 6) AS w_return FROM wr", SPANS + WR)
def _(df):
    return rounded(op.weights_by_return(bars(df), spans(df)), "symbol", "t0", "t1", w_return="w_return")


@book.add("C5_weights_by_decay", "ticks", "SELECT symbol, t0, t1, round(w_decay, 6) AS w_decay FROM wd", SPANS + WD)
def _(df):
    return rounded(op.weights_by_decay(spans(df), 0.999), "symbol", "t0", "t1", w_decay="w_decay")


@book.add("C6_combined_weights", "ticks", "SELECT symbol, t0, t1, round(w_return, 6) AS w_return, round(w_decay, 6) AS w_decay, round(w_return * w_decay * count(*) OVER (PARTITION BY symbol) / sum(w_return * w_decay) OVER (PARTITION BY symbol), 6) AS w FROM wr JOIN wd USING (symbol, t0, t1)", SPANS + WR + WD)
def _(df):
    return rounded(op.combined_weights(bars(df), spans(df), factor=0.999), "symbol", "t0", "t1", w_return="w_return", w_decay="w_decay", w="w")


def _fold_sql(k: int) -> str:
    return f", f AS (SELECT symbol, t0, t1, CAST(least(floor(k / floor(n / {k}.0)), {k - 1}) AS INTEGER) AS f FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t0) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM l)), g AS (SELECT symbol, f AS fold, min(t0) AS s, max(t1) AS e FROM f GROUP BY 1, 2)"


@book.add(
    "C7_purged_kfold", "ticks",
    "SELECT * FROM (SELECT f.symbol, g.fold, f.t0, CASE WHEN f.f = g.fold THEN 'test' WHEN NOT (f.t1 < g.s OR f.t0 > g.e) THEN NULL ELSE 'train' END AS role FROM f JOIN g USING (symbol)) WHERE role IS NOT NULL", SPANS + _fold_sql(5),
)
def _(df):
    return op.purged_kfold(spans(df))


@book.add(
    "C8_combinatorial_purged", "ticks",
    "SELECT * FROM (SELECT f.symbol, t.split, f.t0, CASE WHEN f.f IN (t.a, t.b) THEN 'test' WHEN NOT (f.t1 < t.lo OR f.t0 > t.hi) THEN NULL ELSE 'train' END AS role FROM f JOIN t USING (symbol)) WHERE role IS NOT NULL",
    SPANS + _fold_sql(6) + ", t AS (SELECT x.symbol, CAST(row_number() OVER (PARTITION BY x.symbol ORDER BY x.fold, y.fold) - 1 AS INTEGER) AS split, x.fold AS a, y.fold AS b, least(x.s, y.s) AS lo, greatest(x.e, y.e) AS hi FROM g x JOIN g y ON x.symbol = y.symbol AND x.fold < y.fold)",
)
def _(df):
    return op.combinatorial_purged(spans(df), 6, 2)


@book.add(
    "C9_forward_kfold", "ticks",
    "SELECT * FROM (SELECT symbol, CAST(fold AS INTEGER) AS fold, ts, CASE WHEN i >= lo AND i < CASE WHEN fold = 4 THEN n ELSE lo + sz END THEN 'test' WHEN i < lo - 3 - floor(lo * 0.01) THEN 'train' END AS role FROM"
    " (SELECT *, floor(n / 5) AS sz, fold * floor(n / 5) AS lo FROM (SELECT symbol, ts, i, count(*) OVER (PARTITION BY symbol) AS n FROM b), (SELECT unnest([1, 2, 3, 4]) AS fold))) WHERE role IS NOT NULL", SPANS,
)
def _(df):
    return op.forward_kfold(bars(df), 5, 3, 0.01)


@book.add("C11_temporal_split", "ticks", "SELECT symbol, ts, CASE WHEN i < floor(n * 0.8) THEN 'train' ELSE 'test' END AS role FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM b)", SPANS)
def _(df):
    return op.temporal_split(df.select("symbol", "ts"))
