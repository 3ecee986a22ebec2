"""Section 2.7: signal generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signals as op
from .book import Book, rounded
from .windows import LAG, full, over

book = Book()


def bars(df):
    return df.select("symbol", "ts", F.col("price").alias("close"), F.col("size").alias("volume"))


CROSS = "CAST(coalesce(sign(signal - lag(signal) OVER (PARTITION BY symbol ORDER BY ts)), 0) AS INTEGER) AS crossover"


@book.add("G1_registry", "ticks", "SELECT unnest(['bollinger_breakout', 'macd_crossover', 'momentum_rotation', 'rsi_reversion', 'sma_crossover']) AS name")
def _(df):
    return df.sparkSession.createDataFrame([(n,) for n in op.models()], "name string")


RSI = (
    "RECURSIVE_MARKn AS (SELECT symbol, ts, row_number() OVER w AS i, coalesce(greatest(price - lag(price) OVER w, 0), 0) AS u, coalesce(greatest(lag(price) OVER w - price, 0), 0) AS d FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts)),"
    " f AS (SELECT symbol, ts, i, u AS a, d AS b, CAST(1 AS DOUBLE) AS w FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.ts, n.i, n.u + 13.0::DOUBLE / 14 * f.a, n.d + 13.0::DOUBLE / 14 * f.b, 1 + 13.0::DOUBLE / 14 * f.w FROM f JOIN n ON n.symbol = f.symbol AND n.i = f.i + 1),"
    " r AS (SELECT symbol, ts, CASE WHEN i >= 14 THEN 100 - 100 / (1 + a / w / greatest(b / w, 1e-10)) END AS rsi FROM f),"
    " y AS (SELECT symbol, ts, rsi, CAST(coalesce(last_value(CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS signal FROM r)"
)


@book.add("G2_rsi_reversion", "ticks", f"SELECT symbol, ts, round(rsi, 6) AS rsi, signal, {CROSS} FROM y WHERE rsi IS NOT NULL", RSI)
def _(df):
    return rounded(op.RsiReversion().signals(bars(df)), "symbol", "ts", "signal", "crossover", rsi="rsi")


BB = f"x AS (SELECT symbol, ts, price, round({full('avg', 'price', 20)}, 9) AS m, {full('stddev_samp', 'price', 20)} AS d FROM ticks), y AS (SELECT symbol, ts, m, CASE WHEN price > m + 1.5 * d THEN 1 WHEN price < m - 1.5 * d THEN -1 END AS a FROM x)"


@book.add(
    "G3_bollinger_breakout", "ticks",
    f"SELECT symbol, ts, round(m, 6) AS mid, signal, {CROSS} FROM (SELECT symbol, ts, m, CAST(coalesce(last_value(a IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS signal FROM y) WHERE m IS NOT NULL", BB,
)
def _(df):
    return rounded(op.BollingerBreakout(width=1.5).signals(bars(df)), "symbol", "ts", "signal", "crossover", mid="mid")


MACD = (
    "RECURSIVE_MARKn AS (SELECT symbol, ts, price, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM user_ticks),"
    " f AS (SELECT symbol, ts, i, price AS a, price AS b, CAST(0 AS DOUBLE) AS g FROM n WHERE i = 1 UNION ALL SELECT symbol, ts, i, a, b, 0.2 * (a - b) + 0.8 * g FROM"
    " (SELECT n.symbol, n.ts, n.i, 2.0 / 13 * n.price + 11.0 / 13 * f.a AS a, 2.0 / 27 * n.price + 25.0 / 27 * f.b AS b, f.g FROM f JOIN n ON n.symbol = f.symbol AND n.i = f.i + 1))"
)


@book.add("G4_macd", "user_ticks", "SELECT symbol, ts, round(a - b, 6) AS macd, round(g, 6) AS macd_signal FROM f", MACD)
def _(df):
    return rounded(op.MacdCrossover().signals(bars(df)), "symbol", "ts", macd="macd", macd_signal="macd_signal")


MOM = (
    "m AS (SELECT symbol, ts, price / nullif(lag(price, 10) OVER w, 0) - 1 AS s, price / nullif(lag(price, 50) OVER w, 0) - 1 AS l, size / nullif(" + full("avg", "size", 20) + ", 0) - 1 AS v FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts)),"
    f" x AS (SELECT symbol, ts, (0.6 * s / greatest({full('stddev_samp', 's', 50)}, 1e-10) + 0.4 * l / greatest({full('stddev_samp', 'l', 50)}, 1e-10)) * (1 + greatest(least(v, 0.5), -0.5)) AS score FROM m)"
)


@book.add("G5_momentum_rotation", "ticks", "SELECT symbol, ts, round(score, 6) AS score, CAST(sign(score) AS INTEGER) AS signal FROM x WHERE score IS NOT NULL", MOM)
def _(df):
    return rounded(op.MomentumRotation().signals(bars(df)), "symbol", "ts", "signal", score="score")


SMA = "x AS (SELECT symbol, ts, close, avg(close) OVER f AS fast, avg(close) OVER g AS slow, count(*) OVER g AS n FROM daily WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), g AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)), y AS (SELECT *, CASE WHEN fast > slow THEN 1 WHEN fast < slow THEN -1 ELSE 0 END AS signal FROM x WHERE n = 200)"


@book.add("G6_sma_crossover", "daily", f"SELECT symbol, ts, round(fast, 4) AS sma_fast, round(slow, 4) AS sma_slow, signal, {CROSS} FROM y", SMA)
def _(df):
    return rounded(op.SmaCrossover().signals(df), "symbol", "ts", "signal", "crossover", digits=4, sma_fast="sma_fast", sma_slow="sma_slow")


@book.add(
    "G6_sma_strategy", "daily",
    "SELECT symbol, count(*) AS n_bars, CAST(sum(CAST(signal = 1 AS INTEGER)) AS BIGINT) AS n_long, round(avg(p) / nullif(stddev_samp(p), 0) * sqrt(252.0), 6) AS sharpe FROM (SELECT *, lag(signal) OVER w * (close / lag(close) OVER w - 1) AS p FROM y WINDOW w AS (PARTITION BY symbol ORDER BY ts)) GROUP BY 1", SMA,
)
def flagship(df):
    """Average crossover on the daily bars: position of the bar before times return, annualised."""
    from ..functions import series as s
    from ..operators.metrics import sharpe

    out = op.SmaCrossover().signals(df).withColumn("p", s.lag("signal") * s.ret("close"))
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.sum((F.col("signal") == 1).cast("long")).alias("n_long"), F.round(sharpe("p"), 6).alias("sharpe"))


GRID_SMA = (
    "r AS (SELECT symbol, ts, " + ", ".join(f"{full('avg', 'price', w)} AS m{w}" for w in (5, 10, 20, 40)) + f", price / nullif({LAG.format(x='price')}, 0) - 1 AS ret FROM ticks),"
    " g AS (" + " UNION ALL ".join(f"SELECT symbol, {a} AS fast, {b} AS slow, lag(coalesce(CAST(m{a} > m{b} AS INTEGER), 0)) OVER (PARTITION BY symbol ORDER BY ts) * ret AS p FROM r" for a in (5, 10) for b in (20, 40)) + "),"
    " q AS (SELECT symbol, fast, slow, round(coalesce(avg(p) / nullif(stddev_samp(p), 0) * sqrt(252.0), 0), 6) AS sharpe FROM g GROUP BY 1, 2, 3)"
)


@book.add("G7_grid_sma", "ticks", "SELECT * FROM q", GRID_SMA)
def _(df):
    return rounded(op.grid_sma(bars(df), [5, 10], [20, 40]), "symbol", "fast", "slow", sharpe="sharpe")


@book.add("G7_best_sma", "ticks", "SELECT symbol, fast, slow, sharpe FROM q QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, fast, slow) = 1", GRID_SMA)
def _(df):
    return rounded(op.best(op.grid_sma(bars(df), [5, 10], [20, 40]), ["fast", "slow"]), "symbol", "fast", "slow", sharpe="sharpe")


GRID_BB = f"r AS (SELECT symbol, ts, price, price / nullif({LAG.format(x='price')}, 0) - 1 AS ret, {full('avg', 'price', 20)} AS m, {full('stddev_samp', 'price', 20)} AS d FROM ticks), g AS (" + " UNION ALL ".join(
    f"SELECT symbol, ts, ret, 20 AS period, {w}::DOUBLE AS width, CASE WHEN price < m - {w} * d THEN 1 WHEN price > m + {w} * d THEN 0 END AS a FROM r" for w in (1.0, 1.5)
) + "), h AS (SELECT *, coalesce(last_value(a IGNORE NULLS) OVER (PARTITION BY symbol, width ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS held FROM g), k AS (SELECT *, lag(held) OVER (PARTITION BY symbol, width ORDER BY ts) * ret AS p FROM h)"


@book.add("G7_grid_bollinger", "ticks", "SELECT symbol, period, width, round(coalesce(avg(p) / nullif(stddev_samp(p), 0) * sqrt(252.0), 0), 6) AS sharpe FROM k GROUP BY 1, 2, 3", GRID_BB)
def _(df):
    return rounded(op.grid_bollinger(bars(df), [20], [1.0, 1.5]), "symbol", "period", "width", sharpe="sharpe")


def _rsi(p: int) -> str:
    return f"CASE WHEN count(*) {over(p)} = {p} THEN 100 - 100 / nullif(1 + avg(greatest(d, 0)) {over(p)} / nullif(avg(greatest(-d, 0)) {over(p)}, 0), 0) END"


GRID_RSI = (
    f"c AS (SELECT symbol, ts, price / nullif({LAG.format(x='price')}, 0) - 1 AS ret, coalesce(price - {LAG.format(x='price')}, 0) AS d FROM ticks), r AS (SELECT *, {_rsi(7)} AS r7, {_rsi(14)} AS r14 FROM c), g AS ("
    + " UNION ALL ".join(f"SELECT symbol, ts, ret, {p} AS period, 30 AS low, {b} AS high, CASE WHEN r{p} < 30 THEN 1 WHEN r{p} > {b} THEN 0 END AS a FROM r" for p in (7, 14) for b in (60, 70))
    + "), h AS (SELECT *, coalesce(last_value(a IGNORE NULLS) OVER (PARTITION BY symbol, period, high ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS held FROM g), k AS (SELECT *, lag(held) OVER (PARTITION BY symbol, period, high ORDER BY ts) * ret AS p FROM h)"
)


@book.add("G7_grid_rsi", "ticks", "SELECT symbol, period, low, high, round(coalesce(avg(p) / nullif(stddev_samp(p), 0) * sqrt(252.0), 0), 6) AS sharpe FROM k GROUP BY 1, 2, 3, 4", GRID_RSI)
def _(df):
    return rounded(op.grid_rsi(bars(df), [7, 14], [30], [60, 70]), "symbol", "period", "low", "high", sharpe="sharpe")


def _last(signal: str, table: str, guard: str) -> str:
    return f"SELECT symbol, max(ts) AS ts, arg_max({signal}, ts) AS signal FROM {table} WHERE {guard} GROUP BY 1"


SCAN = (
    f"x AS (SELECT symbol, ts, close, {full('avg', 'close', 20)} AS m, {full('stddev_samp', 'close', 20)} AS d FROM brand),"
    " y AS (SELECT symbol, ts, m, coalesce(last_value(CASE WHEN close > m + 2 * d THEN 1 WHEN close < m - 2 * d THEN -1 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS signal FROM x),"
    " o AS (SELECT symbol, ts, close / nullif(lag(close, 10) OVER w, 0) - 1 AS s, close / nullif(lag(close, 50) OVER w, 0) - 1 AS l, volume / nullif(" + full("avg", "volume", 20) + ", 0) - 1 AS v FROM brand WINDOW w AS (PARTITION BY symbol ORDER BY ts)),"
    f" q AS (SELECT symbol, ts, sign((0.6 * s / greatest({full('stddev_samp', 's', 50)}, 1e-10) + 0.4 * l / greatest({full('stddev_samp', 'l', 50)}, 1e-10)) * (1 + greatest(least(v, 0.5), -0.5))) AS signal FROM o)"
)


@book.add("G9_scan_universe", "brand", f"SELECT symbol, max(ts) AS ts, avg(signal) AS score FROM ({_last('signal', 'y', 'm IS NOT NULL')} UNION ALL {_last('signal', 'q', 'signal IS NOT NULL')}) GROUP BY 1 ORDER BY abs(score) DESC, symbol LIMIT 10", SCAN)
def _(df):
    return op.scan_universe(df, ["bollinger_breakout", "momentum_rotation"])
