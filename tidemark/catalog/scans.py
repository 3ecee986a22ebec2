"""Section 2.1: scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars
from ..sources import market as op
from ..sources.views import read
from .book import Book

book = Book()


@book.add("S1_history", "brand", "SELECT symbol, ts, close FROM brand WHERE symbol = 'Brand#11' AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-01-01'")
def _(df):
    return op.history(df, "Brand#11", "1996-01-01", "1996-12-31").select("symbol", "ts", "close")


@book.add("S2_quote", "brand", "SELECT symbol, max(ts) AS ts, arg_max(close, ts) AS close FROM brand GROUP BY 1")
def _(df):
    return op.quote(df.select("symbol", "ts", "close"))


@book.add("S3_newest_metrics", "brand", "SELECT symbol, ts, volume, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS INTEGER) AS rank FROM brand QUALIFY rank <= 4")
def _(df):
    return op.newest(df.select("symbol", "ts", "volume"), 4)


@book.add("S4_statements", None, "SELECT c_mktsegment AS symbol, n_name, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY balance DESC) <= 3")
def _(spark, sf_dir):
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    t = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_mktsegment").alias("symbol"), "n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return op.newest(t, 3, "balance").drop("rank")


@book.add("S5_dividends", "daily", "SELECT symbol, ts, round(close * 0.01, 6) AS amount FROM daily WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-01-01'")
def _(df):
    return op.history(df.select("symbol", "ts", F.round(F.col("close") * 0.01, 6).alias("amount")), "ALL", "1996-01-01", "1996-12-31")


@book.add("S6_optional_consensus", None, "SELECT n_name, s_name FROM nation LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON n_nationkey = s_nationkey")
def _(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.min("s_name").alias("s_name"))
    n = read(spark, sf_dir, "nation")
    return n.join(s, n["n_nationkey"] == s["s_nationkey"], "left").select("n_name", "s_name")


@book.add("S7_optional_profile", None, "SELECT n_name AS symbol, r_name AS sector FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def _(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region").where("r_regionkey < 3")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"], "left").select(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"))


@book.add("S8_news", None, "SELECT conv_id, turn, coalesce(text, '') AS summary FROM conversations ORDER BY conv_id, turn LIMIT 20")
def _(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("summary")).orderBy("conv_id", "turn").limit(20)


@book.add("S9_screen", "brand", "SELECT symbol, round(sum(volume), 2) AS volume FROM brand GROUP BY 1 ORDER BY volume DESC, symbol LIMIT 5")
def _(df):
    return op.screen(df.groupBy("symbol").agg(F.round(F.sum("volume"), 2).alias("volume")), "active", 5)


@book.add("S10_index_history", "daily", "SELECT symbol, ts, open, high, low, close FROM daily WHERE ts >= TIMESTAMP '1997-01-01'")
def _(df):
    return op.history(df, "ALL", "1997-01-01").select("symbol", "ts", "open", "high", "low", "close")


@book.add("S11_normalise", "brand", "SELECT symbol, ts, high, low, close, volume FROM brand")
def _(df):
    return op.normalise(df.select("symbol", F.col("ts").alias("Date"), F.col("high").alias("HIGH"), F.col("low").alias("Low"), F.col("close").alias("Adj Close"), F.col("volume").alias("Volume"), F.lit(1).alias("other"))).select("symbol", "ts", "high", "low", "close", "volume")


# A period's days as the data source's table has them, written out anew.
DAYS = {"1d": 1, "5d": 5, "1mo": 30, "3mo": 90, "6mo": 182, "1y": 365, "2y": 730, "3y": 3 * 365, "5y": 5 * 365, "10y": 10 * 365, "max": 30 * 365, "other": 365}


@book.add(
    "S13_period", "daily",
    "SELECT period, CAST(CASE WHEN period = 'ytd' THEN date_trunc('year', last) ELSE last - days * INTERVAL 1 DAY END AS DATE) AS start_date, last AS end_date FROM (SELECT CAST(max(ts) AS DATE) AS last FROM daily), (VALUES "
    + ", ".join(f"('{k}', {v})" for k, v in (DAYS | {"ytd": 0}).items()) + ") AS p(period, days)",
)
def _(df):
    last = df.agg(F.max("ts").cast("date").alias("last"))
    each = [F.struct(F.lit(name).alias("period"), op.period(name, F.col("last"))[0].alias("start_date"), F.col("last").alias("end_date")) for name in [*DAYS, "ytd"]]
    return last.select(F.inline(F.array(*each)))


@book.add("S15_cast_fields", None, "SELECT p_partkey, TRY_CAST(p_name AS DOUBLE) AS as_number, TRY_CAST(CAST(p_size AS VARCHAR) AS DOUBLE) AS size FROM part")
def _(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").try_cast("double").alias("as_number"), F.col("p_size").cast("string").try_cast("double").alias("size"))


@book.add("S18_dollar_volume", "brand", "SELECT symbol, ts, close * volume AS dollar_volume FROM brand")
def _(df):
    return df.select("symbol", "ts", (F.col("close") * F.col("volume")).alias("dollar_volume"))


@book.add("S20_csv_round_trip", "brand", "SELECT symbol, ts, high, low, close, volume FROM brand")
def _(df):
    path = op.shared_path(df.sparkSession, "bars-csv")
    op.write_bars(df.withColumnsRenamed({"ts": "date", "close": "Adj. Close", "high": "Day High"}), path, "csv")
    return op.read_csv(df.sparkSession, path).select("symbol", "ts", "high", "low", "close", "volume")


@book.add("S21_parquet_round_trip", "brand", "SELECT symbol, ts, high, low, close, volume FROM brand")
def _(df):
    path = op.shared_path(df.sparkSession, "bars")
    op.write_bars(df, path)
    return op.read_parquet(df.sparkSession, path).select("symbol", "ts", "high", "low", "close", "volume")


@book.add("S25_csv_per_symbol", "brand", "SELECT symbol, count(*) AS n, round(sum(volume), 2) AS volume, max(ts) AS ts FROM brand GROUP BY 1")
def _(df):
    path = op.shared_path(df.sparkSession, "bars-by-symbol")
    op.write_bars(df, path, "csv")
    back = df.sparkSession.read.option("header", True).schema("ts timestamp_ntz, close double, high double, low double, volume double, symbol string").csv(path)
    return back.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("volume"), 2).alias("volume"), F.max("ts").alias("ts"))


@book.add("S21_parquet_pushdown", "brand", "SELECT symbol, ts, close FROM brand WHERE symbol = 'Brand#11'")
def _(df):
    path = op.shared_path(df.sparkSession, "bars")
    op.write_bars(df, path)
    return op.read_parquet(df.sparkSession, path).where("symbol = 'Brand#11'").select("symbol", "ts", "close")


@book.add("S22_trades_to_bars", "ticks", "SELECT symbol, time_bucket(INTERVAL 60 MINUTE, ts) AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(size) AS volume FROM ticks WHERE symbol = (SELECT symbol FROM ticks GROUP BY 1 ORDER BY count(*) DESC, symbol LIMIT 1) GROUP BY 1, 2")
def _(df):
    return bars.time_bars(df.join(F.broadcast(bars.most_active(df).select("symbol")), "symbol"), "60 minutes")


@book.add("S24_synthetic_bars")
def _(spark, sf_dir):
    op.register(spark)
    return spark.read.format("synthetic_bars").option("n", 500).load()


LISTING = "SELECT p_name AS symbol, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS name, CASE WHEN p_size % 3 = 0 THEN 'EQUITY' ELSE 'OTHER' END AS kind FROM part"


LISTED = "SELECT *, ['EQUITY', 'etf', 'COMMODITY', 'FUTURE', 'INDEX', 'MUTUALFUND', 'CRYPTOCURRENCY', 'OPTION', 'CURRENCY'][1 + p_partkey % 9] AS kind, p_name || ['', '.L', '.NS', '.BO', '.PA', '.DE', '.TO', '.SS', '.SZ', '.HK', '.T'][1 + p_partkey % 11] AS symbol, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS name FROM part"


@book.add(
    "S28_search", None,
    "SELECT symbol, coalesce(name, symbol) AS name, kind, regexp_matches(symbol, '[.](L|NS|BO|PA|DE|TO|SS|SZ)$') AS delayed FROM (" + LISTED + ") WHERE upper(kind) NOT IN ('OPTION', 'CURRENCY') AND (contains(upper(symbol), 'BRAND#1') OR contains(upper(coalesce(name, '')), 'BRAND#1'))",
)
def _(spark, sf_dir):
    p, at = read(spark, sf_dir, "part"), lambda values, n: F.element_at(F.array(*[F.lit(x) for x in values]), (1 + F.col("p_partkey") % n).cast("int"))
    kind = at(["EQUITY", "etf", "COMMODITY", "FUTURE", "INDEX", "MUTUALFUND", "CRYPTOCURRENCY", "OPTION", "CURRENCY"], 9)
    suffix = at(["", ".L", ".NS", ".BO", ".PA", ".DE", ".TO", ".SS", ".SZ", ".HK", ".T"], 11)
    listing = p.select(F.concat("p_name", suffix).alias("symbol"), F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("name"), kind.alias("kind"))
    return op.search_symbols(listing, "brand#1")


NAMED = {
    "Apple": "AAPL", "microsoft": "MSFT", "Google": "GOOGL", "alphabet": "GOOGL", "amazon": "AMZN", "Tesla": "TSLA", "nvidia": "NVDA", "meta": "META", "FACEBOOK": "META", "netflix": "NFLX", "Disney": "DIS", "jpmorgan": "JPM",
    "JP Morgan": "JPM", " goldman sachs ": "GS", "berkshire": "BRK-B", "walmart": "WMT", "exxon": "XOM", "chevron": "CVX", "johnson": "JNJ", "Bank of America": "BAC", "wells fargo": "WFC", "coinbase": "COIN", "palantir": "PLTR",
    "amd": "AMD", "intel": "INTC", "salesforce": "CRM", "adobe": "ADBE", "paypal": "PYPL", "uber": "UBER", "airbnb": "ABNB", "spotify": "SPOT", "bitcoin": "BTC-USD", "ethereum": "ETH-USD", "gold": "GC=F", "oil": "CL=F",
    "spy": "SPY", "qqq": "QQQ", "iwm": "IWM", "tlt": "TLT", "BRK-B": "BRK-B", "brk.b": "BRK.B", "some other company": "SOME OTHER COMPANY",
}


@book.add("S29_resolve_ticker", None, "SELECT n_name AS query, upper(n_name) AS ticker FROM nation UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in NAMED.items()) + ")")
def _(spark, sf_dir):
    q = read(spark, sf_dir, "nation").select(F.col("n_name").alias("query")).unionByName(spark.createDataFrame([(x,) for x in NAMED], "query string"))
    return op.resolve_ticker(q)
