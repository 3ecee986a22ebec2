"""Market data access: column normalising, tables by symbol and period, CSV and trade files, and a batch data source for bars."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

# Days of the period names (the year to date has as many as have passed), company names with their tickers, kinds of listings, and suffixes of exchanges whose quotes are delayed.
PERIOD_DAYS = {"1d": 1, "5d": 5, "1mo": 30, "3mo": 90, "6mo": 182, "1y": 365, "2y": 730, "3y": 1095, "5y": 1825, "10y": 3650, "max": 10950}
TICKERS = {
    "apple": "AAPL", "microsoft": "MSFT", "google": "GOOGL", "alphabet": "GOOGL", "amazon": "AMZN", "tesla": "TSLA", "nvidia": "NVDA", "meta": "META", "facebook": "META", "netflix": "NFLX", "disney": "DIS",
    "jpmorgan": "JPM", "jp morgan": "JPM", "goldman sachs": "GS", "berkshire": "BRK-B", "walmart": "WMT", "exxon": "XOM", "chevron": "CVX", "johnson": "JNJ", "bank of america": "BAC", "wells fargo": "WFC",
    "coinbase": "COIN", "palantir": "PLTR", "amd": "AMD", "intel": "INTC", "salesforce": "CRM", "adobe": "ADBE", "paypal": "PYPL", "uber": "UBER", "airbnb": "ABNB", "spotify": "SPOT",
    "bitcoin": "BTC-USD", "ethereum": "ETH-USD", "gold": "GC=F", "oil": "CL=F", "spy": "SPY", "qqq": "QQQ", "iwm": "IWM", "tlt": "TLT",
}
KINDS = ("EQUITY", "ETF", "COMMODITY", "FUTURE", "INDEX", "MUTUALFUND", "CRYPTOCURRENCY")
DELAYED = (".L", ".NS", ".BO", ".PA", ".DE", ".TO", ".SS", ".SZ")
OHLCV = ("open", "high", "low", "close", "volume")


def normalise(df: DataFrame, ts_col: str = "date") -> DataFrame:
    """Columns named like open, high, low, close or volume in any case (an adjusted close counts as close only where there is no other), with ``ts`` as a timestamp; others go."""
    by_name = {c.lower().replace(" ", "_"): c for c in df.columns}
    found = {k: by_name[k] for k in OHLCV if k in by_name}
    if "close" not in found and "adj_close" in by_name:
        found["close"] = by_name["adj_close"]
    if "close" not in found:
        raise ValueError("there is no close column")
    keep = [by_name["symbol"]] if "symbol" in by_name else []
    return df.select(*[F.col(c).alias("symbol") for c in keep], F.to_timestamp_ntz(F.col(by_name[ts_col.lower()]).cast("string")).alias("ts"), *[F.col(v).cast("double").alias(k) for k, v in found.items()])


def period(name: str, end: Column | None = None) -> tuple[Column, Column]:
    """Start and end dates of a period name, ``ytd`` from the first of January; an unknown one is a year."""
    last = end if end is not None else F.current_date()
    return (F.trunc(last, "year") if name == "ytd" else F.date_sub(last, PERIOD_DAYS.get(name, 365))), last


def history(bars: DataFrame, symbol: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a symbol between two dates, both included; raises if there are none. The conditions reach the scan."""
    out = bars.where(F.col("symbol") == symbol)
    if start:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out.where(F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    if out.limit(1).count() == 0:
        raise ValueError(f"no bars for {symbol}")
    return out


def quote(bars: DataFrame) -> DataFrame:
    """The last bar of each symbol."""
    fields = [c for c in bars.columns if c != "symbol"]
    return bars.groupBy("symbol").agg(F.max_by(F.struct(*fields), "ts").alias("q")).select("symbol", "q.*")


def newest(df: DataFrame, k: int, ts_col: str = "ts") -> DataFrame:
    """The k newest rows of each symbol (statements, metrics, news), newest first."""
    w = Window.partitionBy("symbol").orderBy(F.desc(ts_col))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


SCREENS = {
    "gainers": lambda df: df.orderBy(F.desc("change"), "symbol"), "losers": lambda df: df.orderBy("change", "symbol"), "active": lambda df: df.orderBy(F.desc("volume"), "symbol"),
    "undervalued": lambda df: df.where("pe > 0").orderBy("pe", "symbol"), "growth": lambda df: df.orderBy(F.desc("growth"), "symbol"),
}


def screen(df: DataFrame, name: str, k: int = 25) -> DataFrame:
    if name not in SCREENS:
        raise ValueError(f"no screen {name!r}; there are {sorted(SCREENS)}")
    return SCREENS[name](df).limit(k)


def resolve_ticker(df: DataFrame, query_col: str = "query") -> DataFrame:
    """Add ``ticker``: by a table of names in any case, ends trimmed, else the query itself in upper case. It is null only for a null query."""
    names = F.create_map(*[F.lit(x) for pair in TICKERS.items() for x in pair])
    return df.withColumn("ticker", F.coalesce(F.try_element_at(names, F.lower(F.trim(query_col))), F.upper(query_col)))


def search_symbols(listing: DataFrame, text: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Rows of (symbol, name, kind) whose symbol or name holds the text, of the given kinds; the name defaults to the symbol, and ``delayed`` marks exchange suffixes."""
    hit = F.contains(F.upper("symbol"), F.lit(text.upper())) | F.contains(F.upper(F.coalesce("name", F.lit(""))), F.lit(text.upper()))
    delayed = F.exists(F.array(*[F.lit(x) for x in DELAYED]), lambda x: F.endswith(F.col("symbol"), x))
    return listing.where(hit & F.upper("kind").isin(*kinds)).select("symbol", F.coalesce("name", "symbol").alias("name"), "kind", delayed.alias("delayed"))


def read_csv(spark: SparkSession, path: str, symbol: str | None = None, ts_col: str = "date") -> DataFrame:
    """Bars of CSV files with a header. Columns whose names hold open, high, low, close or volume count as such; without a symbol the folders or a column name it."""
    raw = spark.read.option("header", True).csv(path)
    named: dict[str, str] = {}
    for c in sorted(raw.columns, key=len):
        kind = next((k for k in OHLCV if k in c.strip().lower()), None)
        if kind and kind not in named.values():
            named[c] = kind
    out = normalise(raw.withColumnsRenamed(named), ts_col)
    return out.withColumn("symbol", F.lit(symbol) if symbol is not None else F.col("symbol").cast("string"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Bars that ``write_bars`` wrote; conditions on the symbol choose folders."""
    return spark.read.parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # only where the session names none, as in tests
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bars(bars: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Bars in one folder per symbol."""
    writer = bars.repartition("symbol").write.mode("overwrite").partitionBy("symbol")
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


class BarSource(DataSource):
    """``spark.read.format("synthetic_bars")``: seeded random-walk bars, one partition per symbol. Options: symbols, n, seed, start. Conditions on symbol and ts are pushed down."""

    @classmethod
    def name(cls) -> str:
        return "synthetic_bars"

    def schema(self) -> str:
        return "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"

    def reader(self, schema: object) -> DataSourceReader:
        return BarReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``synthetic_bars`` known to the session and let conditions reach Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BarSource)


class BarReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.symbols = [x for x in options.get("symbols", "AAA,BBB").split(",") if x]
        self.n, self.seed, self.start = int(options.get("n", 2000)), int(options.get("seed", 42)), options.get("start", "2024-01-01")
        self.lo: dt.datetime | None = None
        self.hi: dt.datetime | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            match f:
                case EqualTo(("symbol",), v):
                    self.symbols = [x for x in self.symbols if x == v]
                case GreaterThanOrEqual(("ts",), v) if isinstance(v, dt.datetime):
                    self.lo = max(self.lo, v) if self.lo else v
                case LessThanOrEqual(("ts",), v) if isinstance(v, dt.datetime):
                    self.hi = min(self.hi, v) if self.hi else v
                case _:
                    yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.symbols] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import numpy as np

        if partition.value is None:
            return
        rng = np.random.default_rng([self.seed, *partition.value.encode()])
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.001, self.n)))
        noise = np.abs(rng.normal(0, 0.0005, (self.n, 2)))
        opens, vol, t0 = np.concatenate([[100.0], close[:-1]]), rng.integers(100, 10_000, self.n), dt.datetime.fromisoformat(self.start)
        for i in range(self.n):
            ts = t0 + dt.timedelta(minutes=5 * i)
            if (self.lo is None or ts >= self.lo) and (self.hi is None or ts <= self.hi):
                top, low = max(opens[i], close[i]), min(opens[i], close[i])
                yield (partition.value, ts, float(opens[i]), float(top * (1 + noise[i, 0])), float(low * (1 - noise[i, 1])), float(close[i]), float(vol[i]))
