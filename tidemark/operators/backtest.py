"""Event-driven backtests, per symbol and parameter set."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import equity_metrics, trade_metrics
from .running import in_order, places
from .sets import keep_first

TRADES = "symbol string, entry_time timestamp_ntz, exit_time timestamp_ntz, direction int, entry_price double, exit_price double, quantity double, pnl double, pnl_pct double, cost double, bars_held int, exit_reason string"
EQUITY = "symbol string, ts timestamp_ntz, equity double, before double, top double"


@dataclass(frozen=True)
class Config:
    """Capital, costs per side, exits (None: off) and walk-forward windows of a backtest."""

    capital: float = 100_000.0
    size: float = 0.10
    commission: float = 0.001
    slippage: float = 0.0005
    stop_loss: float | None = 0.02
    take_profit: float | None = 0.04
    max_bars: int | None = None
    allow_short: bool = True
    train: int = 500
    test: int = 100
    expanding: bool = False


class Simulation:
    """An account that takes bars in order. An open position is checked for exit at each close, in the order stop, profit, time, signal; a new one may open at once. The trade closed by the end of data is not in the equity."""

    def __init__(self, c: Config):
        self.config, self.cash, self.trades = c, c.capital, []
        self.side, self.entry, self.qty, self.since, self.opened, self.last = 0, 0.0, 0.0, 0, None, None

    def _close(self, at: float, when: object, why: str) -> None:
        c, side, entry, qty = self.config, self.side, self.entry, self.qty
        cost = (entry + at) * qty * (c.commission + c.slippage)
        pnl = side * (at - entry) * qty - cost
        self.trades.append((self.opened, when, side, entry, at, qty, pnl, side * (at / entry - 1) - cost / (entry * qty), cost, self.since, why))
        self.cash, self.side = self.cash + pnl, 0

    def take(self, ts: np.ndarray, price: np.ndarray, signal: np.ndarray) -> np.ndarray:
        """The equity of these bars; trades closed in them are in ``trades``."""
        c, curve = self.config, np.empty(len(price))
        for i, (p, want) in enumerate(zip(price, signal, strict=True)):
            if self.side:
                self.since += 1
                gain = self.side * (p - self.entry) / self.entry
                why = (
                    "stop_loss" if c.stop_loss and gain <= -c.stop_loss else "take_profit" if c.take_profit and gain >= c.take_profit
                    else "timeout" if c.max_bars and self.since >= c.max_bars else "signal" if want != self.side else None
                )
                if why:
                    self._close(p, ts[i], why)
            if not self.side and want and (want > 0 or c.allow_short):
                self.side, self.entry, self.qty, self.since, self.opened = int(want), p, self.cash * c.size / p, 0, ts[i]
            curve[i] = self.cash + (self.side * (p - self.entry) * self.qty if self.side else 0.0)
        if len(price):
            self.last = (price[-1], ts[-1])
        return curve

    def end(self) -> None:
        if self.side:
            self._close(*self.last, "end_of_data")

    def sent(self) -> list[tuple]:
        """Trades since the last call."""
        out, self.trades = self.trades, []
        return out


def simulate(ts: np.ndarray, price: np.ndarray, signal: np.ndarray, c: Config) -> tuple[list[tuple], np.ndarray]:
    """Trades and the equity of every bar of a whole series."""
    account = Simulation(c)
    curve = account.take(ts, price, signal)
    account.end()
    return account.sent(), curve


def _per_symbol(df: DataFrame, config: Config, trades: bool) -> DataFrame:
    names = [x.split()[0] for x in TRADES.split(", ")]
    kinds = {"string": pa.string(), "timestamp_ntz": pa.timestamp("us"), "int": pa.int32(), "double": pa.float64()}
    types = [kinds[x.split()[1]] for x in TRADES.split(", ")]

    def begin() -> Callable[[pa.RecordBatch | None], pa.RecordBatch | None]:
        account, symbol, before, top = Simulation(config), None, None, -np.inf

        def take(batch: pa.RecordBatch | None) -> pa.RecordBatch | None:
            nonlocal symbol, before, top
            if batch is None:
                account.end()
            else:
                symbol = batch.column("symbol")[0].as_py()
                curve = account.take(batch.column("ts").to_numpy(zero_copy_only=False), batch.column("price").to_numpy().astype(float), batch.column("signal").to_numpy().astype(np.int64))
                if not trades:
                    account.sent()
                    tops = np.maximum.accumulate(np.concatenate([[top], curve]))[1:]
                    earlier = pa.array([before, *curve[:-1].tolist()], pa.float64())
                    before, top = float(curve[-1]), float(tops[-1])
                    return pa.RecordBatch.from_arrays([batch.column("symbol"), batch.column("ts"), pa.array(curve), earlier, pa.array(tops)], names=["symbol", "ts", "equity", "before", "top"])
            found = [(symbol, *x) for x in account.sent()]
            if not trades or not found:
                return None
            return pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*found, strict=True), types, strict=True)], names=names)

        return take

    return in_order(df.where("price is not null and signal is not null").select("symbol", "ts", "price", "signal"), begin, TRADES if trades else EQUITY)


def trades(df: DataFrame, config: Config = Config()) -> DataFrame:
    """Trade log of (symbol, ts, price, signal)."""
    return _per_symbol(df, config, True)


def equity(df: DataFrame, config: Config = Config()) -> DataFrame:
    """``symbol, ts, equity, ret, drawdown`` of (symbol, ts, price, signal)."""
    curve = _per_symbol(df, config, False)  # with the equity before and the greatest so far, so no window sorts the curve again
    return curve.select("symbol", "ts", "equity", (F.try_divide("equity", "before") - 1).alias("ret"), F.try_divide(F.col("equity") - F.col("top"), F.col("top")).alias("drawdown"))


def quick(df: DataFrame, config: Config = Config()) -> DataFrame:
    """Metrics of the equity and of the trades of (symbol, ts, price, signal), one row per symbol."""
    return equity_metrics(equity(df, config)).join(trade_metrics(trades(df, config)), "symbol", "left")


def walk_forward_signals(prices: DataFrame, rule: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], config: Config = Config()) -> DataFrame:
    """Signals of consecutive test windows, each from ``rule(train, test)`` on the window before (or all before); bars before the first test window are dropped. One task per symbol and window; ``rule`` must return one signal per test bar."""
    c = config
    df = places(prices, "i").join(prices.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), "symbol")
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - c.train - c.test + 1) / c.test))
    last = F.floor((F.col("n") - 1 - c.train) / c.test) if c.expanding else F.floor(F.col("i") / c.test)
    last = F.least(last, F.floor((F.col("n") - 1 - c.train) / c.test))
    df = df.where(F.col("n") > c.train).withColumn("fold", F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))))

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i", ignore_index=True)
        lo = c.train + int(key[1]) * c.test
        train, test = g[g["i"] < lo], g[(g["i"] >= lo) & (g["i"] < lo + c.test)]
        out = np.asarray(rule(train, test)).astype(np.int32) if len(test) else np.zeros(0, np.int32)
        return pd.DataFrame({"symbol": key[0], "fold": int(key[1]), "ts": test["ts"], "price": test["price"], "signal": out})

    found = df.select("symbol", "fold", "i", "ts", "price").groupBy("symbol", "fold").applyInPandas(one, "symbol string, fold int, ts timestamp_ntz, price double, signal int")
    return keep_first(found, ["symbol", "ts"], [F.col("fold")])


def walk_forward(prices: DataFrame, rule: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], config: Config = Config()) -> DataFrame:
    return equity(walk_forward_signals(prices, rule, config), config)
