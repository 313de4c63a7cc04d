"""Streams with keyed state: a state row for each symbol of a portfolio, eviction by timers, late rows kept aside.

The state of a portfolio is a map: a micro-batch reads and writes the entries of the symbols that it touches, and the totals, however
many positions there are. Frames of a key are folded as they come: sums add up in any order, last prices and first
orders are told by their order columns, so nothing is collected or sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from foliospark.functions.scratch import stash

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
POSITIONS = "portfolio_id long, symbol string, units double, price double, accrued_yield double, cash double, equity double, n_events long"
CACHE = "symbol string, latest_price double, latest_ts timestamp, n_prices long, evicted boolean"
NEVER = -(1 << 63)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which maps and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def micros(ts: pd.Series) -> np.ndarray:
    """Microseconds since 1970; the earliest number for NaT."""
    at = ts.astype("datetime64[us]")
    return np.where(at.isna(), NEVER, at.astype("int64"))


class Positions(StatefulProcessor):
    """Emits a row for each symbol touched, and one without a symbol for the portfolio's totals."""

    def __init__(self, initial_cash: float, ident: str):
        self.initial_cash, self.ident = initial_cash, ident

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "cash double, notional double, n_events long")
        entry = "units double, price double, priced_at long, priced_id long, first_at long, first_id long, accrued_yield double"
        self.positions = handle.getMapState("positions", "symbol string", entry)

    def entry(self, symbol: str) -> list:
        found = self.positions.getValue((symbol,))
        return list(found) if found else [0.0, None, None, None, None, None, 0.0]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        cash, notional, count = self.totals.get() if self.totals.exists() else (self.initial_cash, 0.0, 0)
        before: dict[str, list] = {}
        now: dict[str, list] = {}
        waiting: list[pd.DataFrame] = []  # yields of symbols that had no position before this batch
        for f in rows:
            count += len(f)
            f = f[f["event_type"].isin(["ORDER_EXECUTED", "MARKET_TICK", "YIELD_ACCRUED"])]
            f = f.assign(_at=micros(f["ts"]), _id=f[self.ident]).sort_values(["_at", "_id"], kind="stable")
            orders, yields = f[f["event_type"] == "ORDER_EXECUTED"], f[f["event_type"] == "YIELD_ACCRUED"]
            signed = np.where(orders["side"] == "BUY", orders["units"], -orders["units"])
            cash += float(yields["amount"].sum()) - float((signed * orders["price"]).sum()) - float(orders["fee"].fillna(0.0).sum())
            for symbol in f["symbol"].dropna().unique():
                if symbol not in now:
                    now[symbol] = self.entry(symbol)
                    before[symbol] = list(now[symbol])
            for symbol, units in orders.assign(_u=signed).groupby("symbol")["_u"].sum().items():
                now[symbol][0] += float(units)
            for row in orders.drop_duplicates("symbol")[["symbol", "_at", "_id"]].itertuples(index=False):
                e = now.get(row.symbol)
                if e is not None and (e[4] is None or (row[1], row[2]) < (e[4], e[5])):
                    e[4], e[5] = int(row[1]), int(row[2])
            priced = f[(f["event_type"] != "YIELD_ACCRUED") & f["price"].notna()].drop_duplicates("symbol", keep="last")
            for row in priced[["symbol", "_at", "_id", "price"]].itertuples(index=False):
                e = now.get(row.symbol)
                if e is not None and (e[2] is None or (row[1], row[2]) >= (e[2], e[3])):
                    e[1], e[2], e[3] = float(row.price), int(row[1]), int(row[2])
            old = yields["symbol"].map(lambda s: s in before and before[s][4] is not None)
            for symbol, amount in yields[old.astype(bool)].groupby("symbol")["amount"].sum().items():
                now[symbol][6] += float(amount)
            waiting.append(yields[~old.astype(bool)][["symbol", "_at", "_id", "amount"]])
        for f in waiting:
            for symbol, at, ident, amount in f.itertuples(index=False):
                e = now.get(symbol)
                if e is not None and e[4] is not None and (at, ident) >= (e[4], e[5]):
                    e[6] += float(amount)
        value = lambda e: e[0] * e[1] if e[4] is not None and e[1] is not None else 0.0
        for symbol, e in now.items():
            notional += value(e) - value(before[symbol])
            self.positions.updateValue((symbol,), tuple(e))
        self.totals.update((cash, notional, count))
        held = [(symbol, e) for symbol, e in sorted(now.items()) if e[4] is not None]
        table = [(key[0], s, e[0], e[1], e[6], None, None, None) for s, e in held] + [(key[0], None, None, None, None, cash, cash + notional, count)]
        yield pd.DataFrame(table, columns=[c.split()[0] for c in POSITIONS.split(", ")]).astype({"units": float, "price": float, "accrued_yield": float, "cash": float, "equity": float})

    def close(self) -> None:
        pass


def stream_positions(events: DataFrame, initial_cash: float, ident: str = "event_id") -> DataFrame:
    """portfolio_id, symbol, units, price, accrued_yield of each symbol that a micro-batch touches; with symbol NULL the portfolio's
    cash, equity and n_events. The last row of each key is its state, and equals state_at() over what has arrived, if orders come
    before the later yields of their symbol. Start it inside keyed_state()."""
    needed = events.select("portfolio_id", "ts", ident, "event_type", "symbol", "side", "units", "price", "fee", "amount")
    return needed.groupBy("portfolio_id").transformWithStateInPandas(Positions(initial_cash, ident), POSITIONS, "Update", "None")


class Cache(StatefulProcessor):
    """Latest price of a symbol; it leaves the state when the watermark passes its last tick by `keep_ms`."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "price double, at long, ident long, n long, timer long")

    def row(self, symbol, price, at, n, evicted: bool) -> pd.DataFrame:
        return pd.DataFrame({"symbol": [symbol], "latest_price": [price], "latest_ts": pd.to_datetime([at], unit="us"), "n_prices": [n], "evicted": [evicted]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        price, at, ident, n, timer = self.latest.get() if self.latest.exists() else (None, NEVER, NEVER, 0, 0)
        for f in rows:
            n += len(f)
            stamps = micros(f["ts"])
            best = max(range(len(f)), key=lambda k: (stamps[k], f["event_id"].iloc[k]))
            if (stamps[best], f["event_id"].iloc[best]) >= (at, ident):
                price, at, ident = float(f["price"].iloc[best]), int(stamps[best]), int(f["event_id"].iloc[best])
        if timer:
            self.handle.deleteTimer(timer)
        timer = at // 1000 + self.keep_ms
        self.handle.registerTimer(timer)
        self.latest.update((price, at, ident, n, timer))
        yield self.row(key[0], price, at, n, False)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        price, at, _, n, _ = self.latest.get()
        self.latest.clear()
        yield self.row(key[0], price, at, n, True)

    def close(self) -> None:
        pass


def stream_latest_prices(ticks: DataFrame, delay: str, keep_ms: int) -> DataFrame:
    """The latest price of each symbol that a micro-batch touches, and a last row with evicted = true when no tick of the symbol
    has come for keep_ms of event time; the symbol starts anew after it. Ticks later than the watermark are dropped before the state, so
    take them aside first (split_late). Start it inside keyed_state()."""
    needed = ticks.select("symbol", "ts", "event_id", "price").withWatermark("ts", delay)
    return needed.groupBy("symbol").transformWithStateInPandas(Cache(keep_ms), CACHE, "Update", "EventTime")


def split_late(batch: DataFrame, number: int, path: str, delay_s: float) -> None:
    """For foreachBatch: rows not older than the watermark go to <path>/on_time, the others to <path>/late, each under its batch number.
    The watermark is the largest time of all batches before, less delay_s. Every batch writes its own folders, so one that
    is run again replaces its rows and changes no other."""
    spark = batch.sparkSession
    marks = spark.read.schema("top timestamp, batch long").parquet(f"{path}/marks") if number else None
    top = marks.where(F.col("batch") < number).agg(F.max("top")).first()[0] if marks is not None else None
    rows = stash(batch, "late-batch")
    late = F.lit(False) if top is None else F.coalesce(F.col("ts") < F.lit(top) - F.expr(f"make_dt_interval(0, 0, 0, {delay_s})"), F.lit(False))
    rows.where(~late).write.mode("overwrite").parquet(f"{path}/on_time/part={number}")
    rows.where(late).write.mode("overwrite").parquet(f"{path}/late/part={number}")
    rows.agg(F.max(F.col("ts").cast("timestamp")).alias("top")).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/marks/part={number}")
