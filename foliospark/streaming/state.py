"""Incremental portfolio state and market cache on Structured Streaming.

Events of a micro-batch are applied in their order columns; a late event is applied when it arrives, but in the market cache, which
keeps the order columns, it takes its place. With a watermark delay, events older than the watermark are dropped by Spark before they
reach the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliospark.functions.scan import rising

POSITION = "symbol string, units double, price double, accrued_yield double"
PORTFOLIO = f"portfolio_id long, cash double, equity double, n_events long, positions array<struct<symbol:string,units:double,price:double,accrued_yield:double>>"
CACHE = "symbol string, latest_price double, spot_cvd double, perp_cvd double, realized_vol double, n_prices long"


def apply_events(cash: float, positions: dict[str, list[float]], rows: pd.DataFrame) -> float:
    """Applies rows in order to positions (symbol -> units, price, yield) and returns the cash."""
    for kind, symbol, side, units, price, fee, amount in rows[["event_type", "symbol", "side", "units", "price", "fee", "amount"]].itertuples(index=False, name=None):
        p = positions.get(symbol)
        if kind == "ORDER_EXECUTED":
            signed = units if side == "BUY" else -units
            cash -= signed * price + (0.0 if pd.isna(fee) else fee)
            p = positions.setdefault(symbol, [0.0, price, 0.0])
            p[0] += signed
            p[1] = price
        elif kind == "MARKET_TICK" and p:
            p[1] = price
        elif kind == "YIELD_ACCRUED":
            cash += amount
            if p:
                p[2] += amount
    return cash


def stream_portfolio_state(events: DataFrame, initial_cash: float, order: tuple[str, ...] = ("ts", "event_id"), delay: str | None = None) -> DataFrame:
    """The new state of each portfolio that a micro-batch touches; equals state_at over what has arrived."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cash, count, rows = state.get if state.exists else (initial_cash, 0, [])
        positions = {s: [u, p, y] for s, u, p, y in rows}
        batch = pd.concat(list(frames)).sort_values(list(order))
        cash = apply_events(cash, positions, batch)
        listed = [(s, *v) for s, v in sorted(positions.items())]
        count += len(batch)
        state.update((cash, count, listed))
        equity = cash + sum(u * p for _, u, p, _ in listed)
        names = ("symbol", "units", "price", "accrued_yield")
        yield pd.DataFrame({"portfolio_id": [key[0]], "cash": [cash], "equity": [equity], "n_events": [count], "positions": [[dict(zip(names, x)) for x in listed]]})

    source = events.withWatermark("ts", delay) if delay else events
    state = "cash double, n_events long, positions array<struct<symbol:string,units:double,price:double,accrued_yield:double>>"
    return source.groupBy("portfolio_id").applyInPandasWithState(update, PORTFOLIO, state, "update", GroupStateTimeout.NoTimeout)


#: Prices of a volatility; a number after all times and ids.
PRICES, LAST = 30, (1 << 63) - 1


def in_order(events: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Ticks and derivatives with their order columns as _o0, _o1, ...: times as microseconds, NULL last."""
    rows = events.where(F.col("event_type").isin("MARKET_TICK", "DERIVATIVES_METRICS"))
    kinds = dict(events.dtypes)
    at = [F.col(c) if kinds[c] == "string" else rising(events, c) for c in order]
    rows = rows.select("symbol", "event_type", "price", "spot_cvd", "perp_cvd", *[c.alias(f"_o{i}") for i, c in enumerate(at)])
    return rows.withColumns({c: F.coalesce(c, F.lit(LAST)) for c, kind in rows.dtypes if c.startswith("_o") and kind == "bigint"})


def series(f: pd.DataFrame) -> list[tuple[np.ndarray, str, int]]:
    """What the cache keeps: rows, their value and how many of the last."""
    tick = (f["event_type"] == "MARKET_TICK").to_numpy()
    known = lambda c: f[c].notna().to_numpy()
    return [(tick, "price", PRICES), (tick & known("price"), "price", 1), (~tick & known("spot_cvd"), "spot_cvd", 1), (~tick & known("perp_cvd"), "perp_cvd", 1), (~tick, "symbol", 1)]


def newest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each frame only the rows that can still count for a symbol's state; _n of its last tick is the number of its ticks."""
    for f in frames:
        f = f.sort_values([c for c in f.columns if c.startswith("_o")], kind="stable", ignore_index=True)
        f["_n"], kept = 0, np.zeros(len(f), bool)
        for rows, _, n in series(f):
            kept[f[rows].groupby("symbol", sort=False, dropna=False).tail(n).index] = True
        ticks = f[f["event_type"] == "MARKET_TICK"].groupby("symbol", sort=False, dropna=False)
        last = ticks.tail(1).index
        f.loc[last, "_n"] = ticks["_n"].transform("size").loc[last]
        yield f[kept]


def merged(before: list, f: pd.DataFrame, n: int) -> list:
    """The last n of the rows before and of a frame; a row is its order columns and a value."""
    f = f.sort_values(list(f.columns[:-1]), kind="stable").tail(n).astype(object)
    rows = [*map(tuple, before), *f.where(f.notna(), None).itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: [(x is None, x) for x in r[:-1]])[-n:]


def stream_market_cache(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Per symbol: latest price, latest derivatives, volatility of the last 30 prices, by the order columns, in whatever order events come.
    Rows that can't count any more are left out before the shuffle, an Arrow batch at a time, and frames are merged as they come."""
    rows = in_order(events, order)
    rows = rows.mapInPandas(newest, ", ".join(f"`{c}` {kind}" for c, kind in [*rows.dtypes, ("_n", "bigint")]))
    at = [c for c in rows.columns if c.startswith("_o")]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *lists, count = state.get if state.exists else ([], [], [], [], 0)
        for f in frames:
            lists = [merged(before, f.loc[mask, [*at, c]], n) for before, (mask, c, n) in zip(lists, series(f))]
            count += int(f["_n"].sum())
        state.update((*lists, count))
        prices, latest, spot, perp = ([r[-1] for r in x] for x in lists)
        vol = None
        if prices:
            vol = float(pd.Series(prices, dtype=float).pct_change(fill_method=None).std() * 365**0.5) if count > 5 else 0.30
        first = lambda x: x[0] if x else None
        yield pd.DataFrame({"symbol": [key[0]], "latest_price": [first(latest)], "spot_cvd": [first(spot)], "perp_cvd": [first(perp)], "realized_vol": [vol], "n_prices": [count]})

    entry = ", ".join([*[f"{c}: {kind}" for c, kind in rows.dtypes if c in at], "value: double"])
    kept = ", ".join(f"{c} array<struct<{entry}>>" for c in ("prices", "latest", "spot", "perp")) + ", n long"
    return rows.groupBy("symbol").applyInPandasWithState(update, CACHE, kept, "update", GroupStateTimeout.NoTimeout)
