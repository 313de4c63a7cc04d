"""Auto-rebalancing replays of many (portfolio, policy) pairs.

The log's few columns are shuffled once, by portfolio, and sorted. The fold takes an Arrow batch at a time and carries a few
numbers for each portfolio and policy: what does not depend on the portfolio's own path (volatilities, derivatives, targets) is
computed for a batch as arrays, the rest event by event. No task holds a portfolio as a whole, neither in Python nor in a window's buffer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.operators import allocation, execution, signals

SYMBOLS = ("BTC", "ETH", "SOL", "AVAX", "BUIDL")
#: The defaults of the simulated market.
CATEGORY = {"BTC": "CORE", "ETH": "CORE", "SOL": "SATELLITE", "AVAX": "SATELLITE", "BUIDL": "RWA_YIELD"}
DEPTH = {"BTC": 5e6, "ETH": 2e6, "SOL": 1e6, "AVAX": 1e6, "BUIDL": 1e7}


@dataclass(frozen=True)
class Policy:
    policy_id: int
    target_vol: float = 0.15
    core_band: float = execution.CORE_BAND
    satellite_band: float = execution.SATELLITE_BAND
    every: int = 6
    rebalance: bool = True


def with_signals(log: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Per event of a portfolio's log: each symbol's latest price and volatility and the latest BTC derivatives in
    that log, the event itself included. Windows over whole portfolios, for logs of a moderate size; Signals does the same a batch
    at a time."""
    is_tick = F.col("event_type") == "MARKET_TICK"
    run = W.partitionBy("portfolio_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    per_symbol = W.partitionBy("portfolio_id", "symbol", is_tick).orderBy(*order)
    before = F.lag("price").over(per_symbol)
    rows = log.withColumn("_r", F.when(is_tick & (before != 0), F.col("price") / before - 1)).withColumn("_n", F.when(is_tick, F.row_number().over(per_symbol)))
    vol = F.stddev_samp("_r").over(per_symbol.rowsBetween(-28, 0)) * F.sqrt(F.lit(365.0))
    rows = rows.withColumn("_v", F.when(is_tick, F.when(F.col("_n") > 5, F.coalesce(vol, F.lit(0.30))).otherwise(0.30)))
    last = lambda s, c: F.last(F.when(is_tick & (F.col("symbol") == s), F.col(c)), ignorenulls=True).over(run)
    rows = rows.withColumns({f"px_{s}": last(s, "price") for s in SYMBOLS} | {f"vol_{s}": last(s, "_v") for s in SYMBOLS})
    btc = (F.col("event_type") == "DERIVATIVES_METRICS") & (F.col("symbol") == "BTC")
    rows = rows.withColumns({c: F.last(F.when(btc, F.col(c)), ignorenulls=True).over(run) for c in ("spot_cvd", "perp_cvd")})
    ruled = signals.regime_rules(signals.cvd_regime(rows).withColumns({"nupl": F.lit(0.5), "roc_30d": F.lit(0.0)}))
    cut = F.coalesce((F.col("cvd_regime") == "BROAD_LIQUIDATION") | (F.col("regime") == "BEAR"), F.lit(False)) & F.col("spot_cvd").isNotNull()
    return ruled.withColumn("risk_divisor", F.when(cut, F.col("gamma")).otherwise(1.0)).drop("_r", "_n", "_v", "nupl", "roc_30d")


N = len(SYMBOLS)
PLACE = {s: i for i, s in enumerate(SYMBOLS)}
DEPTHS = [DEPTH[s] for s in SYMBOLS]
SATELLITES = np.array([CATEGORY[s] == "SATELLITE" for s in SYMBOLS])
PLAN = np.array([allocation.CORE.get(s, allocation.SATELLITE / SATELLITES.sum() if CATEGORY[s] == "SATELLITE" else allocation.RWA) for s in SYMBOLS])
KINDS = {"ORDER_EXECUTED": 0, "MARKET_TICK": 1, "YIELD_ACCRUED": 2}
ORDER, TICK, YIELD, OTHER = range(4)
#: Returns of a volatility; gamma of signals.regime_rules() for neutral nupl and roc, as with_signals() sets them.
SPAN, CUT = 29, 2.0
#: The kinds of events for which a column is used; for others it is not shuffled.
USED = {c: ("ORDER_EXECUTED",) for c in ("side", "units", "fee")} | {"price": ("ORDER_EXECUTED", "MARKET_TICK"), "amount": ("YIELD_ACCRUED",), "target_weights": ("REBALANCE_TRIGGERED",)}
USED |= {c: ("DERIVATIVES_METRICS",) for c in ("spot_cvd", "perp_cvd")}
RESULT = "portfolio_id long, policy_id long, final_equity double, cash double, max_drawdown double, volatility double, n_orders long, fees double, n_events long"


def targets(vols: np.ndarray, divisor: np.ndarray, target_vol: float) -> np.ndarray:
    """For each row the plan weights, lowered by the regime, scaled to the target volatility. NaN: the symbol has no volatility."""
    out = np.tile(PLAN, (len(vols), 1))
    rest = lambda: np.fmax(0.0, 1 - out[:, :-1].sum(axis=1))
    out[:, :-1] /= divisor[:, None]
    out[:, -1] = np.where(divisor != 1.0, rest(), out[:, -1])
    known = ~np.isnan(vols)
    vol = np.where(known, out * vols, 0.0).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(vol <= 0, 1.0, np.fmin(1.0, target_vol / vol))
    some = known.any(axis=1)
    out[:, :-1] *= np.where(some, scale, 1.0)[:, None]
    out[:, -1] = np.where(some, rest(), out[:, -1])
    return out


class Signals:
    """What with_signals() adds to the events of one portfolio, for batches of them in order."""

    def __init__(self):
        self.price, self.vol, self.before, self.ticks = [np.nan] * N, [np.nan] * N, [np.nan] * N, [0] * N
        self.returns = [np.full(SPAN - 1, np.nan)] * N
        self.spot = self.perp = np.nan

    def add(self, events: pd.DataFrame) -> pd.DataFrame:
        place = places(events)
        tick = (events["event_type"] == "MARKET_TICK").to_numpy()
        price = events["price"].to_numpy(float)
        rows = [np.flatnonzero(tick & (place == i)) for i in range(N)]
        spans = []
        for i, at in enumerate(rows):
            p = price[at]
            before = np.concatenate([[self.before[i]], p])
            with np.errstate(divide="ignore", invalid="ignore"):
                run = np.concatenate([self.returns[i], np.where(before[:-1] != 0, p / before[:-1] - 1, np.nan)])
            spans.append(np.lib.stride_tricks.sliding_window_view(run, SPAN) if len(at) else np.empty((0, SPAN)))
            self.returns[i], self.before[i] = run[len(run) - SPAN + 1 :], before[-1]
        vols = deviations(np.concatenate(spans)) * sqrt(365.0)
        vols = np.split(np.where(np.isnan(vols), 0.30, vols), np.cumsum([len(at) for at in rows])[:-1])
        out = {}
        for i, (s, at, vol) in enumerate(zip(SYMBOLS, rows, vols)):
            vol[: max(0, 5 - self.ticks[i])] = 0.30
            self.ticks[i] += len(at)
            out[f"px_{s}"] = px = latest(at, price[at], len(events), self.price[i])
            out[f"vol_{s}"] = v = latest(at, vol, len(events), self.vol[i])
            self.price[i], self.vol[i] = px[-1], v[-1]
        btc = np.flatnonzero((events["event_type"] == "DERIVATIVES_METRICS").to_numpy() & (place == PLACE["BTC"]))
        spot, perp = (latest(btc, events[c].to_numpy(float)[btc], len(events), x) for c, x in (("spot_cvd", self.spot), ("perp_cvd", self.perp)))
        self.spot, self.perp = spot[-1], perp[-1]
        out["risk_divisor"] = np.where((spot < 0) & ~(perp >= 0), CUT, 1.0)
        return events.assign(**out)


def places(events: pd.DataFrame) -> np.ndarray:
    """Each event's place in SYMBOLS, -1 for other symbols."""
    return events["symbol"].map(PLACE).fillna(-1).to_numpy().astype(int)


def latest(at: np.ndarray, values: np.ndarray, n: int, before: float) -> np.ndarray:
    """For each of n rows the last value at or before it that is not NaN; values are those of the rows `at`."""
    known = ~np.isnan(values)
    found = np.zeros(n, int)
    found[at[known]] = np.arange(1, known.sum() + 1)
    return np.concatenate([[before], values[known]])[np.maximum.accumulate(found)]


def deviations(spans: np.ndarray) -> np.ndarray:
    """Sample standard deviation of each row, NaN left out, by the steps of Spark's stddev_samp; NaN for fewer than two values."""
    n, mean, m2 = np.zeros(len(spans)), np.zeros(len(spans)), np.zeros(len(spans))
    with np.errstate(divide="ignore", invalid="ignore"):
        for x in spans.T:
            known = ~np.isnan(x)
            n = n + known
            delta = x - mean
            step = delta / n
            mean, m2 = np.where(known, mean + step, mean), np.where(known, m2 + delta * (delta - step), m2)
        return np.where(n > 1, np.sqrt(m2 / (n - 1)), np.nan)


class Batch:
    """Events of one portfolio, in order, as columns; shared by all policies."""

    def __init__(self, events: pd.DataFrame, n_events: int):
        number = lambda c: events[c].to_numpy(float)
        self.sequence = events["sequence"].to_numpy()
        self.place = places(events)
        kind = events["event_type"].map(KINDS).fillna(OTHER).to_numpy().astype(int)
        self.kind = np.where((self.place < 0) & (kind != YIELD), OTHER, kind)
        self.price, self.fee, self.amount = number("price"), number("fee"), number("amount")
        self.signed = np.where((events["side"] == "BUY").to_numpy(), number("units"), -number("units"))
        self.paid = self.signed * self.price + self.fee
        self.prices = events[[f"px_{s}" for s in SYMBOLS]].to_numpy(float).copy()
        self.prices[np.isnan(self.prices[:, -1]), -1] = 1.0
        self.vols = events[[f"vol_{s}" for s in SYMBOLS]].to_numpy(float)
        self.divisor = number("risk_divisor")
        self.all_known = ~np.isnan(self.prices).any(axis=1)
        self.explicit = (events["event_type"] == "REBALANCE_TRIGGERED").to_numpy()
        asked = events["target_weights"].to_numpy() if "target_weights" in events else [None] * len(events)
        self.asked = {k: dict(asked[k]) for k in np.flatnonzero(self.explicit) if asked[k] is not None}
        self.snapshot = (self.sequence % 6 == 5) | (self.sequence == n_events - 1)
        self.steps = [x.tolist() for x in (self.kind, self.place, self.signed, self.price, self.fee, self.paid, self.amount)]

    def wanted(self, at: np.ndarray, target_vol: float) -> list:
        """For each row the target weights to go for, None for rows that are not marked or whose targets break a limit."""
        rows = np.flatnonzero(at)
        want = targets(self.vols[rows], self.divisor[rows], target_vol)
        for k, given in self.asked.items():
            if given:
                want[rows == k] = [given.get(s, 0.0) for s in SYMBOLS]
        total = want.sum(axis=1)
        bad = (want[:, SATELLITES] > execution.SATELLITE_CAP).any(axis=1) | ((np.abs(total - 1) > execution.WEIGHT_TOLERANCE) & (total > 0))
        out: list = [None] * len(at)
        for k, w in zip(rows[~bad].tolist(), want[~bad].tolist()):
            out[k] = w
        return out


def plus(total: float, lost: float, x: float) -> tuple[float, float]:
    """A compensated sum: millions of payments cancel out, and what rounding takes from each of them would stay."""
    found = total + x
    part = found - total
    return found, lost + ((total - (found - part)) + (x - part))


class Path:
    """The state of one portfolio under one policy; its size does not grow with the events."""

    def __init__(self, p: Policy, cash: float):
        self.p, self.cash, self.equity, self.weighed, self.fees, self.orders, self.events = p, cash, cash, cash, 0.0, 0, 0
        self.units, self.values, self.held = [0.0] * N, [0.0] * N, [False] * N
        self.bands = [p.core_band if CATEGORY[s] == "CORE" else p.satellite_band for s in SYMBOLS]
        self.lost = 0.0  # what rounding has taken from the cash
        self.peak, self.worst, self.last = cash, 0.0, cash
        self.n, self.mean, self.m2 = 0, 0.0, 0.0  # of the returns between snapshots

    def add(self, b: Batch) -> None:
        """The next events. A position's weight is its value over the equity when orders or prices last changed (weighed)."""
        p = self.p
        due = b.explicit | (b.sequence % p.every == p.every - 1)
        wanted: list = [None] * len(due)
        if p.rebalance:
            wanted = b.wanted(due if all(self.held) else due | b.all_known, p.target_vol)
        cash, lost, equity, weighed, fees, orders = self.cash, self.lost, self.equity, self.weighed, self.fees, self.orders
        units, values, held = self.units, self.values, self.held
        curve = []
        for k, (want, kind, i, signed, price, fee, paid, amount) in enumerate(zip(wanted, *b.steps)):
            if kind != OTHER:
                if kind == YIELD:
                    cash, lost = plus(cash, lost, amount)
                else:
                    if kind == ORDER:
                        cash, lost = plus(cash, lost, -paid)
                        fees += fee
                        units[i] += signed
                        held[i] = True
                    if held[i]:
                        values[i] = units[i] * price
                total = 0.0
                for v in values:
                    total += v
                equity = cash + lost + total
                if kind != YIELD:
                    weighed = equity
            if want is not None and (due[k] or not all(held)):
                moved = False
                for j, px in enumerate(b.prices[k].tolist()):
                    weight = values[j] / weighed if weighed > 0 else 0.0
                    change = (want[j] - weight) * equity
                    size, drift = abs(change), abs(weight - want[j])
                    if px == px and size >= 1.0 and drift > self.bands[j]:
                        cost = size * (execution.SPREAD + execution.FEE)
                        gain = 0.5 * (drift * drift) * equity
                        if gain <= 0 or gain > cost + execution.IMPACT * sqrt(size / DEPTHS[j]) * size * execution.SPREAD:
                            moved = True
                            if px > 0:
                                bought = change / px
                                cash, lost = plus(cash, lost, -(bought * px + cost))
                                fees += cost
                                units[j] += bought
                                values[j], held[j] = units[j] * px, True
                                orders += 1
                if moved:
                    total = 0.0
                    for v in values:
                        total += v
                    equity = weighed = cash + lost + total
            curve.append(equity)
        self.cash, self.lost, self.equity, self.weighed, self.fees, self.orders = cash, lost, equity, weighed, fees, orders
        self.follow(np.array(curve), b.snapshot)

    def follow(self, curve: np.ndarray, snapshot: np.ndarray) -> None:
        """Drawdown and the moments of the returns between snapshots, over the next equities."""
        with np.errstate(divide="ignore", invalid="ignore"):
            peaks = np.fmax.accumulate(np.concatenate([[self.peak], curve]))
            self.worst = float(np.fmin(self.worst, np.fmin.reduce(curve / peaks[1:] - 1)))
            points = np.concatenate([[self.last], curve[snapshot]])
            rets = np.diff(points) / points[:-1]
            rets = rets[~np.isnan(rets)]
            if len(rets):
                n, mean = self.n + len(rets), rets.mean()
                self.m2 += float(((rets - mean) ** 2).sum() + (mean - self.mean) ** 2 * self.n * len(rets) / n)
                self.mean += float((mean - self.mean) * len(rets) / n)
                self.n = n
        self.peak, self.last = float(peaks[-1]), float(points[-1])
        self.events += len(curve)

    def result(self) -> dict:
        vol = sqrt(self.m2 / (self.n - 1)) * sqrt(365) if self.n > 1 else 0.0
        return dict(policy_id=self.p.policy_id, final_equity=self.equity, cash=self.cash + self.lost, max_drawdown=self.worst, volatility=vol, n_orders=self.orders, fees=self.fees, n_events=self.events)


def replay_policy(events: pd.DataFrame, p: Policy, cash: float) -> dict:
    """The fold of one portfolio under one policy, on columns in event order."""
    path = Path(p, cash)
    path.add(Batch(events, len(events)))
    return path.result()


def replay_sorted(batches: Iterator[pa.RecordBatch], chunks: list[list[Policy]], initial_cash: float) -> Iterator[dict]:
    """Results of rows sorted by portfolio, chunk and event, wherever batches begin. The first row of each portfolio and chunk is no
    event: it holds n_events."""
    at, known, paths = None, 0, []
    ends = lambda: [{"portfolio_id": at[0]} | x.result() for x in paths]
    for batch in batches:
        place = 0
        for key, run in groupby(zip(batch["portfolio_id"].to_pylist(), batch["_chunk"].to_pylist())):
            n = sum(1 for _ in run)
            rows, place = batch.slice(place, n), place + n
            if key != at:
                yield from ends()
                at, known, found, paths = key, rows["n_events"][0].as_py(), Signals(), [Path(p, initial_cash) for p in chunks[key[1]]]
                rows = rows.slice(1)
            if len(rows):
                events = Batch(found.add(rows.to_pandas()), known)
                for x in paths:
                    x.add(events)
    yield from ends()


def strategy_replay(log: DataFrame, policies: list[Policy], initial_cash: float, order: tuple[str, ...] = ("ts", "event_id"), chunk: int = 8) -> DataFrame:
    """One row per (portfolio, policy). A task folds a portfolio's events, sorted, for a chunk of policies; the log is read twice, as a
    snapshot is also taken where the sequence meets the number of events, which has to be known before."""
    counts = log.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n_events"))
    values = [F.when(F.col("event_type").isin(*kinds), F.col(c)).alias(c) for c, kinds in USED.items() if c in log.columns]
    rows = log.select("portfolio_id", "event_type", "symbol", "sequence", *values, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    needed = [c for c in rows.columns if c != "portfolio_id" and not c.startswith("_o")]
    rows = rows.unionByName(counts, allowMissingColumns=True)
    chunks = [policies[i : i + chunk] for i in range(0, len(policies), chunk)]
    rows = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(len(chunks) - 1)))) if len(chunks) > 1 else rows.withColumn("_chunk", F.lit(0))
    by = [F.col(c).asc_nulls_last() for c in ("n_events", *[f"_o{i}" for i in range(len(order))])]
    rows = rows.repartition("portfolio_id", "_chunk").sortWithinPartitions("portfolio_id", "_chunk", *by)
    names = [c.split()[0] for c in RESULT.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.float64() if f"{c} double" in RESULT else pa.int64()) for c in names])
        found = replay_sorted(batches, chunks, initial_cash)
        while some := list(islice(found, 1000)):
            yield pa.RecordBatch.from_pylist(some, schema=schema)

    return rows.select("portfolio_id", "_chunk", "n_events", *needed).mapInArrow(fold, RESULT)
