"""Hand values, edge cases and properties of the portfolio operators."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions.scan import two_level_scan
from foliospark.functions.stats import risk_parity
from foliospark.operators import allocation, attribution, execution, ledger, regime_model, replay, signals, validation
from foliospark.sources import feeds
from foliospark.streaming.state import apply_events

LOG = "portfolio_id long, event_id long, ts timestamp, sequence long, event_type string, symbol string, price double, side string, units double, fee double, amount double, spot_cvd double, perp_cvd double"
T0 = dt.datetime(2024, 1, 1)


def log(spark, *rows):
    """rows: (kind, symbol, price, side, units, fee, amount)"""
    return spark.createDataFrame([(1, i, T0 + dt.timedelta(minutes=i), 0, k, s, p, side, u, fee, a, None, None) for i, (k, s, p, side, u, fee, a) in enumerate(rows)], LOG)


def last(df):
    return df.orderBy("event_id").collect()[-1]


def test_buy_tick_and_yield(spark):
    events = log(spark, ("ORDER_EXECUTED", "ETH", 3000.0, "BUY", 10.0, 10.0, None), ("YIELD_ACCRUED", "BUIDL", None, None, None, None, 12.33))
    states = ledger.portfolio_state(events, 100_000.0).orderBy("event_id").collect()
    assert (states[0].cash, states[0].equity) == (69_990.0, 99_990.0)
    assert states[1].equity == pytest.approx(100_002.33)
    up = log(spark, ("ORDER_EXECUTED", "BTC", 40_000.0, "BUY", 1.0, 0.0, None), ("MARKET_TICK", "BTC", 42_000.0, None, None, None, None))
    assert last(ledger.portfolio_state(up, 100_000.0)).equity == 102_000.0
    assert ledger.position_weights(up, 100_000.0).first().weight == pytest.approx(42 / 102)


def test_tick_before_any_order_makes_no_position(spark):
    events = log(spark, ("MARKET_TICK", "BTC", 5.0, None, None, None, None), ("YIELD_ACCRUED", "BTC", None, None, None, None, 1.0))
    assert ledger.position_ledger(events).count() == 0
    assert ledger.state_at(events, 10.0).count() == 0


def random_log(seed, n=120):
    r = random.Random(seed)
    kinds = ["ORDER_EXECUTED", "MARKET_TICK", "YIELD_ACCRUED", "DERIVATIVES_METRICS"]
    out = []
    for i in range(n):
        out.append((r.randrange(2), i, T0 + dt.timedelta(minutes=r.randrange(40)), r.choice([0, i]), r.choice(kinds), r.choice("ABC"), float(r.randrange(1, 90)), r.choice(["BUY", "SELL"]), float(r.randrange(1, 9)), r.random(), r.random(), 0.0, 0.0))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_windows_equal_a_plain_fold(spark, seed):
    rows = random_log(seed)
    got = {r.event_id: r for r in ledger.portfolio_state(spark.createDataFrame(rows, LOG), 50.0).collect()}
    final = {(r.portfolio_id, r.symbol): r for r in ledger.state_at(spark.createDataFrame(rows, LOG), 50.0).collect()}
    for p in (0, 1):
        cash, seq, pos, marked = 50.0, 0, {}, 50.0
        for _, i, _, s, kind, sym, price, side, units, fee, amount, _, _ in sorted((r for r in rows if r[0] == p), key=lambda r: (r[2], r[1])):
            if kind == "ORDER_EXECUTED":
                u = units if side == "BUY" else -units
                cash -= u * price + fee
                old = pos.get(sym, (0.0, 0.0, 0.0))
                pos[sym] = (old[0] + u, price, old[2])
            elif kind == "MARKET_TICK" and sym in pos:
                pos[sym] = (pos[sym][0], price, pos[sym][2])
            elif kind == "YIELD_ACCRUED":
                cash += amount
                if sym in pos:
                    pos[sym] = (*pos[sym][:2], pos[sym][2] + amount)
            seq = s if s > 0 else seq + 1
            equity = cash + sum(a * b for a, b, _ in pos.values())
            if kind in ("ORDER_EXECUTED", "MARKET_TICK"):
                marked = equity
            assert (got[i].cash, got[i].equity, got[i].event_sequence) == (pytest.approx(cash), pytest.approx(equity), seq)
        for sym, (u, price, y) in pos.items():
            f = final[p, sym]
            assert (f.units, f.price, f.accrued_yield) == (pytest.approx(u), price, pytest.approx(y))
            assert f.weight == pytest.approx(u * price / marked if marked > 0 else 0.0)


def test_two_level_scan_equals_window(spark):
    from pyspark.sql import Window as W

    df = spark.createDataFrame([(k, i, float((i * 7) % 11) if i % 3 else None) for k in "ab" for i in range(100)], "k string, i long, v double")
    w = W.partitionBy("k").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    v = F.col("v")
    want = df.select("k", "i", F.coalesce(F.sum(v).over(w), F.lit(0.0)).alias("s"), F.max(v).over(w).alias("m"), F.last(v, ignorenulls=True).over(w).alias("l"))
    got = two_level_scan(df, ["k"], ["i"], F.floor(F.col("i") / 13), {"s": v}, {"m": v}, {"l": v}).select("k", "i", "s", "m", "l")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def opened(spark, events):
    positions = spark.createDataFrame([(1, "BTC", 1.0, 50_000.0, 0.5, 3.0)], "portfolio_id long, symbol string, units double, price double, weight double, accrued_yield double")
    starts = spark.createDataFrame([(1, 50_000.0, 100_000.0, dt.datetime(2023, 1, 1), 7, 11.0, 22.0)], "portfolio_id long, cash double, equity double, ts timestamp, event_sequence long, unrealized_pnl double, margin_used double")
    return ledger.with_initial(events, positions, starts)


def test_tick_on_initial_positions(spark):
    """1 BTC at 50,000 beside as much cash; a tick to 60,000 gives equity 110,000 and weight 60 / 110."""
    events = opened(spark, log(spark, ("MARKET_TICK", "BTC", 60_000.0, None, None, None, None)))
    r = ledger.portfolio_state(events, 0.0).collect()
    assert len(r) == 1 and (r[0].cash, r[0].equity, r[0].event_sequence, r[0].unrealized_pnl, r[0].margin_used, r[0].initial_equity) == (50_000.0, 110_000.0, 8, 11.0, 22.0, 100_000.0)
    assert r[0].as_of == T0
    (p,) = ledger.state_at(events, 0.0).collect()
    assert (p.units, p.price, p.notional, p.accrued_yield, p.cash, p.equity) == (1.0, 60_000.0, 60_000.0, 3.0, 50_000.0, 110_000.0) and p.weight == 60_000 / 110_000
    (q,) = ledger.position_ledger(events).collect()
    assert (q.position_units, q.position_price, q.notional, q.accrued_yield) == (1.0, 60_000.0, 60_000.0, 3.0)
    assert ledger.position_weights(events, 0.0).first().weight == 60_000 / 110_000


def test_given_equity_and_weights_hold_until_revalued(spark):
    """Other events carry them; a yield revalues equity but not weights; a late timestamp stays the largest."""
    positions = spark.createDataFrame([(1, "BTC", 1.0, 50_000.0, 0.9)], "portfolio_id long, symbol string, units double, price double, weight double")
    starts = spark.createDataFrame([(1, 50_000.0, 123.0, dt.datetime(2030, 1, 1))], "portfolio_id long, cash double, equity double, ts timestamp")
    events = ledger.with_initial(log(spark, ("DERIVATIVES_METRICS", "BTC", None, None, None, None, None), ("YIELD_ACCRUED", "BTC", None, None, None, None, 10.0)), positions, starts)
    a, b = ledger.portfolio_state(events, 0.0).orderBy("event_id").collect()
    assert (a.equity, b.equity, a.event_sequence, b.event_sequence, a.as_of) == (123.0, 100_010.0, 1, 2, dt.datetime(2030, 1, 1))
    p = ledger.state_at(events, 0.0).first()
    assert (p.weight, p.accrued_yield, p.equity) == (0.9, 10.0, 100_010.0)
    only = ledger.state_at(events.where("event_type <> 'YIELD_ACCRUED'"), 0.0).first()
    assert (only.weight, only.equity) == (0.9, 123.0)
    d = {r.snapshot: r.equity for r in ledger.daily_equity(ledger.portfolio_state(events, 0.0), 0.0).collect()}
    assert d[0] == 123.0 and ledger.backtest_summary(ledger.portfolio_state(events, 0.0), 0.0).first().total_return_pct == pytest.approx((100_010 - 123) / 123 * 100)


def test_a_hot_symbol_is_many_tasks(spark, monkeypatch):
    """All events of one portfolio and one symbol, over a year: windows are cut in time, results stay the same."""
    monkeypatch.setattr("foliospark.functions.scan.HOT_ROWS", 300)
    rows = [(1, i, T0 + dt.timedelta(hours=3 * i), i, "MARKET_TICK" if i % 3 else "ORDER_EXECUTED", "A", 50.0 + (i * 37) % 11, "BUY" if i % 2 else "SELL", 1.0, 0.1, None, None, None) for i in range(3000)]
    events = spark.createDataFrame(rows, LOG)
    cash, units, peak = 1000.0, 0.0, 1000.0
    got = {r.event_id: r for r in ledger.drawdown(ledger.portfolio_state(events, 1000.0), 1000.0).collect()}
    events = events.withColumn("funding_rate", F.lit(0.0))
    latest = {r.event_id: r.latest_price for r in signals.asof_market(events).collect()}
    price = None
    for _, i, _, _, kind, _, p, side, u, fee, *_ in rows:
        if kind == "ORDER_EXECUTED":
            units += u if side == "BUY" else -u
            cash -= (u if side == "BUY" else -u) * p + fee
        else:
            price = p
        equity = cash + units * p
        peak = max(peak, equity)
        assert (got[i].cash, got[i].equity) == (pytest.approx(cash), pytest.approx(equity)) and got[i].drawdown == pytest.approx((equity - peak) / peak) and latest[i] == price
    # windows over events of hot keys are cut by _b or _chunk; those of whole keys see a row for each piece, or cold keys (tests/test_scan.py)
    for df in (ledger.portfolio_state(events, 1.0), signals.asof_market(events), signals.realized_vol_30(events)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        over_events = [x for x in plan.splitlines() if "Window [" in x and "unboundedpreceding$(), -1)" not in x]
        assert any("_b#" in x for x in over_events)


def test_volatility_over_chunks(spark):
    rows = [(1, i, T0 + dt.timedelta(minutes=i), 0, "MARKET_TICK", "A" if i % 5 else "B", 50.0 + (i * 37) % 11, None, None, None, None, None, None) for i in range(400)]
    got = {r.event_id: r.realized_vol for r in signals.realized_vol_30(spark.createDataFrame(rows, LOG), chunk=40).collect()}
    for s in "AB":
        own = [r for r in rows if r[5] == s]
        p = np.array([r[6] for r in own])
        rets = p[1:] / p[:-1] - 1
        for k, r in enumerate(own):
            assert got[r[1]] == pytest.approx(0.3 if k < 5 else rets[max(0, k - 29) : k].std(ddof=1) * 365**0.5)


def test_lags_and_null_keys(spark):
    df = spark.createDataFrame([(None if i % 2 else "k", i, None if i == 4 else float(i)) for i in range(12)], "k string, i long, v double")
    got = {r.i: (r.n, r.p) for r in two_level_scan(df, ["k"], ["i"], F.floor(F.col("i") / 4), sums={"n": F.lit(1)}, lags={"p": F.col("v")}).collect()}
    assert got == {i: (i // 2 + 1, None if i < 2 or i == 6 else float(i - 2)) for i in range(12)}


def test_deflated_sharpe_by_hand(spark):
    """z, dsr and the gate against the formula with a normal distribution of the standard library."""
    from statistics import NormalDist

    r = np.random.default_rng(1)
    series = {k: r.normal(0.004 * k, 0.01, 200) + 0.002 * r.exponential(size=200) for k in range(4)}
    df = spark.createDataFrame([(k, 0, i, float(x)) for k, xs in series.items() for i, x in enumerate(xs)], "strategy_id long, family_id long, idx long, ret double")
    sharpe = {k: x.mean() / x.std(ddof=1) * 365**0.5 for k, x in series.items()}
    n, var = 4, np.var(list(sharpe.values()), ddof=1)
    inv = NormalDist().inv_cdf
    star = var**0.5 * ((1 - validation.EULER_GAMMA) * inv(1 - 1 / n) + validation.EULER_GAMMA * inv(1 - 1 / (n * np.e)))
    got = {x.strategy_id: x for x in validation.deflated_sharpe(df).collect()}
    for k, x in series.items():
        c = x - x.mean()
        skew, kurt = (c**3).mean() / (c**2).mean() ** 1.5, (c**4).mean() / (c**2).mean() ** 2
        z = (sharpe[k] - star) / (max(1e-12, 1 - skew * sharpe[k] + (kurt - 1) / 4 * sharpe[k] ** 2) / 199) ** 0.5
        assert got[k].sharpe_star == pytest.approx(star) and got[k].z == pytest.approx(z) and got[k].dsr == pytest.approx(NormalDist().cdf(z), abs=1e-9)
        assert got[k].is_valid == (NormalDist().cdf(z) >= 0.95 and np.mean([s <= 0 for s in sharpe.values()]) < 0.1)
    bad = {x.strategy_id for x in validation.overfit_gate(validation.deflated_sharpe(df)).collect()}
    assert bad == {k for k in got if got[k].dsr < 0.95} and 0 < len(bad) < 4


def test_rejection_texts(spark):
    current = spark.createDataFrame([(1, "BTC", 0.5), (1, "SOL", 0.3), (1, "ETH", 0.2)], "portfolio_id long, symbol string, weight double")
    target = spark.createDataFrame([(1, "BTC", 0.51), (1, "SOL", 0.1), (1, "ETH", 0.39)], "portfolio_id long, symbol string, weight double")
    assets = spark.createDataFrame([("BTC", "CORE", 5e6), ("ETH", "CORE", 1e-6), ("SOL", "SATELLITE", 5e6)], "symbol string, category string, depth_2pct double")
    equity = spark.createDataFrame([(1, 1e6)], "portfolio_id long, equity double")
    got = {r.symbol: r.rejection_reason for r in execution.weight_drift(current, target, equity, assets).collect()}
    assert got["BTC"].startswith("Drift") and got["SOL"] is None and got["ETH"].startswith("Execution")


def test_events_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([('{"event_id":"e1","ts":"2024-01-02T03:04:05Z","event_type":"MARKET_TICK","symbol":"BTC","price":5.5,"bids":{"50.5":1,"x":2}}',), ("broken",)], "value string")
    parsed = feeds.parse_events(lines)
    assert parsed.where("symbol = 'BTC'").first().bids == {50.5: 1.0}
    assert [(r.event_type, r.symbol, r.price) for r in parsed.where("event_type IS NOT NULL").collect()] == [("MARKET_TICK", "BTC", 5.5)] and parsed.count() == 2
    feeds.write_events(parsed.where("event_type IS NOT NULL"), str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 1 and str(back.first().event_date) == "2024-01-02"


def test_streams_over_several_files(spark, tmp_path):
    """State is carried from one micro-batch to the next; the end equals the batch operators."""
    from foliospark.plans import registry
    from foliospark.sources.views import view

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    d = str(tmp_path)
    for k in range(3):  # three files, in order of time
        lo, hi = events.approxQuantile("event_id", [k / 3, (k + 1) / 3], 0)
        events.where((F.col("event_id") >= lo if k == 0 else F.col("event_id") > lo) & (F.col("event_id") <= hi)).orderBy("ts", "event_id").coalesce(1).write.mode("append").parquet(f"{d}/events.parquet")
    log = view(spark, d, "ledger")
    ordered = log.orderBy("event_id").select("ts").collect()
    assert [r.ts for r in ordered] == sorted(r.ts for r in ordered)
    want = {r.portfolio_id: (r.cash, r.equity) for r in ledger.state_at(log, registry.CASH).select("portfolio_id", F.round("cash", 4).alias("cash"), F.round("equity", 4).alias("equity")).distinct().collect()}
    got = {r.portfolio_id: (r.cash, r.equity) for r in registry.stream_portfolio_state(spark, d).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    vols = {r.symbol: r.realized_vol for r in signals.realized_vol_30(log.where("event_type = 'MARKET_TICK'")).groupBy("symbol").agg(F.max_by("realized_vol", F.struct("ts", "event_id")).alias("realized_vol")).collect()}
    cache = {r.symbol: r for r in registry.stream_market_cache(spark, d).collect()}
    assert all(cache[s].realized_vol == pytest.approx(v, abs=1e-6) for s, v in vols.items())


def test_stream_step_equals_batch(spark):
    import pandas as pd

    rows = pd.DataFrame(random_log(9), columns=[c.split()[0] for c in LOG.split(", ")]).sort_values(["ts", "event_id"])
    positions: dict = {}
    mine = rows[rows.portfolio_id == 1]
    cash = apply_events(apply_events(5.0, positions, mine[:20]), positions, mine[20:])
    end = ledger.state_at(spark.createDataFrame(random_log(9), LOG), 5.0).where("portfolio_id = 1").collect()
    assert cash == pytest.approx(end[0].cash)
    assert {r.symbol: (pytest.approx(r.units), r.price, pytest.approx(r.accrued_yield)) for r in end} == {k: tuple(v) for k, v in positions.items()}


def test_depth(spark):
    levels = [(1, "BID", 50_000.0, 1.0), (1, "BID", 49_500.0, 2.0), (1, "BID", 48_000.0, 5.0), (1, "ASK", 50_100.0, 1.5), (1, "ASK", 50_500.0, 2.5), (1, "ASK", 52_000.0, 10.0), (2, "BID", 1.0, 1.0)]
    got = feeds.book_depth_2pct(spark.createDataFrame(levels, "book_id long, side string, price double, size double")).orderBy("book_id").collect()
    assert [tuple(r) for r in got] == [(1, 3.0, 4.0), (2, 0.0, 0.0)]
    book = spark.createDataFrame([({p: s for _, d, p, s in levels if d == "BID" and _ == 1}, {p: s for _, d, p, s in levels if d == "ASK"})], "bids map<double,double>, asks map<double,double>")
    assert tuple(feeds.map_depth_2pct(book).first())[2:] == (3.0, 4.0)
    empty = spark.createDataFrame([({}, {1.0: 1.0})], "bids map<double,double>, asks map<double,double>")
    assert tuple(feeds.map_depth_2pct(empty).first())[2:] == (0.0, 0.0)


def test_ticks_are_cast_strictly(spark):
    raw = spark.createDataFrame([("1.0", "BTC", "5", "2", "x")], "timestamp string, symbol string, price string, volume string, extra string")
    assert tuple(feeds.normalize_ticks(raw).first()) == (1.0, "BTC", 5.0, 2.0)
    bad = raw.withColumn("price", F.lit("abc"))
    with pytest.raises(Exception):
        feeds.normalize_ticks(bad).collect()
    assert feeds.normalize_ticks(bad, "null").first().price is None
    assert feeds.normalize_ticks(raw.limit(0)).count() == 0


def test_event_log_rejects(spark):
    rows = spark.createDataFrame([("MARKET_TICK", None), ("ORDER_EXECUTED", "BUY"), ("ORDER_EXECUTED", "HOLD"), ("OTHER", None), (None, None)], "event_type string, side string")
    good, bad = feeds.event_log(rows)
    assert (good.count(), bad.count()) == (2, 3)


@pytest.mark.parametrize("oi,want", [((600.0, 400.0), (60.0, True)), ((400.0, 600.0), (40.0, False)), ((0.0, 0.0), (0.0, False))])
def test_margin(spark, oi, want):
    r = signals.margin_ratio(spark.createDataFrame([oi], "crypto_margined_oi double, cash_margined_oi double")).first()
    assert (r.margin_ratio, r.alert) == want


def test_regimes(spark):
    df = spark.createDataFrame([(100.0, 50.0), (100.0, -50.0), (-100.0, 50.0), (-100.0, -50.0)], "spot_cvd double, perp_cvd double")
    assert [r.cvd_regime for r in signals.cvd_regime(df).collect()] == list(signals.REGIMES)
    f = spark.createDataFrame([(None, None, None, None), (1.0, 1.0, 0.5, 0.2), (1.0, 1.0, 0.1, 0.0)], "cvd_delta double, depth_ratio double, nupl double, roc_30d double")
    assert [r.gamma for r in signals.regime_rules(f).collect()] == [2.0, 1.0, 3.0]


def test_trade_cost(spark):
    df = spark.createDataFrame([(100_000.0, 1_000_000.0, 500.0), (0.0, 100_000.0, 0.0)], "notional double, depth_2pct double, ter double")
    a, z = execution.trade_cost(df).collect()
    assert (a.spread_cost, a.fee_cost, round(a.impact_cost, 4), round(a.total_cost, 4), a.effective) == (25.0, 50.0, 3.9528, 78.9528, True)
    assert (z.total_cost, z.effective) == (0.0, True)


def test_drift_bands(spark):
    w = lambda **k: spark.createDataFrame([(1, s, x) for s, x in k.items()], "portfolio_id long, symbol string, weight double")
    assets = spark.createDataFrame([("BTC", "CORE", 1e7), ("ETH", "CORE", 1e7), ("SOL", "SATELLITE", 1e7)], "symbol string, category string, depth_2pct double")
    eq = spark.createDataFrame([(1, 1e6)], "portfolio_id long, equity double")
    d = execution.weight_drift(w(BTC=0.5, ETH=0.2, SOL=0.3), w(BTC=0.4, ETH=0.2, SOL=0.4), eq, assets)
    assert {r.symbol: r.breached for r in d.collect()} == {"BTC": True, "ETH": False, "SOL": True}
    assert execution.rebalance_decision(d).first().triggered == ["BTC", "SOL"]


def test_pretrade(spark):
    assets = spark.createDataFrame([("BTC", "CORE"), ("SOL", "SATELLITE")], "symbol string, category string")
    margins = spark.createDataFrame([(1, 100.0, 100.0), (2, 100.0, 0.0)], "portfolio_id long, collateral double, required_margin double")
    w = spark.createDataFrame([(1, "BTC", 0.75), (1, "SOL", 0.25), (2, "BTC", 1.0)], "portfolio_id long, symbol string, weight double")
    a, b = execution.pretrade_check(w, assets, margins).orderBy("portfolio_id").collect()
    assert a.violations == ["Concentration cap breached for SOL: proposed weight 25.00% > max satellite cap 15.00%", "Liquidation risk: Margin coverage ratio 1.00 below required buffer 1.25"]
    assert b.passed and b.coverage == float("inf")


def test_plan_and_thin_candidate(spark):
    c = spark.createDataFrame([(1, "SOL", 50_000.0), (1, "AVAX", 5_000.0), (2, None, None)], "plan_id long, symbol string, depth_2pct double")
    got = {(r.plan_id, r.symbol): round(r.weight, 9) for r in allocation.allocation_plan(c).collect()}
    assert got[1, "SOL"] == 0.15 and got[1, "BUIDL"] == 0.25 and (1, "AVAX") not in got and got[2, "BUIDL"] == 0.40


def test_attribution(spark):
    w = spark.createDataFrame([(1, "BTC", 0.4), (1, "ETH", 0.2), (1, "BUIDL", 0.1)], "portfolio_id long, symbol string, weight double")
    a = spark.createDataFrame([("BTC", 1.0, 0.01, None), ("ETH", 1.2, 0.02, None), ("BUIDL", None, None, 0.045)], "symbol string, beta double, funding double, apy double")
    r = attribution.pnl_attribution(w, a, spark.createDataFrame([(1, 0.10, 0.15)], "portfolio_id long, total_return double, benchmark_return double")).first()
    assert [round(x, 6) for x in (r.factor, r.carry, r.rwa, r.residual)] == [0.096, 0.008, 0.0045, -0.0085]


def test_risk_parity():
    cov = np.array([[0.04, 0.02, 0.01], [0.02, 0.09, 0.03], [0.01, 0.03, 0.16]])
    w = risk_parity(cov)
    assert w == pytest.approx([0.46625, 0.29256, 0.24118], abs=1e-4)
    rc = w * (cov @ w)
    assert rc == pytest.approx(rc.mean() * np.ones(3), rel=1e-5)
    assert risk_parity(np.zeros((2, 2))) == pytest.approx([0.5, 0.5]) and len(risk_parity(np.zeros((0, 0)))) == 0


def test_gram_equals_self_join(spark):
    r = np.random.default_rng(1).normal(size=(40, 3))
    long = spark.createDataFrame([(0, i, j, float(r[i, j])) for i in range(40) for j in range(3)], "grp long, obs long, asset long, ret double")
    wide = spark.createDataFrame([(0, [float(x) for x in row]) for row in r], "grp long, x array<double>")
    key = lambda df: {(x.i, x.j): pytest.approx(x["cov"]) for x in df.collect()}
    assert key(allocation.gram_covariance(wide, 3)) == {(x.i, x.j): x["cov"] for x in allocation.returns_covariance(long).collect()}


def test_cpcv(spark):
    rets = spark.range(120).select(F.lit(1).alias("strategy_id"), F.col("id").alias("idx"), F.rand(3).alias("ret"))
    roles = validation.cpcv_splits(rets, purge=2, embargo=2).groupBy("split_id").pivot("role").count().fillna(0).orderBy("split_id").collect()
    assert len(roles) == 15 and all(r.test == 40 for r in roles) and roles[0].train == 78
    few = validation.cpcv_splits(rets.where("idx < 3")).where("split_id = 0").select("role").distinct().collect()
    assert [r.role for r in few] == ["embargoed"]
    paths = {r.split_id: r.sharpe for r in validation.cpcv_path_sharpe(rets).collect()}
    x = np.array([r.ret for r in rets.orderBy("idx").collect()])[:40]
    assert paths[0] == pytest.approx(x.mean() / x.std(ddof=1) * np.sqrt(365))


def test_sharpe_star_and_gate(spark):
    t = spark.createDataFrame([(1, x) for x in (1.2, 0.8, 0.5, 1.1, 0.9, 0.4)], "family_id long, sharpe double")
    assert validation.trial_sharpe_star(t).first().sharpe_star == pytest.approx(0.414553, abs=1e-5)
    g = spark.createDataFrame([(0.98, 0.05), (0.98, 0.15), (0.85, 0.02), (None, 0.01)], "dsr double, pbo double")
    assert validation.overfit_gate(g).count() == 3
    with pytest.raises(ValueError, match="PBO=0.1500"):
        validation.overfit_gate(g.where("pbo > 0.1"), fail=True)


def test_short_and_constant_returns(spark):
    rows = [(1, 1, 0.01), (1, 1, 0.02)] + [(2, 1, 0.5)] * 10
    got = {r.strategy_id: r for r in validation.deflated_sharpe(spark.createDataFrame(rows, "strategy_id long, family_id long, ret double")).collect()}
    assert (got[1].dsr, got[1].pbo, got[1].is_valid) == (0.0, 1.0, False)
    assert got[2].dsr is None and not got[2].is_valid


def test_season_of_a_day_without_assets(spark):
    days = spark.createDataFrame([(1,), (2,)], "day long")
    rets = spark.createDataFrame([(1, "BTC", 0.2), (1, "ETH", 0.3), (1, "SOL", 0.5), (1, "AVAX", 0.1), (1, "LINK", 0.05)], "day long, symbol string, ret double")
    got = signals.altcoin_season_index(days, rets, "BTC").orderBy("day").collect()
    assert [(r.score, r.season) for r in got] == [(50.0, "TRANSITIONAL_ROTATION"), (0.0, "BITCOIN_DOMINANCE")]


def test_explicit_targets_replay():
    import pandas as pd

    base = dict(side=None, units=np.nan, fee=0.0, amount=0.0, risk_divisor=1.0, sequence=0, target_weights=None)
    px = {f"px_{s}": np.nan for s in replay.SYMBOLS} | {f"vol_{s}": np.nan for s in replay.SYMBOLS}
    rows = [base | px | dict(event_type="MARKET_TICK", symbol="BTC", price=100.0, px_BTC=100.0), base | px | dict(event_type="MARKET_TICK", symbol="ETH", price=10.0, px_BTC=100.0, px_ETH=10.0)]
    rows.append(base | px | dict(event_type="REBALANCE_TRIGGERED", symbol=None, price=np.nan, px_BTC=100.0, px_ETH=10.0, target_weights={"BTC": 0.5, "ETH": 0.5}))
    out = replay.replay_policy(pd.DataFrame(rows), replay.Policy(0), 10_000.0)
    assert out["n_orders"] == 2 and out["final_equity"] == pytest.approx(10_000 - out["fees"])


def test_regime_model_learns(spark):
    rows = [(100.0 + i, 1.5, 0.7, 0.2, 0) for i in range(8)] + [(-100.0 - i, 0.5, 0.1, -0.2, 1) for i in range(8)] + [(0.0 + i / 10, 1.0, 0.4, 0.0, 2) for i in range(8)]
    df = spark.createDataFrame(rows, "cvd_delta double, depth_ratio double, nupl double, roc_30d double, label long")
    assert regime_model.train(df.limit(0)) == []
    out = regime_model.classify(df, regime_model.train(df, trees=3)).collect()
    assert all(r.regime == regime_model.NAMES[r.label] for r in out)
