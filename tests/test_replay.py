"""The replay takes a portfolio's events in batches, to the results of the whole."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from foliospark.operators import replay

LOG = (
    "portfolio_id long, event_id long, ts timestamp, sequence long, event_type string, symbol string, price double, side string, units double, fee double, amount double, spot_cvd double, "
    "perp_cvd double, target_weights map<string,double>"
)
POLICIES = [replay.Policy(0, rebalance=False), replay.Policy(1), replay.Policy(2, target_vol=0.05, every=3), replay.Policy(3, core_band=0.01, satellite_band=0.01, every=1), replay.Policy(4, target_vol=0.4)]


def random_log(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    kinds = ["ORDER_EXECUTED", "YIELD_ACCRUED", "DERIVATIVES_METRICS", "REBALANCE_TRIGGERED"] + ["MARKET_TICK"] * 4
    asked = [None, None, {}, {"BTC": 0.5, "ETH": 0.3, "BUIDL": 0.2}, {"SOL": 0.9, "BTC": 0.1}]
    out = []
    for i in range(n):
        numbers = [r.choice([None, r.uniform(-9, 9)]) for _ in range(2)]
        out.append((r.choice([7, 7, 8, 9, None]), i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randrange(n // 4)), r.choice([0, i // 3, i]), r.choice(kinds), r.choice([*replay.SYMBOLS, "XRP"]),
            r.uniform(50, 150), r.choice(["BUY", "SELL"]), float(r.randrange(1, 40)), r.random(), r.uniform(-50, 50), *numbers, r.choice(asked)))
    return out


@pytest.mark.parametrize("chunk", [8, 2])
def test_replay_takes_batches_and_equals_the_fold_of_a_whole_portfolio(spark, chunk):
    log = spark.createDataFrame(random_log(3, 700), LOG)
    want = {}
    for key, g in replay.with_signals(log).toPandas().groupby("portfolio_id", dropna=False):
        g = g.sort_values(["ts", "event_id"])
        want |= {(None if key != key else key, p.policy_id): replay.replay_policy(g, p, 20_000.0) for p in POLICIES}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        out = replay.strategy_replay(log, POLICIES, 20_000.0, chunk=chunk)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {(r.portfolio_id, r.policy_id): r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in plan and "Window" not in plan  # both would hold a portfolio whole
    assert got.keys() == want.keys() and len(got) == 20
    assert all(got[k].asDict() | {"portfolio_id": 0} == pytest.approx(w | {"portfolio_id": 0}, rel=1e-12) for k, w in want.items())
    assert all(got[k].n_orders > 0 for k in got if k[1] == 3)


def test_replay_of_no_events(spark):
    assert replay.strategy_replay(spark.createDataFrame([], LOG), POLICIES, 1.0).collect() == []


def test_what_a_task_carries_does_not_grow_with_events():
    """Results of a log ten times as long, fed in batches, come from a state of the same size."""
    sizes = []
    for n in (400, 4000):
        rows = pd.DataFrame(random_log(5, n), columns=[c.split()[0] for c in LOG.split(", ")]).sort_values(["ts", "event_id"])
        signals, paths = replay.Signals(), [replay.Path(p, 20_000.0) for p in POLICIES]
        for k in range(0, n, 50):
            batch = replay.Batch(signals.add(rows[k : k + 50]), n)
            for x in paths:
                x.add(batch)
        assert [x.result()["n_events"] for x in paths] == [n] * len(paths)
        sizes.append(sum(np.size(v) for x in (signals, *paths) for v in vars(x).values()))
    assert sizes[0] == sizes[1] < 500


def test_large_payments_that_cancel_leave_small_ones_whole():
    amounts = [1e12, *[0.01] * 5000, -1e12]
    rows = pd.DataFrame({"amount": amounts, "event_type": "YIELD_ACCRUED", "symbol": "BTC", "side": None, "sequence": 0, "risk_divisor": 1.0})
    rows = rows.assign(**{c: np.nan for c in ("units", "price", "fee", *[f"{x}_{s}" for s in replay.SYMBOLS for x in ("px", "vol")])})
    got = replay.replay_policy(rows, replay.Policy(0, rebalance=False), 1000.0)
    assert got["cash"] == got["final_equity"] == pytest.approx(1050.0, abs=1e-9)
