"""As-of joins of two tables, states at many instants, rolling covariances: against plain loops, hand values and odd rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import allocation, ledger, signals
from tests.test_operators import LOG, T0, opened, random_log

LEFT, RIGHT = "k string, ts timestamp, id long, price double, note string", "k string, at timestamp, seq long, price double, size long"


def feeds(seed, n=150, m=150):
    draw = random.Random(seed)
    at = lambda: None if draw.random() < 0.05 else T0 + dt.timedelta(seconds=draw.randrange(200))
    key = lambda: draw.choice(["a", "a", "a", "b", "c", None])
    left = [(key(), at(), i, float(i), None if i % 5 == 0 else "x") for i in range(n)]
    right = [(key(), at(), i, draw.choice([None, float(i)]), i * 10) for i in range(m)]
    return left, right


def plain_asof(left, right, tolerance, exact):
    out = []
    for k, ts, i, *_ in left:
        ok = [r for r in right if r[0] == k and k is not None and ts is not None and r[1] is not None and (r[1] <= ts if exact else r[1] < ts)]
        best = max(ok, key=lambda r: (r[1], r[2]), default=None)
        if best and tolerance is not None and (ts - best[1]).total_seconds() > tolerance:
            best = None
        out.append((i, *(best[1:] if best else (None,) * 4)))
    return sorted(out)


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("tolerance", [None, 5, 0])
@pytest.mark.parametrize("hot", [1 << 20, 20])
def test_asof_join_equals_plain_loops(spark, monkeypatch, exact, tolerance, hot):
    """Keys and times NULL, ties, clashing names, repeated rows, and one symbol with half of all rows cut in pieces."""
    monkeypatch.setattr("foliospark.functions.scan.HOT_ROWS", hot)
    left, right = feeds(7)
    a, b = spark.createDataFrame(left + left[:3], LEFT), spark.createDataFrame(right, RIGHT)
    got = signals.asof_join(a, b, ["k"], "ts", "at", ["seq", "price", "size"], ("seq",), tolerance, exact, prefix="r_")
    assert got.columns == [*a.columns, "matched_at", "r_seq", "r_price", "r_size"]
    rows = sorted(((r.id, r.matched_at, r.r_seq, r.r_price, r.r_size) for r in got.collect()), key=lambda r: r[0])
    assert rows == sorted(plain_asof(left + left[:3], right, tolerance, exact), key=lambda r: r[0])
    assert {r.id: (r.k, r.ts, r.price, r.note) for r in got.collect()} == {i: (k, ts, p, x) for k, ts, i, p, x in left}


def test_asof_join_of_empty_sides_dates_and_numbers(spark):
    left, right = feeds(3, 20, 20)
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    join = lambda x, y: signals.asof_join(x, y, ["k"], "ts", "at", ["seq"])
    assert join(a.limit(0), b).count() == 0
    assert join(a, b.limit(0)).where("seq IS NOT NULL OR matched_at IS NOT NULL").count() == 0 and join(a, b.limit(0)).count() == 20
    days = spark.createDataFrame([(1, dt.date(2024, 1, 10)), (1, dt.date(2024, 1, 20))], "k int, d date")
    marks = spark.createDataFrame([(1, dt.date(2024, 1, 8), 5.0)], "k int, d date, v double")
    assert [r.v for r in signals.asof_join(days, marks, ["k"], "d", "d", ["v"], tolerance=3).orderBy("d").collect()] == [5.0, None]
    numbers = signals.asof_join(spark.range(5).selectExpr("1 as k", "id * 10 as n"), spark.createDataFrame([(1, 15, "x"), (1, 30, "y")], "k int, n long, v string"), ["k"], "n", "n", ["v"], tolerance=12)
    assert [r.v for r in numbers.orderBy("n").collect()] == [None, None, "x", "y", "y"]


def test_asof_join_is_one_shuffle_without_a_range_join(spark):
    left, right = feeds(1)
    plan = signals.asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "ts", "at", ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


# ---- states at many instants


def key(r):
    return r.portfolio_id, r.symbol


def values(r):
    return pytest.approx((r.units, r.price, r.accrued_yield, r.notional, r.cash, r.weight, r.equity))


@pytest.mark.parametrize("seed,hot", [(1, 1 << 20), (2, 1 << 20), (3, 30)])
def test_states_at_equal_one_state_each(spark, monkeypatch, seed, hot):
    monkeypatch.setattr("foliospark.functions.scan.HOT_ROWS", hot)
    events = spark.createDataFrame(random_log(seed), LOG)
    instants = [T0 + dt.timedelta(minutes=m, seconds=s) for m, s in ((-1, 0), (0, 0), (3, 0), (11, 30), (25, 0), (39, 0), (500, 0))]
    got = {}
    for r in ledger.states_at(events, 50.0, [*instants, instants[2]]).collect():
        assert (r.as_of, *key(r)) not in got
        got[(r.as_of, *key(r))] = r
    seen = 0
    for t in instants:
        one = {key(r): r for r in ledger.state_at(events, 50.0, t).collect()}
        assert {k[1:] for k in got if k[0] == t} == set(one)
        for k, r in one.items():
            g = got[(t, *k)]
            assert (g.units, g.price, g.accrued_yield, g.notional, g.cash, g.weight, g.equity) == values(r)
            seen += 1
    assert seen > 15


def test_states_at_own_instants_of_portfolios(spark):
    events = spark.createDataFrame(random_log(4), LOG)
    asked = spark.createDataFrame([(0, T0 + dt.timedelta(minutes=9)), (0, T0 + dt.timedelta(minutes=9)), (1, T0 + dt.timedelta(minutes=21)), (7, T0), (None, T0)], "portfolio_id long, ts timestamp")
    got = {key(r): (r.as_of, r.units) for r in ledger.states_at(events, 50.0, asked).collect()}
    want = {}
    for p, m in ((0, 9), (1, 21)):
        t = T0 + dt.timedelta(minutes=m)
        want |= {key(r): (t, r.units) for r in ledger.state_at(events, 50.0, t).collect() if r.portfolio_id == p}
    assert got == want and want


def test_states_at_from_given_positions(spark):
    """Given weights and equity hold until a tick revalues them."""
    events = opened(spark, spark.createDataFrame([(1, 1, T0 + dt.timedelta(minutes=10), 0, "MARKET_TICK", "BTC", 60_000.0, None, None, None, None, None, None)], LOG))
    early, late = ledger.states_at(events, 0.0, [T0, T0 + dt.timedelta(hours=1)]).orderBy("as_of").collect()
    assert (early.units, early.price, early.weight, early.equity, early.accrued_yield, early.cash) == (1.0, 50_000.0, 0.5, 100_000.0, 3.0, 50_000.0)
    assert (late.price, late.weight, late.equity) == (60_000.0, 60_000 / 110_000, 110_000.0)


@pytest.mark.parametrize("seed", [1, 5])
def test_state_goes_on_from_a_snapshot(spark, seed):
    events = spark.createDataFrame(random_log(seed), LOG)
    half = T0 + dt.timedelta(minutes=18)
    positions, starts = ledger.snapshot(events, 50.0, half)
    later = ledger.with_initial(events.where(F.col("ts") > F.lit(half)), positions, starts)
    for t in (half, T0 + dt.timedelta(minutes=30), None):
        want = {key(r): r for r in ledger.state_at(events, 50.0, t).collect()}
        got = {key(r): r for r in ledger.state_at(later, 50.0, t).collect()}
        assert got.keys() == want.keys() and want
        for k, r in want.items():
            g = got[k]
            assert (g.units, g.price, g.accrued_yield, g.notional, g.cash, g.weight, g.equity) == values(r)


def test_instants_read_the_log_in_one_pass(spark, tmp_path):
    """A count of keys, the list of symbols and the states: three scans, however many instants."""
    spark.createDataFrame(random_log(1), LOG).write.parquet(str(tmp_path / "log"))
    events = spark.read.parquet(str(tmp_path / "log"))
    scans = []
    for n in (2, 200):
        plan = ledger.states_at(events, 50.0, [T0 + dt.timedelta(seconds=7 * i) for i in range(n)])._jdf.queryExecution().executedPlan().toString()
        scans.append(plan.count("FileScan"))
    assert scans == [2, 2]
    with pytest.raises(ValueError):
        ledger.states_at(events, 50.0, [T0], ("event_id",))


def test_states_at_no_events(spark):
    assert ledger.states_at(spark.createDataFrame([], LOG), 50.0, [T0]).count() == 0


# ---- rolling covariance


def returns_of(seed, days=47):
    draw = random.Random(seed)
    return [(g, d, a, None if draw.random() < 0.1 else draw.gauss(0.5, 0.01)) for g in (0, 1) for d in range(days) for a in "xyz" if draw.random() > 0.15]


@pytest.mark.parametrize("window,step", [(10, 5), (6, 6), (8, 1)])
def test_rolling_covariance_equals_numpy(spark, window, step):
    rows = returns_of(3)
    got = {(r.grp, r.as_of, r.i, r.j): (r.n, r["cov"]) for r in allocation.rolling_covariance(spark.createDataFrame(rows, "grp int, obs int, asset string, ret double"), window, step).collect()}
    want = {}
    for g in (0, 1):
        seen = sorted({d for h, d, *_ in rows if h == g})
        value = {(d, a): x for h, d, a, x in rows if h == g and x is not None}
        for b in range(0, len(seen), step):
            last = seen[b : b + step]
            inside = seen[max(0, b + step - window) : b + step]
            for i in "xyz":
                for j in "xyz":
                    both = [(value[d, i], value[d, j]) for d in inside if (d, i) in value and (d, j) in value]
                    if i <= j and both:
                        want[g, last[-1], i, j] = (len(both), np.cov(np.array(both).T)[0, 1] if len(both) > 1 else None)
    assert got.keys() == want.keys()
    for k, (n, c) in want.items():
        assert got[k][0] == n and got[k][1] == (None if c is None else pytest.approx(c, rel=1e-9, abs=1e-13)), k


def test_rolling_covariance_parameters_and_empty(spark):
    empty = spark.createDataFrame([], "grp int, obs int, asset string, ret double")
    assert allocation.rolling_covariance(empty, 4, 2).count() == 0
    with pytest.raises(ValueError):
        allocation.rolling_covariance(empty, 5, 2)


def test_rolling_rows_follow_pairs_not_windows(spark):
    """The sums table has a row for each bucket and pair; the join meets each observation once."""
    df = spark.createDataFrame([(0, d, a, float(d * a)) for d in range(60) for a in range(3)], "grp int, obs int, asset int, ret double")
    assert allocation.rolling_covariance(df, 30, 2).count() == 30 * 6


# ---- wide universes


@pytest.mark.parametrize("n,tile,chunk,obs", [(37, 8, 10, 60), (8, 8, 1000, 20), (5, 16, 3, 9), (1, 4, 4, 6)])
def test_tiles_equal_numpy(spark, n, tile, chunk, obs):
    r = np.random.default_rng(n)
    x = {g: r.normal(1000.0, 1.0, (obs, n)) for g in (0, 1)}
    rows = [(g, t, x[g][t].tolist()) for g in x for t in range(obs)]
    got = {(k.grp, k.i, k.j): k["cov"] for k in allocation.tiled_covariance(spark.createDataFrame(rows, "grp long, obs long, x array<double>").repartition(3), n, tile, chunk).collect()}
    assert len(got) == 2 * n * (n + 1) // 2
    for g in x:
        want = np.atleast_2d(np.cov(x[g].T))
        for i in range(n):
            for j in range(i, n):
                assert got[g, i, j] == pytest.approx(want[i, j], abs=1e-10)


def test_5000_assets_by_tiles(spark):
    n, tile = 5000, 1250
    rows = spark.range(12).select(F.lit(1).cast("long").alias("grp"), F.col("id").alias("obs"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.sin(F.col("id") * 7919 + k * k)).alias("x"))
    out = allocation.tiled_covariance(rows, n, tile, chunk=4096)
    plain = {k.i: k["cov"] for k in out.where("i = j AND i % 500 = 0").collect()}
    x = np.sin(np.arange(12)[:, None] * 7919.0 + np.arange(n)[None, :].astype(float) ** 2)
    assert plain == {i: pytest.approx(x[:, i].var(ddof=1)) for i in range(0, n, 500)}


def test_incomplete_vectors_raise(spark):
    for bad in ([1.0], [1.0, None], None):
        rows = spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 2, bad)], "grp long, obs long, x array<double>")
        with pytest.raises(Exception, match="incomplete"):
            allocation.tiled_covariance(rows, 2).collect()
    assert allocation.tiled_covariance(spark.createDataFrame([], "grp long, obs long, x array<double>"), 2).count() == 0
