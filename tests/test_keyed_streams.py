"""Keyed state: equals the batch operators over files, touches the symbols of a batch only, evicts, and keeps late rows."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from foliospark.operators import ledger
from foliospark.streaming import keyed
from tests.test_operators import LOG, T0, random_log


def run(spark, files, make, schema=LOG):
    """Each list of rows is a file and so a micro-batch; gives (batch number, rows) of the updates."""
    place = tempfile.mkdtemp(prefix="spark-")
    got = []
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{place}/in/f{k:03}")
        with keyed.keyed_state(spark):
            source = spark.readStream.schema(schema).parquet(f"{place}/in/*")
            q = make(source).writeStream.outputMode("update").foreachBatch(lambda b, n: got.append((n, b.collect()))).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    return got


def test_positions_equal_batch_after_every_file(spark):
    rows = sorted(random_log(11, 150), key=lambda r: (r[2], r[1]))
    files = [rows[:50], rows[50:60], rows[60:]]
    for f in files:
        random.Random(3).shuffle(f)  # order inside a batch does not matter
    got = run(spark, files, lambda s: keyed.stream_positions(s, 50.0))
    state: dict = {}
    for n, batch in got:
        for r in batch:
            state[r.portfolio_id, r.symbol] = r
    want = {(r.portfolio_id, r.symbol): r for r in ledger.state_at(spark.createDataFrame(rows, LOG), 50.0).collect()}
    assert {k for k in state if k[1]} == set(want)
    for k, r in want.items():
        assert (state[k].units, state[k].price, state[k].accrued_yield) == pytest.approx((r.units, r.price, r.accrued_yield))
        assert (state[k[0], None].cash, state[k[0], None].equity) == pytest.approx((r.cash, r.equity))
    assert sum(state[p, None].n_events for p in (0, 1)) == 150


def test_a_batch_writes_the_symbols_it_touches(spark):
    """300 symbols held; a batch of two ticks gives two positions and the totals."""
    buy = [(1, i, T0 + dt.timedelta(seconds=i), 0, "ORDER_EXECUTED", f"S{i}", 10.0, "BUY", 1.0, 0.0, None, None, None) for i in range(300)]
    ticks = [(1, 1000 + i, T0 + dt.timedelta(hours=1), 0, "MARKET_TICK", f"S{i}", 20.0, None, None, None, None, None, None) for i in (3, 7)]
    other = [(1, 2000, T0 + dt.timedelta(hours=2), 0, "DERIVATIVES_METRICS", "S1", None, None, None, None, None, 1.0, 1.0)]
    got = [batch for _, batch in run(spark, [buy, ticks, other], lambda s: keyed.stream_positions(s, 5000.0))]
    assert [len(b) for b in got] == [301, 3, 1]
    assert sorted(r.symbol for r in got[1] if r.symbol) == ["S3", "S7"]
    assert [r.equity for r in got[1] if r.symbol is None] == [5020.0] and got[2][0].equity == 5020.0 and got[2][0].n_events == 303


TICK = "symbol string, ts timestamp, event_id long, price double"


def test_symbols_without_ticks_leave_the_state(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    files = [[("A", at(0), 1, 5.0), ("B", at(0), 2, 6.0)], [("A", at(30), 3, 7.0)], [("A", at(90), 4, 8.0)], [("A", at(91), 5, 9.0)], [("B", at(92), 6, 1.0), ("A", at(92), 7, 9.5)]]
    got = run(spark, files, lambda s: keyed.stream_latest_prices(s, "1 minute", 45 * 60_000), TICK)
    rows = [(r.symbol, r.latest_price, r.n_prices, r.evicted) for _, b in got for r in b]
    assert ("B", 6.0, 1, True) in rows and rows.count(("B", 6.0, 1, True)) == 1
    assert ("B", 1.0, 1, False) in rows  # counted anew
    assert ("A", 9.5, 5, False) in rows and not any(s == "A" and e for s, *_, e in rows)


def test_late_rows_are_kept_aside(spark):
    place = tempfile.mkdtemp(prefix="spark-")
    at = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [[("A", at(0), 1, 1.0), ("A", at(100), 2, 1.0)], [("A", at(95), 3, 1.0), ("A", at(89), 4, 1.0), ("A", None, 5, 1.0), ("A", at(200), 6, 1.0)], [("A", at(150), 7, 1.0), ("B", at(190), 8, 1.0)], []]
    for n, rows in enumerate(batches):
        keyed.split_late(spark.createDataFrame(rows, TICK), n, place, 10)
    keyed.split_late(spark.createDataFrame(batches[1], TICK), 1, place, 10)  # run again after a failure
    ids = lambda kind: sorted(r.event_id for r in spark.read.parquet(f"{place}/{kind}").collect())
    assert ids("late") == [4, 7] and ids("on_time") == [1, 2, 3, 5, 6, 8]
    assert spark.read.parquet(f"{place}/late").groupBy("part").count().where(F.col("count") > 0).count() == 2
