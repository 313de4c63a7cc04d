"""The event log as a table: repeated batches, pruning, buckets, reopening, odd rows."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from foliospark.operators import ledger
from foliospark.sources import eventlog
from tests.test_operators import LOG, T0, random_log


@pytest.fixture
def table(spark, tmp_path):
    name = f"log_{uuid.uuid4().hex}"
    rows = [(*r[:2], r[2] + dt.timedelta(days=r[1] % 4), *r[3:]) for r in random_log(3, 160)]
    events = spark.createDataFrame(rows, LOG)
    eventlog.open_log(spark, name, str(tmp_path / "log"), events, 4)
    yield name, events, str(tmp_path / "log")
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def same(a, b):
    columns = sorted(a.columns)
    return sorted(map(str, a.select(*columns).collect())) == sorted(map(str, b.select(*columns).collect()))


def test_batches_written_again_add_nothing(spark, table):
    name, events, _ = table
    parts = [events.where(F.col("event_id") % 3 == k) for k in range(3)]
    for k in (0, 1, 2, 1, 0):
        eventlog.append_batch(parts[k], name, k)
    assert same(eventlog.read_log(spark, name), events)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_days_and_kinds_are_pruned(spark, table):
    name, events, path = table
    eventlog.append_batch(events, name, 0)
    day = (T0 + dt.timedelta(days=1)).date()
    got = eventlog.read_log(spark, name, ["ORDER_EXECUTED", "MARKET_TICK"], day, day)
    assert same(got, events.where(F.col("event_type").isin("ORDER_EXECUTED", "MARKET_TICK") & (F.to_date("ts") == F.lit(day)))) and got.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "event_type" in plan.split("PartitionFilters")[1]
    files = got.inputFiles()
    assert files and all(f"event_date={day}" in f and ("ORDER_EXECUTED" in f or "MARKET_TICK" in f) for f in files)


def test_the_ledger_starts_without_a_shuffle(spark, table):
    name, events, _ = table
    for k in range(2):
        eventlog.append_batch(events.where(F.col("event_id") % 2 == k), name, k)
    log = eventlog.read_log(spark, name)
    plan = ledger.position_ledger(log)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
    plan = ledger.portfolio_state(log, 50.0)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
    assert same(ledger.portfolio_state(log, 50.0).select("event_id", F.round("equity", 6)), ledger.portfolio_state(events, 50.0).select("event_id", F.round("equity", 6)))


def test_a_log_is_opened_again(spark, table):
    name, events, path = table
    eventlog.append_batch(events.limit(50), name, 0)
    again = f"{name}_again"
    eventlog.open_log(spark, again, path, events, 4)
    assert spark.table(again).count() == 50
    eventlog.append_batch(events.limit(50), again, 0)
    assert spark.table(again).count() == 50
    spark.sql(f"DROP TABLE {again}")


def test_rows_without_time_or_portfolio_and_empty_batches(spark, table):
    name, events, _ = table
    odd = spark.createDataFrame([(None, 1, None, 0, "MARKET_TICK", "A", 1.0, *[None] * 6), (1, 2, T0, 0, None, None, *[None] * 7)], LOG)
    eventlog.append_batch(odd, name, 7)
    eventlog.append_batch(odd.limit(0), name, 8)
    assert same(eventlog.read_log(spark, name), odd)
    with pytest.raises(ValueError):
        eventlog.open_log(spark, f"{name}_x", "x", events.withColumn("batch", F.lit(1)))
