"""The market cache over files in any order, against windows over all events."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.plans import registry
from foliospark.streaming import state
from tests.oracle import assert_same, connect


def files_out_of_order(spark, tmp_path) -> str:
    """Each file holds events of the whole time."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 700").orderBy("event_id").toPandas()
    for k in (2, 0, 1):
        spark.createDataFrame(events[events["event_id"] % 3 == k].sample(frac=1, random_state=k)).coalesce(1).withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "value": F.when(F.col("event_id") % 23 != 5, F.col("value"))}).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_late_events_take_their_place(spark, tmp_path):
    d = files_out_of_order(spark, tmp_path)
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
    assert_same(registry.QUERIES["stream_market_cache"](spark, d), registry.ORACLE["stream_market_cache"], con)


def test_frames_are_merged_as_they_come(spark, tmp_path):
    """Rows reach the state thinned out, and no list of a key's frames is made of them."""
    r = random.Random(4)
    rows = [(i, r.randrange(50), r.choice(["MARKET_TICK", "MARKET_TICK", "DERIVATIVES_METRICS", "ORDER_EXECUTED"]), r.choice(["BTC", "ETH", None]), r.uniform(50, 150), r.uniform(-9, 9)) for i in range(2000)]
    rows += [(9999, 1, "ORDER_EXECUTED", "SOL", 1.0, 1.0)]  # has no price and no derivatives
    events = spark.createDataFrame(rows, "event_id long, ts long, event_type string, symbol string, price double, spot_cvd double").withColumn("perp_cvd", -F.col("spot_cvd"))
    whole = state.in_order(events, ("ts", "event_id"))
    frames = [f for _, f in whole.toPandas().sample(frac=1, random_state=1).groupby(lambda i: i % 5)]
    thin = list(state.newest(iter(frames)))
    assert all(len(f) <= 3 * 34 for f in thin) and sum(f["_n"].sum() for f in thin) == sum(x[2] == "MARKET_TICK" for x in rows)
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    state.stream_market_cache(source).writeStream.outputMode("update").format("memory").queryName("cache_states").trigger(availableNow=True).start().awaitTermination()
    got = {x.symbol: x for x in spark.table("cache_states").orderBy("n_prices").collect()}
    assert got.keys() == {"BTC", "ETH", None}
    for symbol, x in got.items():
        ticks = sorted((t, i, p) for i, t, kind, s, p, _ in rows if s == symbol and kind == "MARKET_TICK")
        _, _, cvd = max((t, i, c) for i, t, kind, s, _, c in rows if s == symbol and kind == "DERIVATIVES_METRICS")
        prices = [p for *_, p in ticks][-30:]
        rets = [b / a - 1 for a, b in zip(prices, prices[1:])]
        mean = sum(rets) / 29
        vol = (sum((y - mean) ** 2 for y in rets) / 28 * 365) ** 0.5
        assert (x.latest_price, x.spot_cvd, x.perp_cvd, x.n_prices) == (prices[-1], cvd, -cvd, len(ticks)) and x.realized_vol == pytest.approx(vol)
