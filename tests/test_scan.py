"""Running aggregates with hot keys, found by count and cut at quantiles, against plain windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import scan as scans
from foliospark.functions.scan import hot_keys, in_pieces, scan

T0 = dt.datetime(2024, 1, 1)


def rows_of(seed, n=3000):
    """Key 0 has a third of all rows, nearly all within an hour; others are spread over a year."""
    draw = random.Random(seed)
    out = []
    for i in range(n):
        k = 0 if i % 3 == 0 else draw.randrange(1, 40)
        at = T0 + dt.timedelta(seconds=draw.randrange(3600) if k == 0 and i % 100 else draw.randrange(365 * 86400))
        out.append((None if k == 5 else k, None if i % 97 == 0 else at, i, float(draw.randrange(9)) if draw.random() < 0.7 else None))
    return out


KIND = "k long, ts timestamp, i long, v double"


def parts():
    V = F.col("v")
    return dict(sums={"s": V}, maxima={"m": V}, lasts={"l": V}, lags={"g": F.col("i")}, since={"n": F.when(V > 5, F.col("i"))}, step=F.when(F.col("i") % 4 == 0, 0).otherwise(1), before=("s", "m", "l"))


def values(df):
    return sorted(map(tuple, df.select("i", "s", "m", "l", "g", "n", "s_before", "m_before", "l_before").collect()))


@pytest.mark.parametrize("order", [["ts", "i"], ["i"]])
def test_hot_and_cold_keys_equal_plain_windows(spark, order):
    df = spark.createDataFrame(rows_of(1), KIND)
    (hot,) = hot_keys(df, order, ["k"], limit=200)
    V = F.col("v")
    assert [r["_h_k"] for r in hot.collect()] == [0]
    w = W.partitionBy("k").orderBy(*order)
    now, prior = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    steps = F.sum(parts()["step"]).over(now)
    last = lambda c, at: F.last(c, ignorenulls=True).over(at)
    want = df.withColumns({
        "s": F.coalesce(F.sum(V).over(now), F.lit(0.0)), "m": F.max(V).over(now), "l": last(V, now), "g": F.lag("i").over(w), "_s": steps,
        "s_before": F.coalesce(F.sum(V).over(prior), F.lit(0.0)), "m_before": F.max(V).over(prior), "l_before": last(V, prior),
    })
    want = want.withColumn("n", last(F.when(V > 5, F.col("i")) - F.col("_s"), now) + F.col("_s"))
    assert values(scan(df, ["k"], order, hot, **parts())) == values(want)
    assert values(scan(df, ["k"], order, None, **parts())) == values(want)


def test_an_hour_of_events_is_many_even_pieces(spark):
    """Buckets of fixed length in time would make one of them."""
    df = spark.range(1_000_000).select((F.col("id") % 3 == 0).alias("other"), (F.lit(1_704_067_200.0) + F.rand(3) * 3600).cast("timestamp").alias("ts"), "id")
    df = df.withColumn("k", F.when(F.col("other"), F.col("id") % 1000).otherwise(-1))
    (hot,) = hot_keys(df, ["ts", "id"], ["k"], limit=20_000)
    sizes = [r["count"] for r in in_pieces(df, ["k"], ["ts", "id"], hot).groupBy("k", "_piece").count().where("k = -1").collect()]
    assert sum(sizes) == 666_666 and len(sizes) >= 60 and max(sizes) <= 20_000


def test_cold_keys_take_one_window_and_one_shuffle(spark):
    df = spark.createDataFrame(rows_of(2), KIND)
    (hot,) = hot_keys(df, ["ts", "i"], ["k"])
    assert hot is None
    plan = scan(df, ["k"], ["ts", "i"], hot, **parts())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_two_levels_of_keys_are_counted_at_once(spark):
    df = spark.createDataFrame([(i % 2, i % 6, i) for i in range(600)], "p long, s long, i long")
    fine, coarse = hot_keys(df, ["i"], ["p", "s"], ["p"], limit=150)
    assert fine is None and sorted(r["_h_p"] for r in coarse.collect()) == [0, 1]
    fine, coarse = hot_keys(df, ["i"], ["p", "s"], ["p"], limit=90)
    assert fine.count() == 6 and coarse.count() == 2
    assert hot_keys(df.limit(0), ["i"], ["p", "s"], ["p"], limit=1) == [None, None]


@pytest.mark.parametrize("kind,value", [("string", "lpad(string(id), 6, '0')"), ("date", "date_add(date'2020-01-01', int(id))"), ("decimal(20,3)", "id / 7"), ("timestamp_ntz", "timestamp_ntz'2020-01-01' + make_interval(0,0,0,0,0,0,id)"), ("boolean", "id > 300"), ("int", "-id")])
def test_orders_of_every_kind(spark, kind, value):
    df = spark.range(600).selectExpr("1L as k", f"cast({value} as {kind}) as o", "id as i", "1.0D as v")
    (hot,) = hot_keys(df, ["o", "i"], ["k"], limit=100)
    got = {r.i: r.s for r in scan(df, ["k"], ["o", "i"], hot, sums={"s": F.col("v")}).collect()}
    places = {r.i: r.n for r in df.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("o", "i"))).collect()}
    assert got == places
    pieces = in_pieces(df, ["k"], ["o", "i"], hot).select("_piece").distinct().count()
    assert pieces > 4 or kind == "boolean"


def test_equal_times_stay_together(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), F.lit(T0).alias("ts"), F.col("id").alias("i"), F.lit(1.0).alias("v"))
    (hot,) = hot_keys(df, ["ts", "i"], ["k"], limit=50)
    assert {r.i: r.s for r in scan(df, ["k"], ["ts", "i"], hot, sums={"s": F.col("v")}).collect()} == {i: i + 1.0 for i in range(500)}


def test_many_hot_keys_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(scans, "SMALL", 3)
    df = spark.createDataFrame(rows_of(3), KIND)
    (hot,) = hot_keys(df, ["ts", "i"], ["k"], limit=20)
    assert hot.count() > 3
    assert values(scan(df, ["k"], ["ts", "i"], hot, **parts())) == values(scan(df, ["k"], ["ts", "i"], None, **parts()))
