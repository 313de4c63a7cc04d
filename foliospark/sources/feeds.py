"""Feeds: ticks, the typed event log, order books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TICKS = {"timestamp": "double", "symbol": "string", "price": "double", "volume": "double"}
EVENT_TYPES = ("MARKET_TICK", "ORDER_BOOK_DEPTH", "DERIVATIVES_METRICS", "REBALANCE_TRIGGERED", "ORDER_EXECUTED", "YIELD_ACCRUED")
EVENT_LOG = (
    "portfolio_id long, event_id string, ts timestamp, sequence long, event_type string, symbol string, price double, volume_24h double, order_id string, side string, "
    "units double, fee double, amount double, apy_rate double, crypto_margined_oi double, cash_margined_oi double, spot_cvd double, perp_cvd double, funding_rate double, "
    "bids map<double,double>, asks map<double,double>, depth_2pct_bid double, depth_2pct_ask double, reason string, target_weights map<string,double>"
)


def normalize_ticks(raw: DataFrame, on_bad: str = "raise") -> DataFrame:
    """The four tick columns, cast; a bad value raises, or with on_bad='null' becomes NULL."""
    cast = (lambda c, t: F.col(c).try_cast(t)) if on_bad == "null" else (lambda c, t: F.col(c).cast(t))
    return raw.select(*[cast(c, t).alias(c) for c, t in TICKS.items()])


def tick_events(ticks: DataFrame) -> DataFrame:
    number = lambda c, kind, name: (F.coalesce(F.col(c), F.lit(0)) if c in ticks.columns else F.lit(0)).cast(kind).alias(name)
    return ticks.select(F.lit("MARKET_TICK").alias("event_type"), "timestamp", "symbol", "price", number("volume", "double", "volume_24h"), number("sequence", "long", "sequence"))


def checked(log: DataFrame) -> DataFrame:
    """Adds valid: false for an unknown kind, or an order that neither buys nor sells."""
    known = F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False))
    sided = (F.col("event_type") != "ORDER_EXECUTED") | F.coalesce(F.col("side").isin("BUY", "SELL"), F.lit(False))
    return log.withColumn("valid", known & sided)


def event_log(*parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One wide log of the parts, and the rows rejected (see checked)."""
    log = parts[0]
    for p in parts[1:]:
        log = log.unionByName(p, allowMissingColumns=True)
    rows = checked(log)
    return rows.where("valid").drop("valid"), rows.where("NOT valid").drop("valid")


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines as columns of the event log; NULL where a line or field can't be read. Prices of book levels, which JSON
    has as text, become numbers; a level without a number as price is left out."""
    read = lines.select(F.from_json(column, EVENT_LOG.replace("map<double,double>", "map<string,double>")).alias("e")).select("e.*")
    number = lambda k: k.try_cast("double")
    levels = lambda c: F.transform_keys(F.map_filter(c, lambda k, _: number(k).isNotNull()), lambda k, _: number(k))
    return read.withColumns({c: levels(c) for c in ("bids", "asks")})


def write_events(log: DataFrame, path: str) -> None:
    log.withColumn("event_date", F.to_date("ts")).write.partitionBy("event_date").mode("append").parquet(path)


def book_depth_2pct(levels: DataFrame) -> DataFrame:
    """Long books (book_id, side, price, size): size within 2 % of the mid price; a one-sided book has none.
    Sizes are summed by their book's mid price, so both passes share one shuffle on book_id."""
    best = levels.groupBy("book_id").agg(
        F.max(F.when(F.col("side") == "BID", F.col("price"))).alias("bid"), F.min(F.when(F.col("side") == "ASK", F.col("price"))).alias("ask"),
        F.collect_list(F.struct("side", "price", "size")).alias("levels"),
    )  # fmt: skip  # a book's levels are few
    mid = (F.col("bid") + F.col("ask")) / 2
    near = lambda side, test: F.aggregate(F.filter("levels", lambda x: (x["side"] == side) & test(x["price"])), F.lit(0.0), lambda s, x: s + x["size"])
    depth = lambda side, test: F.when(mid.isNull(), 0.0).otherwise(near(side, test))
    return best.select("book_id", depth("BID", lambda p: p >= mid * 0.98).alias("depth_2pct_bid"), depth("ASK", lambda p: p <= mid * 1.02).alias("depth_2pct_ask"))


def map_depth_2pct(books: DataFrame) -> DataFrame:
    """Books with bids and asks as maps price -> size: the same, without a shuffle."""
    mid = (F.array_max(F.map_keys("bids")) + F.array_min(F.map_keys("asks"))) / 2
    total = lambda m, test: F.aggregate(F.map_values(F.map_filter(m, lambda p, s: test(p))), F.lit(0.0), lambda a, s: a + s)
    return books.withColumns({
        "depth_2pct_bid": F.when(mid.isNull(), 0.0).otherwise(total("bids", lambda p: p >= mid * 0.98)),
        "depth_2pct_ask": F.when(mid.isNull(), 0.0).otherwise(total("asks", lambda p: p <= mid * 1.02)),
    })
