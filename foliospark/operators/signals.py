"""Market signals: row rules, as-of joins, rolling volatility, rotation and on-chain indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions.scan import hot_keys, scan

DAY = 86400


def margin_ratio(df: DataFrame) -> DataFrame:
    total = F.col("crypto_margined_oi") + F.col("cash_margined_oi")
    ratio = F.when(total > 0, F.col("crypto_margined_oi") / total * 100).otherwise(0.0)
    return df.withColumn("margin_ratio", ratio).withColumn("alert", F.col("margin_ratio") > 50)


#: Regimes and their actions, by the signs of spot and perpetual CVD: ++, +-, -+, -- (zero is +).
REGIMES = ("ORGANIC_BULLISH", "SPOT_ABSORPTION", "LONG_SQUEEZE_RISK", "BROAD_LIQUIDATION")
ACTIONS = (
    "Expand core long exposure; increase altcoin weights.",
    "Accumulate spot positions; hedge via cash-margined perps.",
    "Reduce leverage; tighten stop-losses; raise cash buffer.",
    "Transition to RWA cash equivalents; execute delta hedges.",
)


def cvd_regime(df: DataFrame) -> DataFrame:
    spot, perp = F.col("spot_cvd") >= 0, F.col("perp_cvd") >= 0
    pick = lambda v: F.when(spot & perp, v[0]).when(spot, v[1]).when(perp, v[2]).otherwise(v[3])
    return df.withColumns({"cvd_delta": F.col("spot_cvd") - F.col("perp_cvd"), "cvd_regime": pick(REGIMES), "implied_action": pick(ACTIONS)})


def regime_rules(df: DataFrame) -> DataFrame:
    """Adds regime, p_bull, p_bear, p_consolidation and gamma; missing features have neutral defaults."""
    value = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    delta, nupl, roc = value("cvd_delta", 0.0), value("nupl", 0.5), value("roc_30d", 0.0)
    bull = (nupl > 0.6) | ((roc > 0.15) & (delta > 0))
    bear = (nupl < 0.2) | (roc < -0.15)
    pick = lambda a, b, c: F.when(bull, F.lit(a)).when(bear, F.lit(b)).otherwise(F.lit(c))
    return df.withColumns({
        "regime": pick("BULL", "BEAR", "CONSOLIDATION"), "p_bull": pick(0.80, 0.05, 0.20), "p_bear": pick(0.05, 0.80, 0.20),
        "p_consolidation": pick(0.15, 0.15, 0.60), "gamma": pick(1.0, 3.0, 2.0),
    })


def asof_market(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Latest price and latest derivatives of an event's symbol, the event itself included. Running last values, hot symbols
    in pieces; no range join, and no task holds all events of a hot symbol."""
    metrics = ("spot_cvd", "perp_cvd", "funding_rate")
    latest = {
        "latest_price": F.when(F.col("event_type") == "MARKET_TICK", F.col("price")),
        "_d": F.when(F.col("event_type") == "DERIVATIVES_METRICS", F.struct(*metrics)),
    }
    out = scan(events, ["symbol"], list(order), *hot_keys(events, list(order), ["symbol"]), lasts=latest)
    return out.withColumns({f"latest_{m}": F.col("_d")[m] for m in metrics}).drop("_d")


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], ties: tuple[str, ...] = (), tolerance: float | None = None, exact: bool = True, prefix: str = "",
) -> DataFrame:
    """Every row of left with the values of the last right row of its key that is not later: a left join in time.

    by: equal columns of both; left_on, right_on: columns of one kind, a time, date or number; ties: columns of right that order
    its rows of one time, the last of which counts (by default the values themselves). tolerance: the oldest that counts, in seconds
    for times, days for dates; exact: whether a right row of the very time counts. Values get the prefix, and `matched_<right_on>`
    is the time of the row found. NULL in a key or time matches nothing. Both sides are one tagged table and a running last value,
    so there is one shuffle, no range join, and hot keys are cut in pieces."""
    keys = [f"_k{i}" for i in range(len(by))]
    tie = [f"_o{i}" for i in range(len(ties) or len(values))]
    side = {"left": 1, "right": 0} if exact else {"left": 0, "right": 1}
    a = left.select(F.struct(*left.columns).alias("_l"), *[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(left_on).alias("_t"), F.lit(side["left"]).alias("_side"))
    found = F.struct(F.col(right_on).alias("t"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])
    known = right.where(F.col(right_on).isNotNull())
    b = known.select(found.alias("_r"), *[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(right_on).alias("_t"), F.lit(side["right"]).alias("_side"), *[F.col(c).alias(o) for c, o in zip(ties or values, tie)])
    both = a.unionByName(b, allowMissingColumns=True)
    order = ["_t", "_side", *tie]
    rows = scan(both, keys, order, *hot_keys(both, order, keys), lasts={"_last": F.col("_r")}).where("_l IS NOT NULL")
    ok = F.col("_t").isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    if tolerance is not None:
        ok = ok & (distance(both, "_t", F.col("_last.t")) <= tolerance)
    hit = F.when(ok, F.col("_last"))
    return rows.select(*[F.col(f"_l.`{c}`").alias(c) for c in left.columns], hit["t"].alias(f"matched_{right_on}"), *[hit[f"v{i}"].alias(f"{prefix}{c}") for i, c in enumerate(values)])


def distance(df: DataFrame, name: str, earlier: Column) -> Column:
    """From an earlier value to a column: seconds of times, days of dates, the difference of numbers."""
    kind = df.schema[name].dataType.simpleString()
    if kind.startswith("timestamp"):
        return (F.unix_micros(F.col(name).cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6
    return F.datediff(F.col(name), earlier) if kind == "date" else F.col(name) - earlier


def trailing_return(prices: DataFrame, days: int = 90) -> DataFrame:
    """close over the last close at least `days` days old, less one; NULL while the history is short."""
    w = W.partitionBy("symbol").orderBy("_d").rangeBetween(W.unboundedPreceding, -days)
    old = F.last("close").over(w)
    dated = prices.withColumn("_d", F.unix_date("day"))
    return dated.withColumn("ret", F.when(old > 0, F.col("close") / old - 1)).drop("_d")


def asset_universe(caps: DataFrame, excluded: DataFrame, benchmark, top: int = 50) -> DataFrame:
    """The top assets by market cap of a day, without the excluded ones and the benchmark."""
    rank = F.row_number().over(W.partitionBy("day").orderBy(F.desc("market_cap"), "asset_id"))
    eligible = caps.where(F.col("asset_id") != benchmark).join(excluded.select("asset_id"), "asset_id", "left_anti")
    return eligible.withColumn("cap_rank", rank.cast("long")).where(F.col("cap_rank") <= top)


def altcoin_season_index(days: DataFrame, returns: DataFrame, benchmark: str) -> DataFrame:
    """Per day of `days`, the share of assets that beat the benchmark's return; a day without any scores 0."""
    mark = returns.where(F.col("symbol") == benchmark).select("day", F.col("ret").alias("mark"))
    rest = returns.where((F.col("symbol") != benchmark) & F.col("ret").isNotNull()).join(mark, "day")
    counted = rest.groupBy("day").agg(F.count_if(F.col("ret") > F.col("mark")).alias("outperforming"), F.count("*").alias("total"))
    out = days.join(counted, "day", "left").fillna(0, ["outperforming", "total"])
    score = F.when(F.col("total") > 0, F.col("outperforming") / F.col("total") * 100).otherwise(0.0)
    out = out.withColumn("score", score)
    return out.withColumn("season", F.when(F.col("score") < 25, "BITCOIN_DOMINANCE").when(F.col("score") <= 75, "TRANSITIONAL_ROTATION").otherwise("ALTSEASON"))


def onchain_metrics(daily: DataFrame) -> DataFrame:
    """nupl, realized-cap change against 30 days before, hot-capital share; a zero base gives 0."""
    w = W.partitionBy("asset_id").orderBy("_d").rangeBetween(W.unboundedPreceding, -30)
    out = daily.withColumn("_d", F.unix_date("day")).withColumn("_old", F.last("realized_cap").over(w))
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    mc, rc, old = F.col("market_cap"), F.col("realized_cap"), F.col("_old")
    return out.withColumns({"nupl": share(mc - rc, mc), "realized_change_pct": share(rc - old, old) * 100, "hot_share": share(F.col("hot_capital"), mc)}).drop("_d", "_old")


#: Returns in a volatility; prices of a symbol in a window partition.
RETURNS, CHUNK = 29, 4096


def realized_vol_30(ticks: DataFrame, order: tuple[str, ...] = ("ts", "event_id"), default: float = 0.30, chunk: int = CHUNK) -> DataFrame:
    """Annualised deviation of the last 29 simple returns; the default until a symbol has six prices. Prices are numbered
    per symbol and cut into chunks, each led in by the last 28 prices of the one before."""
    rows = scan(ticks, ["symbol"], list(order), *hot_keys(ticks, list(order), ["symbol"]), sums={"_n": F.lit(1)}, lags={"_p": F.col("price")})
    rows = rows.withColumn("_r", F.when(F.col("_p") != 0, F.col("price") / F.col("_p") - 1))
    place = F.col("_n") - 1
    own = F.floor(place / chunk)
    leads = F.when(place % chunk >= chunk - (RETURNS - 1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("_lead", F.explode(leads)).withColumn("_chunk", own + F.col("_lead"))
    w = W.partitionBy("symbol", "_chunk").orderBy("_n").rowsBetween(1 - RETURNS, 0)
    vol = F.stddev_samp("_r").over(w) * F.sqrt(F.lit(365.0))
    out = rows.withColumn("realized_vol", F.when(F.col("_n") > 5, F.coalesce(vol, F.lit(default))).otherwise(default))
    return out.where("_lead = 0").drop("_n", "_p", "_r", "_lead", "_chunk")
