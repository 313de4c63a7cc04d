"""Registered queries over the given tables, and the SQL that another engine can check them with.

Accumulated doubles are rounded to six decimals on both sides, arrays are joined to text.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.scratch import new_path, stash
from foliospark.operators import allocation, attribution, execution, ledger, regime_model, replay, signals, validation
from foliospark.sources import eventlog, feeds
from foliospark.sources.views import VIEWS, view, with_views
from foliospark.streaming import keyed
from foliospark.streaming import state as streams

CASH = 1_000_000.0
QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return add


def r6(*names: str, df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# ---- sources

TICK_SQL = """SELECT CAST(epoch(ts) AS DOUBLE) AS timestamp, symbol, CAST(price AS DOUBLE) AS price, CAST(amount AS DOUBLE) AS volume FROM ledger WHERE event_type = 'MARKET_TICK'"""


def raw_ticks(s, d):
    t = view(s, d, "ledger").where("event_type = 'MARKET_TICK'")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t.select(seconds.cast("string").alias("timestamp"), "symbol", F.col("price").cast("string").alias("price"), F.col("amount").cast("string").alias("volume"), "event_id")


@query(TICK_SQL)
def normalize_ticks(s, d):
    return feeds.normalize_ticks(raw_ticks(s, d))


@query(f"SELECT 'MARKET_TICK' AS event_type, timestamp, symbol, price, volume AS volume_24h, CAST(0 AS BIGINT) AS sequence FROM ({TICK_SQL}) t")
def tick_events(s, d):
    return feeds.tick_events(feeds.normalize_ticks(raw_ticks(s, d)))


@query("SELECT portfolio_id, event_id, event_type, symbol, side, units, CAST(CASE WHEN event_type = 'ORDER_EXECUTED' AND side IS NULL THEN 0 ELSE 1 END AS BIGINT) AS valid FROM ledger")
def event_log(s, d):
    return feeds.checked(view(s, d, "ledger")).select("portfolio_id", "event_id", "event_type", "symbol", "side", "units", F.col("valid").cast("long").alias("valid"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(price), 4) AS prices FROM ledger WHERE event_type IN ('MARKET_TICK', 'ORDER_EXECUTED') AND CAST(ts AS DATE) >= DATE '2024-01-05' GROUP BY 1, 2")
def event_log_days(s, d):
    """Ticks and orders from a day on, out of a log written in three batches, one of them twice."""
    log, name = view(s, d, "ledger"), f"event_log_{uuid.uuid4().hex}"
    eventlog.open_log(s, name, new_path(s, "event-log"), log, buckets=2)
    for k in (0, 1, 2, 1):
        eventlog.append_batch(log.where(F.col("event_id") % 3 == k), name, k)
    rows = eventlog.read_log(s, name, ["MARKET_TICK", "ORDER_EXECUTED"], first=dt.date(2024, 1, 5))
    return rows.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("price"), 4).alias("prices"))


@query("""WITH m AS (SELECT book_id, (max(price) FILTER (side = 'BID') + min(price) FILTER (side = 'ASK')) / 2 AS mid FROM book_levels GROUP BY 1)
SELECT m.book_id, coalesce(sum(size) FILTER (side = 'BID' AND price >= mid * CAST(0.98 AS DOUBLE)), 0) AS depth_2pct_bid, coalesce(sum(size) FILTER (side = 'ASK' AND price <= mid * CAST(1.02 AS DOUBLE)), 0) AS depth_2pct_ask
FROM m JOIN book_levels b ON m.book_id = b.book_id GROUP BY 1""")
def book_depth_2pct(s, d):
    return feeds.book_depth_2pct(view(s, d, "book_levels"))


# ---- rows

DERIV = "event_type = 'DERIVATIVES_METRICS'"
CVD = "CASE WHEN spot_cvd >= 0 AND perp_cvd >= 0 THEN 'ORGANIC_BULLISH' WHEN spot_cvd >= 0 THEN 'SPOT_ABSORPTION' WHEN perp_cvd >= 0 THEN 'LONG_SQUEEZE_RISK' ELSE 'BROAD_LIQUIDATION' END"


@query(f"""SELECT event_id, round(ratio, 6) AS margin_ratio, ratio > 50 AS alert FROM (SELECT event_id, CASE WHEN crypto_margined_oi + cash_margined_oi > 0 THEN crypto_margined_oi / (crypto_margined_oi + cash_margined_oi) * 100 ELSE 0 END AS ratio FROM ledger WHERE {DERIV}) x""")
def margin_ratio(s, d):
    return r6("margin_ratio", df=signals.margin_ratio(view(s, d, "ledger").where(DERIV)).select("event_id", "margin_ratio", "alert"))


@query(f"""SELECT event_id, spot_cvd - perp_cvd AS cvd_delta, cvd_regime, CASE cvd_regime WHEN 'ORGANIC_BULLISH' THEN '{signals.ACTIONS[0]}' WHEN 'SPOT_ABSORPTION' THEN '{signals.ACTIONS[1]}' WHEN 'LONG_SQUEEZE_RISK' THEN '{signals.ACTIONS[2]}' ELSE '{signals.ACTIONS[3]}' END AS implied_action
FROM (SELECT *, {CVD} AS cvd_regime FROM ledger WHERE {DERIV}) x""")
def cvd_regime(s, d):
    return signals.cvd_regime(view(s, d, "ledger").where(DERIV)).select("event_id", "cvd_delta", "cvd_regime", "implied_action")


BULL = "(nupl > CAST(0.6 AS DOUBLE) OR (roc_30d > CAST(0.15 AS DOUBLE) AND cvd_delta > 0))"
BEAR = "(nupl < CAST(0.2 AS DOUBLE) OR roc_30d < CAST(-0.15 AS DOUBLE))"


@query(f"""SELECT obs, CASE WHEN {BULL} THEN 'BULL' WHEN {BEAR} THEN 'BEAR' ELSE 'CONSOLIDATION' END AS regime,
CAST(CASE WHEN {BULL} THEN 0.80 WHEN {BEAR} THEN 0.05 ELSE 0.20 END AS DOUBLE) AS p_bull, CAST(CASE WHEN {BULL} THEN 0.05 WHEN {BEAR} THEN 0.80 ELSE 0.20 END AS DOUBLE) AS p_bear,
CAST(CASE WHEN {BULL} THEN 0.15 WHEN {BEAR} THEN 0.15 ELSE 0.60 END AS DOUBLE) AS p_consolidation, CAST(CASE WHEN {BULL} THEN 1 WHEN {BEAR} THEN 3 ELSE 2 END AS DOUBLE) AS gamma
FROM (SELECT obs, coalesce(cvd_delta, 0) AS cvd_delta, coalesce(CASE WHEN obs % 7 > 0 THEN nupl END, 0.5) AS nupl, coalesce(CASE WHEN obs % 5 > 0 THEN roc_30d END, 0) AS roc_30d FROM regime_features) x""")
def regime_rules(s, d):
    rows = view(s, d, "regime_features").withColumns({"nupl": F.when(F.col("obs") % 7 > 0, F.col("nupl")), "roc_30d": F.when(F.col("obs") % 5 > 0, F.col("roc_30d"))})
    return signals.regime_rules(rows).select("obs", "regime", "p_bull", "p_bear", "p_consolidation", "gamma")


TRADES = "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN -l_extendedprice WHEN l_linenumber = 7 THEN 0 ELSE l_extendedprice END AS notional, CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE 1000 * l_quantity END AS depth_2pct, l_tax * l_extendedprice / 20 AS ter FROM lineitem"
COST = """SELECT *, CAST(abs(notional) * CAST(0.00025 AS DOUBLE) AS DOUBLE) AS spread_cost, CAST(abs(notional) * CAST(0.0005 AS DOUBLE) AS DOUBLE) AS fee_cost,
CASE WHEN notional = 0 THEN 0 WHEN depth_2pct > 0 THEN 0.5 * sqrt(abs(notional) / depth_2pct) * abs(notional) * CAST(0.00025 AS DOUBLE) ELSE abs(notional) * CAST(0.01 AS DOUBLE) END AS impact_cost"""


@query(f"""WITH t AS ({TRADES}), c AS ({COST} FROM t), e AS (SELECT *, spread_cost + fee_cost + impact_cost AS total_cost FROM c)
SELECT l_orderkey, l_linenumber, notional, round(spread_cost, 8) AS spread_cost, round(fee_cost, 8) AS fee_cost, round(impact_cost, 8) AS impact_cost, round(total_cost, 8) AS total_cost,
round(CASE WHEN notional = 0 THEN 0 ELSE total_cost / abs(notional) END, 8) AS cost_pct, notional = 0 OR ter <= 0 OR ter > total_cost AS effective FROM e""")
def trade_cost(s, d):
    rows = s.sql(TRADES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=s.read.parquet(f"{d}/lineitem.parquet"))
    costs = ("spread_cost", "fee_cost", "impact_cost", "total_cost", "cost_pct")
    return execution.trade_cost(rows).drop("depth_2pct", "ter").withColumns({c: F.round(c, 8) for c in costs})


@query("SELECT portfolio_id, symbol, round(weight * 1000000 * coalesce(apy, CAST(0.045 AS DOUBLE)) / 365, 6) AS daily_yield FROM current_weights LEFT JOIN assets USING (symbol)")
def daily_yield(s, d):
    rows = view(s, d, "current_weights").join(view(s, d, "assets").select("symbol", "apy"), "symbol", "left").withColumn("notional", F.col("weight") * 1_000_000)
    return r6("daily_yield", df=allocation.daily_yield(rows).select("portfolio_id", "symbol", "daily_yield"))


# ---- joins

DRIFT = f"""p AS (SELECT portfolio_id, symbol, coalesce(c.weight, 0) AS cw, coalesce(t.weight, 0) AS tw FROM current_weights c FULL JOIN target_weights t USING (portfolio_id, symbol)),
q AS (SELECT p.*, equity, category, (tw - cw) * equity AS notional, coalesce(depth_2pct, 100000) AS depth_2pct, abs(cw - tw) AS drift, 0.5 * abs(cw - tw) * abs(cw - tw) * equity AS ter FROM p JOIN equities USING (portfolio_id) LEFT JOIN assets USING (symbol)),
c AS ({COST}, drift > CASE WHEN category = 'CORE' THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.10 AS DOUBLE) END AS breached FROM q),
e AS (SELECT *, spread_cost + fee_cost + impact_cost AS total_cost FROM c),
dr AS (SELECT *, breached AND (notional = 0 OR ter <= 0 OR ter > total_cost) AS approved FROM e)"""


def drifts(s, d):
    return execution.weight_drift(view(s, d, "current_weights"), view(s, d, "target_weights"), view(s, d, "equities"), view(s, d, "assets"))


@query(f"""WITH {DRIFT} SELECT portfolio_id, symbol, round(cw, 6) AS current_weight, round(tw, 6) AS target_weight, round(drift, 6) AS drift, breached, round(notional, 4) AS notional, round(total_cost, 4) AS total_cost, approved,
CASE WHEN NOT breached THEN 'band' WHEN NOT approved THEN 'cost' END AS reason FROM dr""")
def weight_drift(s, d):
    reason = F.when(F.col("rejection_reason").startswith("Drift"), "band").when(F.col("rejection_reason").startswith("Execution"), "cost").alias("reason")
    x = r6("current_weight", "target_weight", "drift", df=drifts(s, d))
    return x.select("portfolio_id", "symbol", "current_weight", "target_weight", "drift", "breached", F.round("notional", 4).alias("notional"), F.round("total_cost", 4).alias("total_cost"), "approved", reason)


@query("""SELECT a.event_id, round(p.price, 6) AS latest_price, round(v.spot_cvd, 6) AS latest_spot_cvd, round(v.perp_cvd, 6) AS latest_perp_cvd FROM (SELECT *, epoch_us(ts) * 1000000 + event_id AS k FROM ledger) a
ASOF LEFT JOIN (SELECT symbol, price, epoch_us(ts) * 1000000 + event_id AS k FROM ledger WHERE event_type = 'MARKET_TICK') p ON a.symbol = p.symbol AND a.k >= p.k
ASOF LEFT JOIN (SELECT symbol, spot_cvd, perp_cvd, epoch_us(ts) * 1000000 + event_id AS k FROM ledger WHERE event_type = 'DERIVATIVES_METRICS') v ON a.symbol = v.symbol AND a.k >= v.k""".replace("epoch_us(ts) * 1000000 + event_id", "epoch_us(ts)::HUGEINT * 1000000000 + event_id"))
def asof_market(s, d):
    return r6("latest_price", "latest_spot_cvd", "latest_perp_cvd", df=signals.asof_market(view(s, d, "ledger")).select("event_id", "latest_price", "latest_spot_cvd", "latest_perp_cvd"))


#: Trades of orders and quotes of shipped lines: separate tables, some trades without a quote of the last two days.
TRADED = "trades AS (SELECT o_orderkey AS trade_id, 'A' || CAST(o_custkey % 14 AS VARCHAR(9)) AS symbol, CAST(o_orderdate AS DATE) AS day, o_totalprice AS notional FROM orders)"


def trades(s, d):
    return s.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS trade_id", "'A' || CAST(o_custkey % 14 AS VARCHAR(9)) AS symbol", "CAST(o_orderdate AS DATE) AS day", "o_totalprice AS notional")


@query(f"""WITH {TRADED}, j AS (SELECT t.*, q.day AS quoted, q.close FROM trades t ASOF LEFT JOIN prices_daily q ON t.symbol = q.symbol AND t.day >= q.day)
SELECT trade_id, symbol, day, CASE WHEN day - quoted <= 2 THEN quoted END AS matched_day, CASE WHEN day - quoted <= 2 THEN round(close, 6) END AS close FROM j""")
def asof_trades_quotes(s, d):
    x = signals.asof_join(trades(s, d), view(s, d, "prices_daily"), ["symbol"], "day", "day", ["close"], tolerance=2)
    return r6("close", df=x.select("trade_id", "symbol", "day", "matched_day", "close"))


#: Derivatives events as a feed of their own against ticks as another, strictly earlier.
@query("""SELECT a.event_id, p.event_id AS tick_id, round(p.price, 6) AS tick_price FROM (SELECT * FROM ledger WHERE event_type = 'DERIVATIVES_METRICS') a
ASOF LEFT JOIN (SELECT symbol, ts, max(event_id) AS event_id, arg_max(price, event_id) AS price FROM ledger WHERE event_type = 'MARKET_TICK' GROUP BY 1, 2) p ON a.symbol = p.symbol AND a.ts > p.ts""")
def asof_derivatives_ticks(s, d):
    log = view(s, d, "ledger")
    ticks = log.where("event_type = 'MARKET_TICK'").select("symbol", "ts", "event_id", "price")
    x = signals.asof_join(log.where("event_type = 'DERIVATIVES_METRICS'").select("event_id", "symbol", "ts"), ticks, ["symbol"], "ts", "ts", ["event_id", "price"], ties=("event_id",), exact=False, prefix="tick_")
    return r6("tick_price", df=x.select("event_id", F.col("tick_event_id").alias("tick_id"), "tick_price"))


RETURNS = "r90 AS (SELECT p.symbol, p.day, CASE WHEN o.close > 0 THEN p.close / o.close - 1 END AS ret FROM prices_daily p ASOF LEFT JOIN prices_daily o ON p.symbol = o.symbol AND p.day - INTERVAL 90 DAY >= o.day)"


@query(f"WITH {RETURNS} SELECT symbol, day, round(ret, 6) AS ret FROM r90")
def returns_90d(s, d):
    return r6("ret", df=signals.trailing_return(view(s, d, "prices_daily")).select("symbol", "day", "ret"))


@query("""SELECT day, o_custkey AS asset_id, round(market_cap, 4) AS market_cap, cap_rank FROM (SELECT day, o_custkey, market_cap, row_number() OVER (PARTITION BY day ORDER BY market_cap DESC, o_custkey) AS cap_rank
FROM (SELECT CAST(o_orderdate AS DATE) AS day, o_custkey, sum(o_totalprice) AS market_cap FROM orders WHERE o_custkey <> 1 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3) GROUP BY 1, 2) x) y WHERE cap_rank <= 5""")
def asset_universe(s, d):
    caps = s.read.parquet(f"{d}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_custkey").alias("asset_id")).agg(F.sum("o_totalprice").alias("market_cap"))
    excluded = s.read.parquet(f"{d}/customer.parquet").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("asset_id"))
    return signals.asset_universe(caps, excluded, 1, 5).select("day", "asset_id", F.round("market_cap", 4).alias("market_cap"), "cap_rank")


RETS = "pr AS (SELECT portfolio_id, equity / 10000000 - CAST(0.1 AS DOUBLE) AS total_return, CAST(0.15 AS DOUBLE) AS benchmark_return FROM equities)"


@query(f"""WITH {RETS}, x AS (SELECT portfolio_id, sum(CASE WHEN apy IS NULL THEN weight * coalesce(beta, 1) ELSE 0 END) AS b, sum(weight * coalesce(funding, 0)) AS carry, sum(CASE WHEN apy IS NOT NULL THEN weight * apy ELSE 0 END) AS rwa
FROM current_weights LEFT JOIN assets USING (symbol) GROUP BY 1), y AS (SELECT x.*, total_return, b * benchmark_return AS factor, total_return - (b * benchmark_return + carry + rwa) AS residual FROM x JOIN pr USING (portfolio_id))
SELECT portfolio_id, round(factor, 6) AS factor, round(carry, 6) AS carry, round(rwa, 6) AS rwa, round(residual, 6) AS residual, round(CASE WHEN abs(total_return) > 1e-6 THEN abs(residual) / abs(total_return) * 100 ELSE 0 END, 4) AS error_pct FROM y""")
def pnl_attribution(s, d):
    rets = view(s, d, "equities").select("portfolio_id", (F.col("equity") / 10_000_000 - 0.1).alias("total_return"), F.lit(0.15).alias("benchmark_return"))
    return r6("factor", "carry", "rwa", "residual", df=attribution.pnl_attribution(view(s, d, "current_weights"), view(s, d, "assets"), rets)).withColumn("error_pct", F.round("error_pct", 4))


# ---- aggregations


@query("""SELECT p.asset_id, p.day, round(CASE WHEN p.market_cap > 0 THEN (p.market_cap - p.realized_cap) / p.market_cap ELSE 0 END, 6) AS nupl,
round(CASE WHEN o.realized_cap > 0 THEN (p.realized_cap - o.realized_cap) / o.realized_cap ELSE 0 END * 100, 4) AS realized_change_pct, round(CASE WHEN p.market_cap > 0 THEN p.hot_capital / p.market_cap ELSE 0 END, 6) AS hot_share
FROM onchain_daily p ASOF LEFT JOIN onchain_daily o ON p.asset_id = o.asset_id AND p.day - INTERVAL 30 DAY >= o.day""")
def onchain_metrics(s, d):
    x = signals.onchain_metrics(view(s, d, "onchain_daily")).select("asset_id", "day", "nupl", "realized_change_pct", "hot_share")
    return r6("nupl", "hot_share", df=x).withColumn("realized_change_pct", F.round("realized_change_pct", 4))


@query(f"""WITH {RETURNS}, m AS (SELECT day, ret AS mark FROM r90 WHERE symbol = 'A0'), x AS (SELECT r.day, count(*) FILTER (ret > mark) AS outperforming, count(*) AS total FROM r90 r JOIN m ON r.day = m.day WHERE symbol <> 'A0' AND ret IS NOT NULL GROUP BY 1),
y AS (SELECT sp.day, coalesce(outperforming, 0) AS outperforming, coalesce(total, 0) AS total FROM (SELECT DISTINCT day FROM prices_daily) sp LEFT JOIN x ON sp.day = x.day), z AS (SELECT *, CASE WHEN total > 0 THEN outperforming / total * 100 ELSE 0 END AS score FROM y)
SELECT day, outperforming, total, round(score, 6) AS score, CASE WHEN score < 25 THEN 'BITCOIN_DOMINANCE' WHEN score <= 75 THEN 'TRANSITIONAL_ROTATION' ELSE 'ALTSEASON' END AS season FROM z""")
def altcoin_season_index(s, d):
    prices = view(s, d, "prices_daily")
    return r6("score", df=signals.altcoin_season_index(prices.select("day").distinct(), signals.trailing_return(prices), "A0").select("day", "outperforming", "total", "score", "season"))


COLLATERAL = """co AS (SELECT portfolio_id, equity / 10 + coalesce(v, 0) AS collateral, equity FROM equities LEFT JOIN (SELECT portfolio_id, sum(weight * 100000 * (1 - CAST(CASE category WHEN 'CASH' THEN 0 WHEN 'RWA_YIELD' THEN 0.01 WHEN 'CORE' THEN 0.15 ELSE 0.40 END AS DOUBLE))) AS v
FROM current_weights LEFT JOIN assets USING (symbol) GROUP BY 1) x USING (portfolio_id))"""


def collateral_of(s, d):
    held = view(s, d, "current_weights").withColumn("notional", F.col("weight") * 100_000)
    return execution.effective_collateral(held, view(s, d, "equities").select("portfolio_id", (F.col("equity") / 10).alias("cash")), view(s, d, "assets"))


@query(f"WITH {COLLATERAL} SELECT portfolio_id, round(collateral, 4) AS collateral FROM co")
def effective_collateral(s, d):
    return collateral_of(s, d).withColumn("collateral", F.round("collateral", 4))


@query(f"""WITH {COLLATERAL}, w AS (SELECT portfolio_id, sum(weight) AS tw, count(*) FILTER (coalesce(category, 'SATELLITE') = 'SATELLITE' AND weight > CAST(0.15 AS DOUBLE)) AS n_caps
FROM (SELECT portfolio_id, symbol, weight * (CASE WHEN portfolio_id % 3 = 0 THEN CAST(0.9 AS DOUBLE) ELSE 1 END) AS weight FROM target_weights) t LEFT JOIN assets USING (symbol) GROUP BY 1),
x AS (SELECT portfolio_id, tw, n_caps, collateral, CASE WHEN portfolio_id % 4 = 0 THEN 0 ELSE equity / 11 END AS need FROM w JOIN co USING (portfolio_id)),
y AS (SELECT *, abs(tw - 1) > CAST(0.0001 AS DOUBLE) AND tw > 0 AS off_sum, need > 0 AND collateral / need < CAST(1.25 AS DOUBLE) AS thin_margin FROM x)
SELECT portfolio_id, n_caps, off_sum, thin_margin, n_caps = 0 AND NOT off_sum AND NOT thin_margin AS passed, need = 0 AS unbounded FROM y""")
def pretrade_check(s, d):
    proposed = view(s, d, "target_weights").withColumn("weight", F.col("weight") * F.when(F.col("portfolio_id") % 3 == 0, 0.9).otherwise(1.0))
    need = F.when(F.col("portfolio_id") % 4 == 0, 0.0).otherwise(F.col("equity") / 11)
    margins = collateral_of(s, d).join(view(s, d, "equities").select("portfolio_id", need.alias("required_margin")), "portfolio_id")
    out = execution.pretrade_check(proposed, view(s, d, "assets"), margins)
    return out.select("portfolio_id", F.col("n_caps").cast("long").alias("n_caps"), "off_sum", "thin_margin", "passed", (F.col("coverage") == float("inf")).alias("unbounded"))


@query(f"""WITH {DRIFT} SELECT portfolio_id, bool_or(breached) AND bool_or(approved) AS should_rebalance, coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (breached), '') AS triggered, round(sum(CASE WHEN approved THEN total_cost ELSE 0 END), 4) AS total_cost FROM dr GROUP BY 1""")
def rebalance_decision(s, d):
    return execution.rebalance_decision(drifts(s, d)).withColumns({"triggered": F.array_join("triggered", ","), "total_cost": F.round("total_cost", 4)})


LAST_PRICE = "lp AS (SELECT symbol, arg_max(close, day) AS price FROM prices_daily GROUP BY 1)"


@query(f"""WITH {DRIFT}, {LAST_PRICE} SELECT portfolio_id, symbol, round(abs(notional) / price, 6) AS units, CASE WHEN notional > 0 THEN 'BUY' ELSE 'SELL' END AS side, round(fee_cost + spread_cost, 6) AS fee FROM dr JOIN lp USING (symbol) WHERE approved AND price > 0 AND abs(notional) >= 1""")
def executable_orders(s, d):
    prices = view(s, d, "prices_daily").groupBy("symbol").agg(F.max_by("close", "day").alias("price"))
    return r6("units", "fee", df=execution.executable_orders(drifts(s, d), prices).select("portfolio_id", "symbol", "units", "side", "fee"))


@query("""WITH c AS (SELECT portfolio_id AS plan_id, symbol, weight * 100000 AS depth_2pct FROM current_weights), n AS (SELECT plan_id, count(*) AS n, count(*) FILTER (depth_2pct >= 10000) AS ok FROM c GROUP BY 1)
SELECT plan_id, 'BTC' AS symbol, CAST(0.4 AS DOUBLE) AS weight FROM n UNION ALL SELECT plan_id, 'ETH', CAST(0.2 AS DOUBLE) FROM n UNION ALL SELECT plan_id, symbol, round(CAST(0.3 AS DOUBLE) / n, 6) FROM c JOIN n USING (plan_id) WHERE depth_2pct >= 10000
UNION ALL SELECT plan_id, 'BUIDL', round(CAST(0.1 AS DOUBLE) + (CAST(0.3 AS DOUBLE) - ok * CAST(0.3 AS DOUBLE) / n), 6) FROM n""")
def allocation_plan(s, d):
    c = view(s, d, "current_weights").select(F.col("portfolio_id").alias("plan_id"), "symbol", (F.col("weight") * 100_000).alias("depth_2pct"))
    return r6("weight", df=allocation.allocation_plan(c))


VOLS = "vo AS (SELECT symbol, stddev_samp(ret) AS realized_vol FROM (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM prices_daily) x GROUP BY 1), pv AS (SELECT portfolio_id, sum(weight * realized_vol * 20) AS vol FROM current_weights JOIN vo USING (symbol) GROUP BY 1)"


def vols_of(s, d):
    from pyspark.sql import Window as W

    p = view(s, d, "prices_daily")
    ret = F.col("close") / F.lag("close").over(W.partitionBy("symbol").orderBy("day")) - 1
    return p.withColumn("ret", ret).groupBy("symbol").agg((F.stddev_samp("ret") * 20).alias("realized_vol"))


@query(f"WITH {VOLS} SELECT portfolio_id, round(vol, 6) AS vol FROM pv")
def portfolio_vol(s, d):
    return r6("vol", df=allocation.portfolio_vol(view(s, d, "current_weights"), vols_of(s, d)))


@query(f"""WITH {VOLS}, sc AS (SELECT portfolio_id, symbol, weight * CASE WHEN coalesce(vol, 0) <= 0 THEN 1 ELSE least(1, CAST(0.25 AS DOUBLE) / vol) END AS w FROM current_weights LEFT JOIN pv USING (portfolio_id))
SELECT portfolio_id, symbol, round(w, 6) AS weight FROM sc WHERE symbol <> 'A2' UNION ALL SELECT portfolio_id, 'A2', round(greatest(0, 1 - coalesce(sum(w) FILTER (symbol <> 'A2'), 0)), 6) FROM sc GROUP BY 1""")
def vol_target_weights(s, d):
    base = view(s, d, "current_weights")
    return r6("weight", df=allocation.vol_target_weights(base, allocation.portfolio_vol(base, vols_of(s, d)), "A2"))


@query(f"""WITH k AS (SELECT event_id AS key, {CVD} AS reg, amount AS nupl, (amount - CAST(0.5 AS DOUBLE)) / 2 AS roc, spot_cvd - perp_cvd AS delta FROM ledger WHERE {DERIV} AND symbol = 'BTC'),
g AS (SELECT *, CAST(CASE WHEN nupl > CAST(0.6 AS DOUBLE) OR (roc > CAST(0.15 AS DOUBLE) AND delta > 0) THEN 1 WHEN nupl < CAST(0.2 AS DOUBLE) OR roc < CAST(-0.15 AS DOUBLE) THEN 3 ELSE 2 END AS DOUBLE) AS gamma FROM k),
b AS (SELECT * FROM (VALUES ('BTC', 0.4), ('ETH', 0.2), ('SOL', 0.15), ('AVAX', 0.15), ('BUIDL', 0.1)) v(symbol, w))
SELECT key, symbol, round(CAST(CASE WHEN reg <> 'BROAD_LIQUIDATION' AND gamma <> 3 THEN w WHEN symbol = 'BUIDL' THEN 1 - CAST(0.9 AS DOUBLE) / gamma ELSE w / gamma END AS DOUBLE), 6) AS weight FROM g CROSS JOIN b""")
def regime_adjusted_weights(s, d):
    """Targets at each of BTC's derivatives events, with nupl and roc_30d from the event's amount, so that all regimes occur."""
    events = signals.asof_market(view(s, d, "ledger")).where(f"{DERIV} AND symbol = 'BTC'")
    now = events.select(F.col("event_id").alias("key"), F.col("latest_spot_cvd").alias("spot_cvd"), F.col("latest_perp_cvd").alias("perp_cvd"), F.col("amount").alias("nupl"), ((F.col("amount") - 0.5) / 2).alias("roc_30d"))
    ruled = signals.regime_rules(signals.cvd_regime(now))
    deep = now.select(F.col("key").alias("plan_id"), F.explode(F.array(F.lit("SOL"), F.lit("AVAX"))).alias("symbol"), F.lit(1e6).alias("depth_2pct"))
    plan = allocation.allocation_plan(deep).withColumnRenamed("plan_id", "key")
    return r6("weight", df=allocation.regime_adjusted_weights(plan, ruled))


COV = "cv AS (SELECT a.grp, a.asset AS i, b.asset AS j, covar_samp(a.ret, b.ret) AS cov FROM asset_vectors a JOIN asset_vectors b ON a.grp = b.grp AND a.obs = b.obs GROUP BY 1, 2, 3)"


def covariance(s, d):
    return allocation.returns_covariance(view(s, d, "asset_vectors"))


@query(f"WITH {COV} SELECT CAST(grp AS BIGINT) AS grp, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(cov, 6) AS cov FROM cv WHERE i <= j")
def returns_covariance(s, d):
    return r6("cov", df=covariance(s, d)).select(*[F.col(c).cast("long").alias(c) for c in ("grp", "i", "j")], "cov")


@query("""WITH dr AS (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM prices_daily), b AS (SELECT day, (row_number() OVER (ORDER BY day) - 1) // 30 AS b FROM (SELECT DISTINCT day FROM prices_daily) x),
e AS (SELECT b, max(day) AS as_of FROM b GROUP BY 1), r AS (SELECT dr.*, b.b FROM dr JOIN b USING (day) WHERE ret IS NOT NULL)
SELECT as_of, x.symbol AS i, y.symbol AS j, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN covar_samp(x.ret, y.ret) END * 1000000, 4) AS cov_ppm FROM e JOIN r x ON x.b BETWEEN e.b - 2 AND e.b JOIN r y ON x.day = y.day AND x.symbol <= y.symbol GROUP BY 1, 2, 3""")
def rolling_covariance(s, d):
    """Covariances of the daily returns of all symbols over the last 90 days with prices, every 30 days."""
    from pyspark.sql import Window as W

    ret = F.col("close") / F.lag("close").over(W.partitionBy("symbol").orderBy("day")) - 1
    returns = view(s, d, "prices_daily").select(F.lit(0).alias("grp"), F.col("day").alias("obs"), F.col("symbol").alias("asset"), ret.alias("ret"))
    return allocation.rolling_covariance(returns, 90, 30).select("as_of", "i", "j", "n", F.round(F.col("cov") * 1_000_000, 4).alias("cov_ppm"))


@query("""WITH e AS (SELECT label AS grp, vec_id AS obs, generate_subscripts(embedding, 1) - 1 AS asset, CAST(unnest(embedding) AS DOUBLE) AS ret FROM embeddings)
SELECT CAST(a.grp AS BIGINT) AS grp, CAST(a.asset AS BIGINT) AS i, CAST(b.asset AS BIGINT) AS j, round(covar_samp(a.ret, b.ret) / 3, 6) + CAST(0 AS DOUBLE) AS third FROM e a JOIN e b ON a.grp = b.grp AND a.obs = b.obs AND a.asset <= b.asset GROUP BY 1, 2, 3""")
def tiled_covariance(s, d):
    """A third of the covariances of all 64 elements of the vectors, by tiles of 16: the elements have few digits, so that whole
    covariances would lie on the border of two roundings."""
    vectors = s.read.parquet(f"{d}/embeddings.parquet").selectExpr("CAST(label AS BIGINT) AS grp", "vec_id AS obs", "embedding AS x")
    x = allocation.tiled_covariance(vectors, 64, tile=16, chunk=256)
    return x.select("grp", "i", "j", (F.round(F.col("cov") / 3, 6) + 0.0).alias("third"))  # no negative zeros


def tenths(s, d):
    return view(s, d, "asset_vectors").select("grp", "asset").distinct().withColumn("weight", (F.col("asset") + 1) / 10)


@query(f"""WITH {COV}, m AS (SELECT grp, i, sum(cov * (j + 1) / CAST(10 AS DOUBLE)) AS m FROM cv GROUP BY 1, 2), q AS (SELECT grp, sqrt(sum(m * (i + 1) / CAST(10 AS DOUBLE))) AS v FROM m GROUP BY 1)
SELECT CAST(grp AS BIGINT) AS grp, CAST(i AS BIGINT) AS asset, round(m / v, 6) AS mcr, round((i + 1) / CAST(10 AS DOUBLE) * m / v, 6) AS rc FROM m JOIN q USING (grp)""")
def risk_contributions(s, d):
    out = r6("mcr", "rc", df=allocation.risk_contributions(tenths(s, d), covariance(s, d)))
    return out.withColumns({c: F.col(c).cast("long") for c in ("grp", "asset")})


@query(f"WITH {COV} SELECT CAST(grp AS BIGINT) AS grp, round(sqrt(greatest(0, sum(cov * (i + 1) * (j + 1) / CAST(100 AS DOUBLE)))) * sqrt(365), 6) AS vol FROM cv GROUP BY 1")
def portfolio_vol_covariance(s, d):
    x = allocation.covariance_vol(tenths(s, d), allocation.both_ways(covariance(s, d)))
    return r6("vol", df=x).withColumn("grp", F.col("grp").cast("long"))


@query(f"""WITH {COV}, va AS (SELECT grp, i, sqrt(cov + 1e-8) AS sd FROM cv WHERE i = j), p AS (SELECT a.grp * 16 + a.i * 4 + b.i AS grp, a.i, b.i AS j, a.sd AS sa, b.sd AS sb FROM va a JOIN va b ON a.grp = b.grp AND a.i < b.i)
SELECT CAST(grp AS BIGINT) AS grp, CAST(i AS BIGINT) AS asset, round(sb / (sa + sb), 6) AS weight FROM p UNION ALL SELECT CAST(grp AS BIGINT), CAST(j AS BIGINT), round(sa / (sa + sb), 6) FROM p""")
def risk_parity_pairs(s, d):
    """Every two assets of a group as a group of their own: equal risk is then inverse volatility, whatever the correlation."""
    cov = covariance(s, d)
    pairs = cov.where("i < j").withColumn("pair", F.col("grp") * 16 + F.col("i") * 4 + F.col("j"))
    own = cov.where("i = j").select("grp", F.col("i").alias("k"), F.col("cov").alias("v"))
    ends = pairs.select("grp", "pair", F.explode(F.array("i", "j")).alias("k")).join(own, ["grp", "k"]).select(F.col("pair").alias("grp"), F.col("k").alias("i"), F.col("k").alias("j"), F.col("v").alias("cov"))
    both = ends.unionByName(pairs.select(F.col("pair").alias("grp"), "i", "j", "cov"))
    return r6("weight", df=allocation.risk_parity_weights(both))


@query()
def risk_parity_weights(s, d):
    return allocation.risk_parity_weights(covariance(s, d))


# ---- validation

SHARPE = "CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt(365) ELSE 0 END"
TRIALS = f"tr AS (SELECT strategy_id, family_id, {SHARPE} AS sharpe FROM strategy_returns GROUP BY 1, 2), ts AS (SELECT family_id, count(*) AS n_trials, coalesce(var_samp(sharpe), 0) AS variance FROM tr GROUP BY 1)"


@query(f"""WITH {TRIALS} SELECT family_id, n_trials, round(variance, 6) AS variance, round(least(CAST(0.999999 AS DOUBLE), greatest(1e-6, 1 - 1 / CAST(n_trials AS DOUBLE))), 6) AS q1, round(least(CAST(0.999999 AS DOUBLE), greatest(1e-6, 1 - 1 / (n_trials * exp(1)))), 6) AS q2 FROM ts""")
def trial_sharpe_star(s, d):
    trials = validation.moments_of(view(s, d, "strategy_returns"))
    return r6("variance", "q1", "q2", df=validation.trial_sharpe_star(trials).drop("sharpe_star"))


def integral(z: str) -> str:
    """SQL for the normal distribution by Simpson's rule, and so by other means than the query's."""
    x = f"least(abs({z}), 9)"
    return f"(0.5::DOUBLE + sign({z}) * {x} / 6000 / sqrt(2 * pi()) * list_sum(list_transform(generate_series(0, 2000), lambda i: CASE WHEN i % 2000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5::DOUBLE * (i * {x} / 2000) ** 2))))"


#: The star of each family; quantiles by halving intervals.
STAR = f"""{TRIALS}, ends AS (SELECT family_id, 1 AS k, least(CAST(0.999999 AS DOUBLE), greatest(1e-6, 1 - 1 / CAST(n_trials AS DOUBLE))) AS q FROM ts UNION ALL SELECT family_id, 2, least(CAST(0.999999 AS DOUBLE), greatest(1e-6, 1 - 1 / (n_trials * exp(1)))) FROM ts),
halved(family_id, k, q, lo, hi, step) AS (SELECT family_id, k, q, CAST(-6 AS DOUBLE), CAST(6 AS DOUBLE), 0 FROM ends UNION ALL
  SELECT family_id, k, q, CASE WHEN p < q THEN mid ELSE lo END, CASE WHEN p < q THEN hi ELSE mid END, step + 1 FROM (SELECT *, (lo + hi) / 2 AS mid, {integral("((lo + hi) / 2)")} AS p FROM halved WHERE step < 45) h),
star AS (SELECT ts.family_id, CASE WHEN n_trials <= 1 OR variance <= 1e-12 THEN 0 ELSE sqrt(variance) * sum(lo * CASE k WHEN 1 THEN 1 - CAST({validation.EULER_GAMMA} AS DOUBLE) ELSE CAST({validation.EULER_GAMMA} AS DOUBLE) END) END AS sharpe_star
  FROM ts JOIN halved h ON h.family_id = ts.family_id AND step = 45 GROUP BY ts.family_id, n_trials, variance)"""


@query(f"WITH RECURSIVE {STAR} SELECT family_id, round(sharpe_star, 6) AS sharpe_star FROM star")
def trial_sharpe_star_value(s, d):
    return r6("sharpe_star", df=validation.trial_sharpe_star(validation.moments_of(view(s, d, "strategy_returns"))).select("family_id", "sharpe_star"))


MOMENTS = """m AS (SELECT strategy_id, count(*) AS t, avg(ret) AS m, var_pop(ret) AS v, stddev_samp(ret) AS sd FROM strategy_returns GROUP BY 1),
x AS (SELECT r.strategy_id, any_value(r.family_id) AS family_id, any_value(t) AS t, any_value(CASE WHEN sd > 1e-12 THEN m / sd * sqrt(365) ELSE 0 END) AS sharpe, avg((ret - m) ** 3) / any_value(v) ** 1.5 AS skew, avg((ret - m) ** 4) / any_value(v) ** 2 AS kurt FROM strategy_returns r JOIN m ON r.strategy_id = m.strategy_id GROUP BY 1)"""


@query(f"""WITH {MOMENTS}
SELECT strategy_id, t, round(sharpe, 6) AS sharpe, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(greatest(1e-12, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe), 6) AS spread FROM x""")
def deflated_sharpe(s, d):
    x = validation.deflated_sharpe(view(s, d, "strategy_returns"))
    spread = F.greatest(F.lit(1e-12), 1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") * F.col("sharpe"))
    return r6("sharpe", "skew", "kurt", "spread", df=x.withColumn("spread", spread).select("strategy_id", "t", "sharpe", "skew", "kurt", "spread"))


DEFLATED = f"""{STAR}, {MOMENTS}, lo AS (SELECT family_id, avg(CASE WHEN sharpe <= 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS pbo FROM tr GROUP BY 1),
zz AS (SELECT strategy_id, t, pbo, (sharpe - sharpe_star) / sqrt(greatest(1e-12, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) / greatest(1, t - 1)) AS z FROM x JOIN star USING (family_id) JOIN lo USING (family_id)),
ds AS (SELECT strategy_id, z, CASE WHEN t < 4 THEN 0 ELSE {integral("z")} END AS dsr, CASE WHEN t < 4 THEN 1 ELSE pbo END AS pbo FROM zz)"""


@query(f"WITH RECURSIVE {DEFLATED} SELECT strategy_id, round(z, 6) AS z, round(dsr, 6) AS dsr, round(pbo, 6) AS pbo, dsr >= CAST(0.95 AS DOUBLE) AND pbo < CAST(0.1 AS DOUBLE) AS is_valid FROM ds")
def deflated_sharpe_score(s, d):
    return r6("z", "dsr", "pbo", df=validation.deflated_sharpe(view(s, d, "strategy_returns")).select("strategy_id", "z", "dsr", "pbo", "is_valid"))


BLOCKS = "bl AS (SELECT strategy_id, idx, ret, n, CASE WHEN n // 6 = 0 THEN 5 ELSE least(idx // (n // 6), 5) END AS block FROM (SELECT *, count(*) OVER (PARTITION BY strategy_id) AS n FROM strategy_returns) x)"
COMBOS = "cb AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS split_id, a, b FROM range(6) x(a), range(6) y(b) WHERE a < b)"


@query(f"WITH {BLOCKS} SELECT strategy_id, idx, CAST(block AS BIGINT) AS block FROM bl")
def cpcv_blocks(s, d):
    return validation.cpcv_blocks(view(s, d, "strategy_returns")).select("strategy_id", "idx", "block")


ROLES = f"""WITH {BLOCKS}, {COMBOS}, bd AS (SELECT strategy_id, block, min(idx) AS s, max(idx) + 1 AS e FROM bl GROUP BY 1, 2),
m AS (SELECT bl.strategy_id, cb.split_id, idx, CASE WHEN bl.block IN (a, b) THEN 'test' WHEN (idx >= x.s - 5 AND idx < x.s) OR (idx >= y.s - 5 AND idx < y.s) THEN 'purged'
  WHEN (idx >= x.e AND idx < x.e + 5) OR (idx >= y.e AND idx < y.e + 5) THEN 'embargoed' ELSE 'train' END AS role
  FROM bl CROSS JOIN cb LEFT JOIN bd x ON x.strategy_id = bl.strategy_id AND x.block = a LEFT JOIN bd y ON y.strategy_id = bl.strategy_id AND y.block = b)
SELECT strategy_id, split_id, role, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM m GROUP BY 1, 2, 3"""


@query(ROLES)
def cpcv_splits(s, d):
    x = validation.cpcv_splits(view(s, d, "strategy_returns"))
    return x.groupBy("strategy_id", "split_id", "role").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query(ROLES)
def cpcv_intervals(s, d):
    """The same from the intervals alone: no row of returns is copied for a split."""
    x = validation.cpcv_intervals(view(s, d, "strategy_returns"))
    return x.groupBy("strategy_id", "split_id", "role").agg(F.sum(F.col("end_idx") - F.col("first_idx")).alias("n"), F.min("first_idx").alias("first_idx"), (F.max("end_idx") - 1).alias("last_idx"))


PATHS = f"{BLOCKS}, {COMBOS}, pa AS (SELECT strategy_id, split_id, CASE WHEN stddev_samp(ret) > 1e-6 THEN avg(ret) / stddev_samp(ret) * sqrt(365) ELSE 0 END AS sharpe FROM bl JOIN cb ON block IN (a, b) GROUP BY 1, 2 HAVING count(*) > 5)"


@query(f"WITH {PATHS} SELECT strategy_id, split_id, round(sharpe, 6) AS sharpe FROM pa")
def cpcv_path_sharpe(s, d):
    return r6("sharpe", df=validation.cpcv_path_sharpe(view(s, d, "strategy_returns")))


@query(f"WITH {PATHS} SELECT strategy_id, round(avg(CASE WHEN sharpe <= 0 THEN 1.0 ELSE 0 END), 6) AS pbo FROM pa GROUP BY 1")
def path_pbo(s, d):
    return r6("pbo", df=validation.path_pbo(validation.cpcv_path_sharpe(view(s, d, "strategy_returns"))))


@query(f"""WITH {PATHS}, p AS (SELECT strategy_id, avg(CASE WHEN sharpe <= 0 THEN 1.0 ELSE 0 END) AS pbo FROM pa GROUP BY 1), g AS (SELECT strategy_id, pbo, 1 - pbo * CAST(0.5 AS DOUBLE) AS dsr FROM p)
SELECT strategy_id, round(pbo, 6) AS pbo, printf('Strategy failed overfitting verification gate: PBO=%.4f (must be < 0.10), DSR=%.4f (must be >= 0.95).', pbo, dsr) AS message FROM g WHERE pbo >= CAST(0.1 AS DOUBLE) OR dsr < CAST(0.95 AS DOUBLE)""")
def overfit_gate(s, d):
    records = validation.path_pbo(validation.cpcv_path_sharpe(view(s, d, "strategy_returns"))).withColumn("dsr", 1 - F.col("pbo") * 0.5)
    return r6("pbo", df=validation.overfit_gate(records).select("strategy_id", "pbo", "message"))


@query(f"""WITH RECURSIVE {DEFLATED}, {PATHS}, pp AS (SELECT strategy_id, avg(CASE WHEN sharpe <= 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS path_pbo FROM pa GROUP BY 1)
SELECT strategy_id, round(dsr, 6) AS dsr, round(path_pbo, 6) AS pbo, printf('Strategy failed overfitting verification gate: PBO=%.4f (must be < 0.10), DSR=%.4f (must be >= 0.95).', path_pbo, dsr) AS message
FROM ds JOIN pp USING (strategy_id) WHERE path_pbo >= CAST(0.1 AS DOUBLE) OR dsr < CAST(0.95 AS DOUBLE)""")
def deflated_gate(s, d):
    """The gate over deflated Sharpe ratios and the path estimate of overfitting."""
    returns = view(s, d, "strategy_returns")
    records = validation.deflated_sharpe(returns).select("strategy_id", "dsr").join(validation.path_pbo(validation.cpcv_path_sharpe(returns)), "strategy_id")
    return r6("dsr", "pbo", df=validation.overfit_gate(records).select("strategy_id", "dsr", "pbo", "message"))


# ---- ledger

KEEP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
SIGNED = "CASE WHEN event_type = 'ORDER_EXECUTED' THEN CASE WHEN side = 'BUY' THEN units ELSE -units END ELSE 0 END"
LEDGER = f"""h AS (SELECT *, {SIGNED} AS su, max(CASE WHEN event_type = 'ORDER_EXECUTED' THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio_id, symbol ORDER BY ts, event_id {KEEP}) AS has FROM ledger),
u AS (SELECT *, sum(su) OVER w AS pu, coalesce(last_value(CASE WHEN event_type = 'ORDER_EXECUTED' OR (event_type = 'MARKET_TICK' AND has = 1) THEN price END IGNORE NULLS) OVER w, 0) AS pp,
  sum(CASE WHEN event_type = 'YIELD_ACCRUED' AND has = 1 THEN amount ELSE 0 END) OVER w AS ay FROM h WINDOW w AS (PARTITION BY portfolio_id, symbol ORDER BY ts, event_id {KEEP})),
v AS (SELECT *, CASE WHEN has = 1 THEN pu * pp ELSE 0 END AS notional, CASE event_type WHEN 'ORDER_EXECUTED' THEN -su * price - fee WHEN 'YIELD_ACCRUED' THEN amount ELSE 0 END AS dc FROM u),
vv AS (SELECT *, notional - coalesce(lag(notional) OVER (PARTITION BY portfolio_id, symbol ORDER BY ts, event_id), 0) AS dn FROM v),
st AS (SELECT *, {CASH} + sum(dc) OVER p AS cash, {CASH} + sum(dc + dn) OVER p AS equity, sum(CASE WHEN sequence > 0 THEN 1 ELSE 0 END) OVER p AS g FROM vv WINDOW p AS (PARTITION BY portfolio_id ORDER BY ts, event_id {KEEP})),
ss AS (SELECT *, CASE WHEN g > 0 THEN first_value(sequence) OVER q + row_number() OVER q - 1 ELSE row_number() OVER q END AS event_sequence FROM st WINDOW q AS (PARTITION BY portfolio_id, g ORDER BY ts, event_id))"""


@query(f"WITH {LEDGER} SELECT portfolio_id, event_id, symbol, round(pu, 6) AS position_units, round(pp, 6) AS position_price, round(ay, 6) AS accrued_yield, round(notional, 6) AS notional FROM v WHERE has = 1 AND event_type <> 'DERIVATIVES_METRICS'")
def position_ledger(s, d):
    names = ("position_units", "position_price", "accrued_yield", "notional")
    return r6(*names, df=ledger.position_ledger(view(s, d, "ledger")).select("portfolio_id", "event_id", "symbol", *names))


def states(s, d):
    """The states, written once to the shared folder: what follows reads them several times."""
    return stash(ledger.portfolio_state(view(s, d, "ledger"), CASH).select("portfolio_id", *ledger.ORDER, "sequence", "equity", "initial_equity"), "states")


@query(f"WITH {LEDGER} SELECT portfolio_id, event_id, round(cash, 6) AS cash, round(equity, 6) AS equity, CAST(event_sequence AS BIGINT) AS event_sequence FROM ss")
def portfolio_state(s, d):
    return ledger.portfolio_state(view(s, d, "ledger"), CASH).select("portfolio_id", "event_id", F.round("cash", 6).alias("cash"), F.round("equity", 6).alias("equity"), "event_sequence")


FINAL = f"""{LEDGER}, lastp AS (SELECT portfolio_id, symbol, arg_max(pu, struct_pack(ts := ts, e := event_id)) AS units, arg_max(pp, struct_pack(ts := ts, e := event_id)) AS price, arg_max(ay, struct_pack(ts := ts, e := event_id)) AS ay, max(has) AS has FROM v GROUP BY 1, 2),
mk AS (SELECT portfolio_id, max(struct_pack(ts := ts, e := event_id)) FILTER (event_type IN ('MARKET_TICK', 'ORDER_EXECUTED')) AS m FROM v GROUP BY 1), me AS (SELECT st.portfolio_id, equity AS marked FROM st JOIN mk ON st.portfolio_id = mk.portfolio_id AND st.ts = mk.m.ts AND st.event_id = mk.m.e),
ps AS (SELECT l.portfolio_id, symbol, units, price, ay, units * price AS notional, marked FROM lastp l JOIN me ON l.portfolio_id = me.portfolio_id WHERE has = 1)"""


@query(f"WITH {FINAL} SELECT portfolio_id, symbol, round(units, 6) AS units, round(price, 6) AS price, round(ay, 6) AS accrued_yield, round(notional, 4) AS notional FROM ps")
def state_at(s, d):
    x = r6("units", "price", "accrued_yield", df=ledger.state_at(view(s, d, "ledger"), CASH))
    return x.select("portfolio_id", "symbol", "units", "price", "accrued_yield", F.round("notional", 4).alias("notional"))


@query(f"WITH {FINAL} SELECT portfolio_id, symbol, round(notional, 4) AS notional, round(CASE WHEN marked > 0 THEN notional / marked ELSE 0 END, 8) AS weight FROM ps")
def position_weights(s, d):
    x = ledger.position_weights(view(s, d, "ledger"), CASH)
    return x.select("portfolio_id", "symbol", F.round("notional", 4).alias("notional"), F.round("weight", 8).alias("weight"))


#: A hundred instants over the time of the log, one before it.
INSTANTS = """ins AS (SELECT min(ts) + to_microseconds(CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 98 AS BIGINT) * (k - 1)) AS inst FROM ledger, range(100) r(k) GROUP BY k)"""
KEYED = "epoch_us(ts)::HUGEINT * 1000000000 + event_id"


def instants_of(s, d) -> list:
    first, last = view(s, d, "ledger").agg(F.min("ts"), F.max("ts")).first()
    step = ((last - first) // dt.timedelta(microseconds=1)) // 98
    return [first + dt.timedelta(microseconds=step * (k - 1)) for k in range(100)]


@query(f"""WITH {LEDGER}, {INSTANTS}, vk AS (SELECT *, {KEYED} AS k FROM v), sk AS (SELECT *, {KEYED} AS k FROM st WHERE event_type <> 'DERIVATIVES_METRICS'), mk AS (SELECT * FROM sk WHERE event_type IN ('MARKET_TICK', 'ORDER_EXECUTED')),
q AS (SELECT p.portfolio_id, p.symbol, inst, epoch_us(inst)::HUGEINT * 1000000000 + 999999999 AS k FROM (SELECT DISTINCT portfolio_id, symbol FROM ledger) p, ins),
z AS (SELECT q.portfolio_id, q.symbol, inst AS as_of, vk.has, vk.pu, vk.pp, vk.ay, sk.cash, sk.equity, mk.equity AS marked FROM q ASOF JOIN vk ON q.portfolio_id = vk.portfolio_id AND q.symbol = vk.symbol AND q.k >= vk.k
  ASOF JOIN sk ON q.portfolio_id = sk.portfolio_id AND q.k >= sk.k ASOF LEFT JOIN mk ON q.portfolio_id = mk.portfolio_id AND q.k >= mk.k)
SELECT portfolio_id, symbol, CAST(epoch_us(as_of) AS BIGINT) AS as_of_us, round(pu, 6) AS units, round(pp, 6) AS price, round(ay, 6) AS accrued_yield, round(cash, 6) AS cash, round(equity, 6) AS equity, round(CASE WHEN marked > 0 THEN pu * pp / marked ELSE 0 END, 8) AS weight FROM z WHERE has = 1""")
def states_at_instants(s, d):
    """Positions and weights of every portfolio at a hundred instants, from one pass over the log."""
    x = r6("units", "price", "accrued_yield", "cash", "equity", df=ledger.states_at(view(s, d, "ledger"), CASH, instants_of(s, d)))
    at = F.unix_micros(F.col("as_of").cast("timestamp")).alias("as_of_us")
    return x.select("portfolio_id", "symbol", at, "units", "price", "accrued_yield", "cash", "equity", F.round("weight", 8).alias("weight"))


@query(f"WITH {FINAL} SELECT portfolio_id, symbol, round(units, 6) AS units, round(price, 6) AS price, round(ay, 6) AS accrued_yield, round(notional, 4) AS notional, round(CASE WHEN marked > 0 THEN notional / marked ELSE 0 END, 8) AS weight FROM ps")
def state_from_snapshot(s, d):
    """The last state from a snapshot half way and the events after it; the events before are read for the snapshot only."""
    log, half = view(s, d, "ledger"), instants_of(s, d)[50]
    positions, starts = ledger.snapshot(log, CASH, half)
    later = ledger.with_initial(log.where(F.col("ts") > F.lit(half).cast(log.schema["ts"].dataType)), positions, starts)
    x = r6("units", "price", "accrued_yield", df=ledger.state_at(later, CASH))
    return x.select("portfolio_id", "symbol", "units", "price", "accrued_yield", F.round("notional", 4).alias("notional"), F.round("weight", 8).alias("weight"))


#: The same log after a given state, which the other engine gets as events long before: a payment, then purchases without fee.
BEGUN = LEDGER.replace("FROM ledger)", "FROM begun)")
BEGIN = """op AS (SELECT o.*, row_number() OVER (ORDER BY portfolio_id, symbol) AS k FROM openings o), begun AS (SELECT portfolio_id, event_id, ts, sequence, event_type, symbol, price, side, units, fee, amount FROM ledger
UNION ALL SELECT portfolio_id, k - 1000000, TIMESTAMP '1900-01-02', 0, 'ORDER_EXECUTED', symbol, price, 'BUY', units, 0, NULL FROM op
UNION ALL SELECT s.portfolio_id, -2000000, TIMESTAMP '1900-01-01', 0, 'YIELD_ACCRUED', NULL, NULL, NULL, NULL, NULL, cash - %s + coalesce(v, 0) FROM starts s LEFT JOIN (SELECT portfolio_id, sum(units * price) AS v FROM op GROUP BY 1) x ON x.portfolio_id = s.portfolio_id)""" % CASH


def begun(s, d):
    return ledger.with_initial(view(s, d, "ledger"), view(s, d, "openings"), view(s, d, "starts"))


@query(f"WITH {BEGIN}, {BEGUN} SELECT portfolio_id, event_id, round(cash, 6) AS cash, round(equity, 6) AS equity FROM ss WHERE event_id >= 0")
def portfolio_state_from_start(s, d):
    x = ledger.portfolio_state(begun(s, d), CASH)
    return x.select("portfolio_id", "event_id", F.round("cash", 6).alias("cash"), F.round("equity", 6).alias("equity"))


@query(f"WITH {BEGIN}, {FINAL.replace(LEDGER, BEGUN)} SELECT portfolio_id, symbol, round(units, 6) AS units, round(price, 6) AS price, round(ay, 6) AS accrued_yield, round(notional, 4) AS notional, round(CASE WHEN marked > 0 THEN notional / marked ELSE 0 END, 8) AS weight FROM ps")
def state_at_from_start(s, d):
    x = r6("units", "price", "accrued_yield", df=ledger.state_at(begun(s, d), CASH))
    return x.select("portfolio_id", "symbol", "units", "price", "accrued_yield", F.round("notional", 4).alias("notional"), F.round("weight", 8).alias("weight"))


@query(f"""WITH t AS (SELECT *, price / lag(price) OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1 AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS n FROM ledger WHERE event_type = 'MARKET_TICK')
SELECT symbol, event_id, round(CASE WHEN n > 5 THEN stddev_samp(r) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN 28 PRECEDING AND CURRENT ROW) * sqrt(365) ELSE CAST(0.3 AS DOUBLE) END, 6) AS realized_vol FROM t""")
def realized_vol_30(s, d):
    return r6("realized_vol", df=signals.realized_vol_30(view(s, d, "ledger").where("event_type = 'MARKET_TICK'")).select("symbol", "event_id", "realized_vol"))


DAILY = f"""{LEDGER}, nn AS (SELECT *, count(*) OVER (PARTITION BY portfolio_id) AS n FROM st), dl AS (SELECT portfolio_id, CAST(row_number() OVER (PARTITION BY portfolio_id ORDER BY ts, event_id) AS BIGINT) AS snapshot, equity FROM nn WHERE sequence % 6 = 5 OR sequence = n - 1
UNION ALL SELECT DISTINCT portfolio_id, CAST(0 AS BIGINT), CAST({CASH} AS DOUBLE) FROM st), dr2 AS (SELECT *, equity / nullif(lag(equity) OVER (PARTITION BY portfolio_id ORDER BY snapshot), 0) - 1 AS ret FROM dl)"""


@query(f"WITH {DAILY} SELECT portfolio_id, snapshot, round(equity, 6) AS equity FROM dl")
def daily_equity(s, d):
    return ledger.daily_equity(states(s, d), CASH).withColumn("equity", F.round("equity", 6))


@query(f"WITH {DAILY} SELECT portfolio_id, snapshot, CASE WHEN abs(ret) < 1e-8 THEN 0 ELSE round(ret, 8) END AS ret FROM dr2 WHERE ret IS NOT NULL")
def daily_returns(s, d):
    return ledger.daily_returns(ledger.daily_equity(states(s, d), CASH)).select("portfolio_id", "snapshot", F.when(F.abs("ret") < 1e-8, 0.0).otherwise(F.round("ret", 8)).alias("ret"))


DRAW = f"{DAILY}, pk AS (SELECT *, greatest({CASH}, max(equity) OVER (PARTITION BY portfolio_id ORDER BY ts, event_id {KEEP})) AS peak FROM st)"


@query(f"WITH {DRAW} SELECT portfolio_id, event_id, CASE WHEN abs(equity - peak) < 1e-8 * peak THEN 0 ELSE round((equity - peak) / peak, 8) END AS drawdown FROM pk")
def drawdown(s, d):
    return ledger.drawdown(states(s, d), CASH).select("portfolio_id", "event_id", F.when(F.abs("drawdown") < 1e-8, 0.0).otherwise(F.round("drawdown", 8)).alias("drawdown"))


@query(f"""WITH {DRAW}, a AS (SELECT portfolio_id, count(*) AS n_events, arg_max(equity, struct_pack(ts := ts, e := event_id)) AS fe, epoch(max(ts)) - epoch(min(ts)) AS secs, least(0, min((equity - peak) / peak)) AS dd FROM pk GROUP BY 1),
b AS (SELECT portfolio_id, coalesce(stddev_samp(ret) * sqrt(365), 0) AS vol FROM dr2 GROUP BY 1), c AS (SELECT a.*, vol, (fe - {CASH}) / {CASH} AS tot FROM a JOIN b USING (portfolio_id)),
f AS (SELECT *, CASE WHEN tot > -1 THEN (1 + tot) ** (365 / greatest(1, secs / 86400)) - 1 ELSE -1 END AS ann FROM c)
SELECT portfolio_id, n_events, round(fe, 6) AS final_equity, round(tot * 100, 6) AS total_return_pct, round(ann * 100, 6) AS annualized_return_pct, round(vol * 100, 6) AS annualized_volatility_pct, round(CASE WHEN vol > 1e-6 THEN ann / vol ELSE 0 END, 6) AS sharpe_ratio, round(dd * 100, 6) AS max_drawdown_pct FROM f""")
def backtest_summary(s, d):
    x = ledger.backtest_summary(states(s, d), CASH)
    return r6("total_return_pct", "annualized_return_pct", "annualized_volatility_pct", "sharpe_ratio", "max_drawdown_pct", df=x).withColumn("final_equity", F.round("final_equity", 6))


# ---- grouped maps, learning, streams


@query()
def strategy_replay(s, d):
    policies = [replay.Policy(0, rebalance=False), *[replay.Policy(i, target_vol=0.05 * i) for i in range(1, 5)]]
    return replay.strategy_replay(view(s, d, "ledger"), policies, CASH)


@query(f"WITH {LEDGER} SELECT portfolio_id, round(arg_max(equity, struct_pack(ts := ts, e := event_id)), 6) AS final_equity, count(*) AS n_events FROM st GROUP BY 1")
def strategy_replay_idle(s, d):
    """Policies that never trade end where portfolio_state does."""
    x = replay.strategy_replay(view(s, d, "ledger"), [replay.Policy(0, rebalance=False)], CASH)
    return x.select("portfolio_id", F.round("final_equity", 6).alias("final_equity"), "n_events")


@query()
def regime_model_scores(s, d):
    """Scores of all rows by models of four fifths of them; held_out marks the others."""
    rows = view(s, d, "regime_features").withColumn("held_out", F.crc32(F.col("obs").cast("string").cast("binary")) % 5 == 0)
    return regime_model.classify(rows, regime_model.train(rows.where("NOT held_out"))).select("obs", "held_out", "label", "regime", "p_bull", "p_bear", "p_consolidation", "gamma")


QUERIES["regime_model"] = QUERIES.pop("regime_model_scores")


def streamed(s, d, make, keys: list[str]) -> DataFrame:
    """Runs a stream over the event log to its end, a file at a time, and returns the last state of each key."""
    place = new_path(s, "stream")
    schema = s.read.parquet(f"{d}/events.parquet").schema
    source = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parquet*")
    log = s.sql(VIEWS["ledger"], events=source).withColumn("ts", F.col("ts").cast("timestamp"))

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{place}/out")

    make(log).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    out = s.read.parquet(f"{place}/out")
    rest = [c for c in out.columns if c not in (*keys, "_batch")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("x")).select(*keys, "x.*")


@query(f"WITH {LEDGER} SELECT portfolio_id, round(arg_max(cash, struct_pack(ts := ts, e := event_id)), 6) AS cash, round(arg_max(equity, struct_pack(ts := ts, e := event_id)), 6) AS equity, count(*) AS n_events FROM st GROUP BY 1")
def stream_portfolio_state(s, d):
    x = streamed(s, d, lambda log: streams.stream_portfolio_state(log, CASH), ["portfolio_id"])
    return x.select("portfolio_id", F.round("cash", 6).alias("cash"), F.round("equity", 6).alias("equity"), "n_events")


@query(f"""WITH {FINAL}, tt AS (SELECT portfolio_id, round(arg_max(cash, struct_pack(ts := ts, e := event_id)), 6) AS cash, round(arg_max(equity, struct_pack(ts := ts, e := event_id)), 6) AS equity, count(*) AS n_events FROM st GROUP BY 1)
SELECT portfolio_id, symbol, round(units, 6) AS units, round(price, 6) AS price, round(ay, 6) AS accrued_yield, cash, equity, n_events FROM ps JOIN tt USING (portfolio_id)""")
def stream_positions(s, d):
    """Positions and totals of a stream with a state row for each symbol of a portfolio."""
    with keyed.keyed_state(s):
        x = streamed(s, d, lambda log: keyed.stream_positions(log, CASH), ["portfolio_id", "symbol"])
    totals = x.where("symbol IS NULL").select("portfolio_id", "cash", "equity", "n_events")
    return r6("units", "price", "accrued_yield", "cash", "equity", df=x.where("symbol IS NOT NULL").select("portfolio_id", "symbol", "units", "price", "accrued_yield").join(totals, "portfolio_id"))


@query("""WITH t AS (SELECT *, price / lag(price) OVER w - 1 AS r, row_number() OVER w AS n FROM ledger WHERE event_type = 'MARKET_TICK' WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)),
v AS (SELECT symbol, ts, event_id, price, CASE WHEN n > 5 THEN stddev_samp(r) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN 28 PRECEDING AND CURRENT ROW) * sqrt(365) ELSE CAST(0.3 AS DOUBLE) END AS vol FROM t),
a AS (SELECT symbol, arg_max(price, struct_pack(t := ts, e := event_id)) AS p, arg_max(vol, struct_pack(t := ts, e := event_id)) AS v, count(*) AS n FROM v GROUP BY 1),
c AS (SELECT symbol, arg_max(spot_cvd, struct_pack(t := ts, e := event_id)) AS sc, arg_max(perp_cvd, struct_pack(t := ts, e := event_id)) AS pc FROM ledger WHERE event_type = 'DERIVATIVES_METRICS' GROUP BY 1)
SELECT symbol, round(p, 6) AS latest_price, round(sc, 6) AS spot_cvd, round(pc, 6) AS perp_cvd, round(v, 6) AS realized_vol, coalesce(n, 0) AS n_prices FROM a FULL JOIN c USING (symbol)""")
def stream_market_cache(s, d):
    return r6("latest_price", "spot_cvd", "perp_cvd", "realized_vol", df=streamed(s, d, streams.stream_market_cache, ["symbol"]))
