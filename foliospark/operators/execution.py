"""Trading cost, drift, rebalance decisions, collateral and pre-trade limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cost rates, bands, haircuts, limits.
SPREAD, FEE, IMPACT, NO_DEPTH = 2.5e-4, 5e-4, 0.5, 0.01
CORE_BAND, SATELLITE_BAND, DEFAULT_DEPTH = 0.05, 0.10, 100_000.0
HAIRCUTS = {"CASH": 0.0, "RWA_YIELD": 0.01, "CORE": 0.15, "SATELLITE": 0.40}
SATELLITE_CAP, WEIGHT_TOLERANCE, MIN_COVERAGE = 0.15, 1e-4, 1.25


def trade_cost(df: DataFrame) -> DataFrame:
    """Adds spread_cost, fee_cost, impact_cost, total_cost, cost_pct, effective to (notional, depth_2pct, ter)."""
    n, depth = F.abs("notional"), F.col("depth_2pct")
    impact = F.when(depth > 0, IMPACT * F.sqrt(n / depth) * n * SPREAD).otherwise(n * NO_DEPTH)
    out = df.withColumns({"spread_cost": n * SPREAD, "fee_cost": n * FEE, "impact_cost": F.when(n == 0, 0.0).otherwise(impact)})
    out = out.withColumn("total_cost", F.col("spread_cost") + F.col("fee_cost") + F.col("impact_cost"))
    worth = (n == 0) | (F.col("ter") <= 0) | (F.col("ter") > F.col("total_cost"))
    return out.withColumns({"cost_pct": F.when(n == 0, 0.0).otherwise(F.col("total_cost") / n), "effective": worth})


def weight_drift(current: DataFrame, target: DataFrame, equity: DataFrame, assets: DataFrame, keys: tuple[str, ...] = ("portfolio_id",)) -> DataFrame:
    """One row per symbol on either side: drift, band, cost and approval. keys should hold as_of where there are
    several instants, so that the join spreads over them."""
    on = [*keys, "symbol"]
    both = current.withColumnRenamed("weight", "current_weight").join(target.withColumnRenamed("weight", "target_weight"), on, "full_outer").fillna(0.0, ["current_weight", "target_weight"])
    rows = both.join(equity, list(keys)).join(assets.select("symbol", "category", "depth_2pct"), "symbol", "left")
    drift = F.abs(F.col("current_weight") - F.col("target_weight"))
    rows = rows.withColumns({
        "drift": drift, "breached": drift > F.when(F.col("category") == "CORE", CORE_BAND).otherwise(SATELLITE_BAND),
        "notional": (F.col("target_weight") - F.col("current_weight")) * F.col("equity"), "depth_2pct": F.coalesce("depth_2pct", F.lit(DEFAULT_DEPTH)), "ter": 0.5 * drift * drift * F.col("equity"),
    })
    out = trade_cost(rows).withColumn("approved", F.col("breached") & F.col("effective"))
    money = lambda c: F.format_string("%.2f", c)
    why = F.when(~F.col("breached"), "Drift within tolerance band").when(~F.col("effective"), F.concat(F.lit("Execution cost ("), money(F.col("total_cost")), F.lit(") exceeds tracking error reduction ("), money(F.col("ter")), F.lit(")")))
    return out.withColumn("rejection_reason", why)


def rebalance_decision(drifts: DataFrame, keys: tuple[str, ...] = ("portfolio_id",)) -> DataFrame:
    some = drifts.groupBy(*keys).agg(
        F.bool_or("breached").alias("_any"), F.bool_or("approved").alias("_ok"), F.sort_array(F.collect_list(F.when(F.col("breached"), F.col("symbol")))).alias("triggered"),
        F.sum(F.when(F.col("approved"), F.col("total_cost")).otherwise(0.0)).alias("total_cost"),
    )
    return some.select(*keys, (F.col("_any") & F.col("_ok")).alias("should_rebalance"), "triggered", "total_cost")


def executable_orders(drifts: DataFrame, prices: DataFrame) -> DataFrame:
    """Approved instructions with a usable price and at least one unit of money; impact is not charged as fee."""
    rows = drifts.where("approved").join(prices.select("symbol", F.col("price")), "symbol").where((F.col("price") > 0) & (F.abs("notional") >= 1.0))
    return rows.withColumns({
        "units": F.abs("notional") / F.col("price"), "side": F.when(F.col("notional") > 0, "BUY").otherwise("SELL"), "fee": F.col("fee_cost") + F.col("spread_cost"),
    })


def haircut(category: Column) -> Column:
    cut = F.lit(HAIRCUTS["SATELLITE"])
    for name, h in HAIRCUTS.items():
        cut = F.when(category == name, h).otherwise(cut)
    return cut


def effective_collateral(positions: DataFrame, cash: DataFrame, assets: DataFrame) -> DataFrame:
    """cash plus notional less haircuts; a portfolio without positions has its cash."""
    valued = positions.join(assets.select("symbol", "category"), "symbol", "left").groupBy("portfolio_id").agg(F.sum(F.col("notional") * (1 - haircut(F.col("category")))).alias("_v"))
    return cash.join(valued, "portfolio_id", "left").select("portfolio_id", (F.col("cash") + F.coalesce("_v", F.lit(0.0))).alias("collateral"))


def pretrade_check(proposed: DataFrame, assets: DataFrame, margins: DataFrame) -> DataFrame:
    """proposed weights, and per portfolio collateral and required_margin -> violations in order and passed."""
    rows = proposed.join(assets.select("symbol", "category"), "symbol", "left")
    over = (F.coalesce("category", F.lit("SATELLITE")) == "SATELLITE") & (F.col("weight") > SATELLITE_CAP)
    text = F.format_string(f"Concentration cap breached for %s: proposed weight %.2f%% > max satellite cap {SATELLITE_CAP:.2%}%", F.col("symbol"), F.col("weight") * 100)
    sums = rows.groupBy("portfolio_id").agg(F.sum("weight").alias("total_weight"), F.sort_array(F.collect_list(F.when(over, text))).alias("caps"))
    out = sums.join(margins, "portfolio_id")
    need = F.col("required_margin") > 0
    coverage = F.when(need, F.col("collateral") / F.col("required_margin")).when(F.col("collateral") > 0, float("inf")).otherwise(0.0)
    out = out.withColumn("coverage", coverage)
    off = (F.abs(F.col("total_weight") - 1) > WEIGHT_TOLERANCE) & (F.col("total_weight") > 0)
    thin = need & (F.col("coverage") < MIN_COVERAGE)
    note = lambda test, t: F.when(test, F.array(t)).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("violations", F.concat("caps", note(off, F.format_string("Proposed weights sum to %.4f, expected 1.0", F.col("total_weight"))), note(thin, F.format_string(f"Liquidation risk: Margin coverage ratio %.2f below required buffer {MIN_COVERAGE:.2f}", F.col("coverage")))))
    return out.select("portfolio_id", "total_weight", "coverage", "violations", (F.size("violations") == 0).alias("passed"), F.size("caps").alias("n_caps"), off.alias("off_sum"), thin.alias("thin_margin"))
