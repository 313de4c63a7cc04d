"""P&L attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pnl_attribution(weights: DataFrame, assets: DataFrame, returns: DataFrame) -> DataFrame:
    """weights (portfolio_id, symbol, weight), assets (symbol, beta, funding, apy; NULL for none), returns
    (portfolio_id, total_return, benchmark_return) -> factor, carry, rwa yield, residual. A symbol with an apy is
    an RWA holding and has no factor exposure."""
    rows = weights.join(assets.select("symbol", "beta", "funding", "apy"), "symbol", "left")
    w = F.col("weight")
    sums = rows.groupBy("portfolio_id").agg(
        F.sum(F.when(F.col("apy").isNull(), w * F.coalesce("beta", F.lit(1.0))).otherwise(0.0)).alias("_beta"),
        F.sum(w * F.coalesce("funding", F.lit(0.0))).alias("carry"), F.sum(F.when(F.col("apy").isNotNull(), w * F.col("apy")).otherwise(0.0)).alias("rwa"),
    )
    out = sums.join(returns, "portfolio_id").withColumn("factor", F.col("_beta") * F.col("benchmark_return"))
    out = out.withColumn("residual", F.col("total_return") - (F.col("factor") + F.col("carry") + F.col("rwa")))
    error = F.when(F.abs("total_return") > 1e-6, F.abs("residual") / F.abs("total_return") * 100).otherwise(0.0)
    return out.select("portfolio_id", "factor", "carry", "rwa", "residual", error.alias("error_pct"))
