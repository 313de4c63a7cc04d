"""Target weights: core-satellite plan, volatility targeting, regime adjustment, covariance and risk parity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions.scan import hot_keys, scan
from foliospark.functions.stats import risk_parity

#: The plan's targets and symbols.
CORE = {"BTC": 0.40, "ETH": 0.20}
SATELLITE, RWA, MIN_DEPTH, RWA_SYMBOL, APY = 0.30, 0.10, 10_000.0, "BUIDL", 0.045
RISKY = ("BTC", "ETH", "SOL", "AVAX")


def daily_yield(df: DataFrame) -> DataFrame:
    return df.withColumn("daily_yield", F.col("notional") * F.coalesce(F.col("apy"), F.lit(APY)) / 365)


def allocation_plan(candidates: DataFrame) -> DataFrame:
    """(plan_id, symbol, depth_2pct) -> plan_id, symbol, weight. A candidate gets its share of 30 % if it is deep
    enough; the share is by the number of candidates, so what thin ones leave goes to the RWA sleeve."""
    per_plan = candidates.groupBy("plan_id").agg(F.count("symbol").alias("_n"), F.collect_list(F.when(F.coalesce("depth_2pct", F.lit(0.0)) >= MIN_DEPTH, F.col("symbol"))).alias("_in"))
    share = F.when(F.col("_n") > 0, SATELLITE / F.col("_n")).otherwise(0.0)
    entry = lambda s, w: F.struct(s.alias("symbol"), w.alias("weight"))
    fixed = [entry(F.lit(s), F.lit(w)) for s, w in CORE.items()]
    rest = entry(F.lit(RWA_SYMBOL), RWA + (SATELLITE - share * F.size("_in")))
    rows = F.concat(F.array(*fixed, rest), F.transform("_in", lambda s: entry(s, share)))
    return per_plan.select("plan_id", F.explode(rows).alias("r")).select("plan_id", "r.symbol", "r.weight")


def portfolio_vol(base: DataFrame, vols: DataFrame) -> DataFrame:
    """Sum of weight times volatility, over the symbols that have one."""
    return base.join(vols, "symbol").groupBy("portfolio_id").agg(F.sum(F.col("weight") * F.col("realized_vol")).alias("vol"))


def covariance_vol(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """sqrt(w' C w), annualised; weights (grp, asset, weight), cov (grp, i, j, cov) over all ordered pairs."""
    wi, wj = (weights.select("grp", F.col("asset").alias(k), F.col("weight").alias(f"w{k}")) for k in "ij")
    quad = cov.join(wi, ["grp", "i"]).join(wj, ["grp", "j"]).groupBy("grp").agg(F.sum(F.col("wi") * F.col("wj") * F.col("cov")).alias("_q"))
    return quad.select("grp", (F.sqrt(F.greatest("_q", F.lit(0.0))) * F.sqrt(F.lit(365.0))).alias("vol"))


def vol_target_weights(base: DataFrame, vol: DataFrame, rwa: str, target: float = 0.25) -> DataFrame:
    """Scales all but the RWA weight by min(1, target / vol); the RWA weight becomes what is left."""
    scaled = base.join(vol, "portfolio_id", "left").withColumn("scaler", F.when(F.coalesce("vol", F.lit(0.0)) <= 0, 1.0).otherwise(F.least(F.lit(1.0), target / F.col("vol"))))
    risky = scaled.where(F.col("symbol") != rwa).select("portfolio_id", "symbol", (F.col("weight") * F.col("scaler")).alias("weight"))
    sums = scaled.groupBy("portfolio_id").agg(F.sum(F.when(F.col("symbol") != rwa, F.col("weight") * F.col("scaler")).otherwise(0.0)).alias("_s"))
    rest = sums.select("portfolio_id", F.lit(rwa).alias("symbol"), F.greatest(F.lit(0.0), 1 - F.col("_s")).alias("weight"))
    return risky.unionByName(rest)


def regime_adjusted_weights(base: DataFrame, signals: DataFrame) -> DataFrame:
    """base (key, symbol, weight) and one signal row per key (cvd_regime, regime, gamma): in liquidation or bear
    regimes risky weights are divided by gamma and the RWA sleeve takes the rest."""
    rows = base.join(signals.select("key", "cvd_regime", "regime", "gamma"), "key")
    cut = (F.col("cvd_regime") == "BROAD_LIQUIDATION") | (F.col("regime") == "BEAR")
    risky = F.col("symbol").isin(*RISKY)
    lowered = rows.withColumn("_cut", cut).withColumn("weight", F.when(F.col("_cut") & risky, F.col("weight") / F.col("gamma")).otherwise(F.col("weight")))
    sums = lowered.groupBy("key").agg(F.sum(F.when(risky, F.col("weight")).otherwise(0.0)).alias("_s"), F.any_value("_cut").alias("_cut"), F.sum(F.when(F.col("symbol") == RWA_SYMBOL, F.col("weight"))).alias("_w"))
    rest = sums.select("key", F.lit(RWA_SYMBOL).alias("symbol"), F.when(F.col("_cut"), F.greatest(F.lit(0.0), 1 - F.col("_s"))).otherwise(F.coalesce("_w", F.lit(0.0))).alias("weight"))
    return lowered.where(F.col("symbol") != RWA_SYMBOL).select("key", "symbol", "weight").unionByName(rest)


def returns_covariance(returns: DataFrame) -> DataFrame:
    """(grp, obs, asset, ret) -> grp, i, j, cov, i <= j. For narrow universes: T N^2 rows meet."""
    a, b = (returns.select("grp", "obs", F.col("asset").alias(k), F.col("ret").alias(f"r{k}")) for k in "ij")
    return a.join(b, ["grp", "obs"]).where("i <= j").groupBy("grp", "i", "j").agg(F.covar_samp("ri", "rj").alias("cov"))


def rolling_covariance(returns: DataFrame, window: int, step: int = 1, min_obs: int = 2) -> DataFrame:
    """(grp, obs, asset, ret) -> grp, as_of, i, j, n, cov, i <= j: the covariance of each two assets over the last `window`
    observations of their group, every `step` observations; n counts those that both have (under min_obs: NULL).

    Observations are numbered in their group and cut into buckets of `step`; each bucket has one small table of sums and
    products for each pair. A window's sums are a difference of two running sums over the buckets, so no row is read once for
    each window it is in. Returns are taken from their asset's mean first, which keeps the differences exact. window has to be
    a multiple of step; the last bucket may be shorter. NULL returns are no observations."""
    if window % step or window < step:
        raise ValueError("the window has to be a multiple of the step")
    from_mean = returns.groupBy("grp", "asset").agg(F.avg("ret").alias("_mean"))
    seen = returns.select("grp", "obs").distinct()
    # numbers of a group's observations: one row for each, not one for each asset
    (hot,) = hot_keys(seen, ["obs"], ["grp"])
    numbered = scan(seen, ["grp"], ["obs"], hot, sums={"_t": F.lit(1).cast("long")}).withColumn("_b", F.floor((F.col("_t") - 1) / step)).drop("_t")
    rows = returns.where(F.col("ret").isNotNull()).join(numbered, ["grp", "obs"]).join(from_mean, ["grp", "asset"]).withColumn("_x", F.col("ret") - F.col("_mean"))
    a, b = (rows.select("grp", "obs", "_b", F.col("asset").alias(k), F.col("_x").alias(f"x{k}")) for k in "ij")
    pairs = a.join(b.drop("_b"), ["grp", "obs"]).where("i <= j")
    sums = pairs.groupBy("grp", "_b", "i", "j").agg(F.count("*").alias("n"), F.sum("xi").alias("x"), F.sum("xj").alias("y"), F.sum(F.col("xi") * F.col("xj")).alias("xy"))
    ends = numbered.groupBy("grp", "_b").agg(F.max("obs").alias("as_of"))
    every = ends.join(sums.select("grp", "i", "j").distinct(), "grp")  # as many rows as the result has
    known = every.join(sums, ["grp", "_b", "i", "j"], "left")
    w = W.partitionBy("grp", "i", "j").orderBy("_b")
    now, before = w.rangeBetween(W.unboundedPreceding, 0), w.rangeBetween(W.unboundedPreceding, -(window // step))
    inside = {c: F.coalesce(F.sum(c).over(now), F.lit(0)) - F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("n", "x", "y", "xy")}
    out = known.select("grp", "as_of", "i", "j", *[v.alias(c) for c, v in inside.items()])
    cov = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.col("n") - 1)
    return out.where("n > 0").select("grp", "as_of", "i", "j", "n", F.when(F.col("n") >= max(2, min_obs), cov).alias("cov"))


def gram_covariance(vectors: DataFrame, n_assets: int) -> DataFrame:
    """The same for wide universes: (grp, x array) -> each task adds up X'X and the sums, and sends N^2 numbers per
    group once, not for each observation."""

    def partials(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict = {}
        for f in frames:
            for g, rows in f.groupby("grp"):
                x = np.stack(rows["x"].to_numpy())
                old = grams.get(g, (0, 0, 0))
                grams[g] = (old[0] + x.T @ x, old[1] + x.sum(0), old[2] + len(x))
        i, j = np.triu_indices(n_assets)
        for g, (xx, s, n) in grams.items():
            yield pd.DataFrame({"grp": g, "i": i, "j": j, "xy": xx[i, j], "x": s[i], "y": s[j], "n": n})

    parts = vectors.mapInPandas(partials, "grp long, i long, j long, xy double, x double, y double, n long")
    total = parts.groupBy("grp", "i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "x", "y", "n")])
    return total.select("grp", "i", "j", F.when(F.col("n") > 1, (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.col("n") - 1)).alias("cov"))


def tiled_covariance(vectors: DataFrame, n_assets: int, tile: int = 512, chunk: int = 4096) -> DataFrame:
    """The same for universes whose N^2 products no task should hold: (grp, obs, x array) -> grp, i, j, cov, i <= j.

    Assets are cut into tiles and a group's observations into chunks; a task multiplies two tiles of one chunk, so it holds
    2 x chunk x tile values and tile^2 products, whatever the number of assets and observations. A vector travels once for each
    tile. Sums are of differences from one vector of the group. Vectors that are NULL, of another length or hold a NULL raise."""
    tiles = -(-n_assets // tile)
    parts = F.pmod(F.xxhash64("obs"), F.ceil(F.col("_n") / chunk))
    groups = vectors.groupBy(F.col("grp").alias("_g")).agg(F.count("*").alias("_n"), F.min_by("x", "obs").alias("_from"))
    rows = vectors.join(groups, F.col("grp").eqNullSafe(F.col("_g"))).withColumn("_c", parts)
    whole = (F.size("x") == n_assets) & ~F.exists("x", lambda v: v.isNull())
    centred = F.when(whole, F.zip_with("x", "_from", lambda a, b: a.cast("double") - b.cast("double"))).otherwise(F.raise_error(F.lit("a vector is NULL, incomplete or of another length")))
    piece = lambda t: F.slice("_x", t * tile + 1, F.lit(tile))
    pairs = lambda t: F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda u: F.struct(F.least(t, u).alias("a"), F.greatest(t, u).alias("b"), t.alias("own"), piece(t).alias("seg")))
    sent = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), pairs))
    dealt = rows.withColumn("_x", centred).select("grp", "_c", "obs", F.explode(sent).alias("s")).select("grp", "_c", "obs", "s.*")

    def multiply(t: pa.Table) -> pa.Table:
        t = t.sort_by("obs")
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        own = t.column("own").to_numpy()
        side = lambda k: (lambda s: np.array(s.values).reshape(len(s), -1))(t.filter(pa.array(own == k)).column("seg").combine_chunks())
        x = side(a)
        y = x if a == b else side(b)
        i, j = np.triu_indices(x.shape[1]) if a == b else (k.ravel() for k in np.indices((x.shape[1], y.shape[1])))
        out = {"i": i + a * tile, "j": j + b * tile, "xy": (x.T @ y)[i, j], "x": x.sum(0)[i], "y": y.sum(0)[j], "n": np.full(len(i), len(x))}
        return pa.table({"grp": pa.array([t.column("grp")[0].as_py()] * len(i), pa.int64()), **{k: pa.array(v) for k, v in out.items()}})

    made = dealt.groupBy("grp", "_c", "a", "b").applyInArrow(multiply, "grp long, i long, j long, xy double, x double, y double, n long")
    total = made.groupBy("grp", "i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "x", "y", "n")])
    return total.select("grp", "i", "j", F.when(F.col("n") > 1, (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.col("n") - 1)).alias("cov"))


def both_ways(cov: DataFrame) -> DataFrame:
    return cov.unionByName(cov.where("i < j").select("grp", F.col("j").alias("i"), F.col("i").alias("j"), "cov"))


def risk_contributions(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """Marginal and total risk contribution of each asset; zeros where the volatility is under 1e-12."""
    w = weights.select("grp", F.col("asset").alias("j"), F.col("weight").alias("wj"))
    product = both_ways(cov).join(w, ["grp", "j"]).groupBy("grp", "i").agg(F.sum(F.col("cov") * F.col("wj")).alias("_m"))
    rows = product.join(weights.select("grp", F.col("asset").alias("i"), "weight"), ["grp", "i"])
    quad = rows.groupBy("grp").agg(F.sum(F.col("weight") * F.col("_m")).alias("_q"))
    rows = rows.join(quad, "grp").withColumn("_v", F.sqrt(F.greatest("_q", F.lit(0.0))))
    mcr: Column = F.when(F.col("_v") < 1e-12, 0.0).otherwise(F.col("_m") / F.col("_v"))
    return rows.select("grp", F.col("i").alias("asset"), mcr.alias("mcr"), (F.col("weight") * mcr).alias("rc"))


def risk_parity_weights(cov: DataFrame) -> DataFrame:
    """(grp, i, j, cov) -> grp, asset, weight. Groups are independent; a group holds its N^2 covariances."""

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(g[["i", "j"]].to_numpy())
        m = np.zeros((len(names), len(names)))
        i, j = np.searchsorted(names, g["i"]), np.searchsorted(names, g["j"])
        m[i, j] = m[j, i] = g["cov"]
        return pd.DataFrame({"grp": g["grp"].iloc[0], "asset": names, "weight": risk_parity(m)})

    return cov.groupBy("grp").applyInPandas(solve, "grp long, asset long, weight double")
