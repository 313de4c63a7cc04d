"""Combinatorial purged cross-validation, deflated Sharpe ratio and the overfitting gate."""

from __future__ import annotations

import json
from itertools import combinations
from math import e

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions.normal import normal_cdf, normal_ppf

YEAR = 365.0
EULER_GAMMA = 0.57721566490153286


def block_of(idx: Column, n: Column, splits: int) -> Column:
    """Block of a row: contiguous blocks of n // splits rows, the last takes the rest; fewer rows than blocks: all last."""
    size = F.floor(n / splits)
    return F.when(size > 0, F.least(F.floor(idx / F.greatest(size, F.lit(1))), F.lit(splits - 1))).otherwise(splits - 1).cast("long")


def cpcv_blocks(returns: DataFrame, splits: int = 6) -> DataFrame:
    n = F.count("*").over(W.partitionBy("strategy_id"))
    return returns.withColumn("n", n).withColumn("block", block_of(F.col("idx"), F.col("n"), splits))


def test_sets(spark, splits: int, k: int) -> DataFrame:
    """split_id, block: the C(splits, k) test sets in lexicographic order; tiny, safe to broadcast."""
    rows = [(s, b) for s, chosen in enumerate(combinations(range(splits), k)) for b in chosen]
    return spark.createDataFrame(rows, "split_id long, block long")


def cpcv_intervals(returns: DataFrame, splits: int = 6, k: int = 2, purge: int = 5, embargo: int = 5) -> DataFrame:
    """strategy_id, split_id, block, role, first_idx, end_idx: the rows idx from first_idx up to, not with, end_idx have one role in
    the split: test, purged, embargoed or train, the first that applies. An interval lies in one block. Some splits x blocks rows
    for each strategy, whatever its length; idx counts from 0 without gaps."""
    sizes = returns.groupBy("strategy_id").agg(F.count("*").alias("n"))
    sets = json.dumps([{"split_id": s, "tests": c} for s, c in enumerate(combinations(range(splits), k))])
    chosen = F.explode(F.from_json(F.lit(sets), "array<struct<split_id:bigint,tests:array<int>>>"))
    rows = sizes.withColumn("_c", chosen).select("strategy_id", "n", "_c.split_id", "_c.tests")
    size, n = F.floor(F.col("n") / splits), F.col("n")
    # with fewer rows than blocks, every block but the last is empty at 0
    first = lambda b: F.when(size == 0, F.lit(0)).otherwise(b * size).cast("long")
    last = lambda b: F.when(b == splits - 1, n).when(size == 0, F.lit(0)).otherwise((b + 1) * size).cast("long")
    every = F.sequence(F.lit(0), F.lit(splits - 1))
    cuts = F.concat(F.transform(every, first), F.array(n), *[F.transform("tests", at) for at in (last, lambda b: first(b) - purge, lambda b: last(b) + embargo)])
    rows = rows.withColumn("_p", F.array_sort(F.array_distinct(F.filter(cuts, lambda x: (x >= 0) & (x <= n)))))
    pairs = F.transform(F.slice("_p", 1, F.size("_p") - 1), lambda x, i: F.struct(x.alias("first_idx"), F.get("_p", i + 1).alias("end_idx")))
    rows = rows.withColumn("_i", F.explode(pairs)).select("strategy_id", "split_id", "n", "tests", "_i.*")
    i = F.col("first_idx")
    within = lambda start, end: F.exists("tests", lambda b: (i >= start(b)) & (i < end(b)))
    role = F.when(within(first, last), "test").when(within(lambda b: first(b) - purge, first), "purged").when(within(last, lambda b: last(b) + embargo), "embargoed").otherwise("train")
    return rows.select("strategy_id", "split_id", block_of(i, n, splits).alias("block"), role.alias("role"), "first_idx", "end_idx")


def with_roles(returns: DataFrame, intervals: DataFrame, splits: int = 6) -> DataFrame:
    """The rows of returns, once for each split of the intervals (filter them by split or role first for what is needed): an
    equal join on strategy and block, then the interval inside it."""
    inside = (F.col("idx") >= F.col("first_idx")) & (F.col("idx") < F.col("end_idx"))
    return cpcv_blocks(returns, splits).join(intervals, ["strategy_id", "block"]).where(inside).drop("first_idx", "end_idx")


def cpcv_splits(returns: DataFrame, splits: int = 6, k: int = 2, purge: int = 5, embargo: int = 5) -> DataFrame:
    """role of each row in each split: test, purged, embargoed or train. C(splits, k) rows per row, so only for
    callers that need roles of all; path Sharpe ratios come from block moments, sizes and bounds from cpcv_intervals()."""
    return with_roles(returns, cpcv_intervals(returns, splits, k, purge, embargo), splits)


def cpcv_path_sharpe(returns: DataFrame, splits: int = 6, k: int = 2) -> DataFrame:
    """Annualised Sharpe ratio of each split's test rows, from moments per block: no copy of the rows per split."""
    moments = cpcv_blocks(returns, splits).groupBy("strategy_id", "block").agg(F.count("*").alias("n"), F.avg("ret").alias("m"), F.var_pop("ret").alias("v"))
    paths = moments.join(F.broadcast(test_sets(returns.sparkSession, splits, k)), "block").groupBy("strategy_id", "split_id").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("_s"), F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))).alias("_q")
    )
    mean = F.col("_s") / F.col("n")
    var = (F.col("_q") - F.col("_s") * mean) / (F.col("n") - 1)
    paths = paths.where("n > 5").withColumn("_std", F.sqrt(F.greatest(var, F.lit(0.0))))
    return paths.select("strategy_id", "split_id", F.when(F.col("_std") > 1e-6, mean / F.col("_std") * F.sqrt(F.lit(YEAR))).otherwise(0.0).alias("sharpe"))


def path_pbo(paths: DataFrame) -> DataFrame:
    return paths.groupBy("strategy_id").agg(F.avg(F.when(F.col("sharpe") <= 0, 1.0).otherwise(0.0)).alias("pbo"))


def moments_of(returns: DataFrame) -> DataFrame:
    """Per strategy: count, annualised Sharpe ratio, biased skewness, Pearson kurtosis; one grouping."""
    g = returns.groupBy("strategy_id", "family_id").agg(F.count("ret").alias("t"), F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"))
    return g.withColumn("sharpe", F.when(F.col("_s") > 1e-12, F.col("_m") / F.col("_s") * F.sqrt(F.lit(YEAR))).otherwise(0.0)).drop("_m", "_s")


def trial_sharpe_star(trials: DataFrame) -> DataFrame:
    """(family_id, sharpe) -> n_trials, variance, q1, q2 and the benchmark Sharpe ratio of the best of n trials."""
    g = trials.groupBy("family_id").agg(F.count("sharpe").alias("n_trials"), F.coalesce(F.var_samp("sharpe"), F.lit(0.0)).alias("variance"))
    clip = lambda q: F.least(F.lit(0.999999), F.greatest(F.lit(1e-6), q))
    n = F.greatest(F.lit(1), F.col("n_trials")).cast("double")
    g = g.withColumn("q1", clip(1 - 1 / n)).withColumn("q2", clip(1 - 1 / (n * e)))
    best = F.sqrt("variance") * ((1 - EULER_GAMMA) * normal_ppf("q1") + EULER_GAMMA * normal_ppf("q2"))
    return g.withColumn("sharpe_star", F.when((F.col("n_trials") <= 1) | (F.col("variance") <= 1e-12), 0.0).otherwise(best))


def deflated_sharpe(returns: DataFrame) -> DataFrame:
    """Deflated Sharpe ratio of each strategy against the trials of its family. Constant returns have no skewness:
    dsr is NULL and not valid. Under four returns: 0, not valid."""
    own = moments_of(returns)
    trials = own.select("family_id", "sharpe")
    star = trial_sharpe_star(trials).select("family_id", "sharpe_star")
    losing = trials.groupBy("family_id").agg(F.avg(F.when(F.col("sharpe") <= 0, 1.0).otherwise(0.0)).alias("pbo"))
    rows = own.join(star, "family_id").join(losing, "family_id")
    spread = F.greatest(F.lit(1e-12), 1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") * F.col("sharpe"))
    z = (F.col("sharpe") - F.col("sharpe_star")) / F.sqrt(spread / F.greatest(F.lit(1), F.col("t") - 1))
    rows = rows.withColumn("z", F.when(F.col("skew").isNotNull() & F.col("kurt").isNotNull(), z)).withColumn("dsr", normal_cdf("z"))
    short = F.col("t") < 4
    rows = rows.withColumns({c: F.when(short, F.lit(v)).otherwise(F.col(c)) for c, v in {"dsr": 0.0, "pbo": 1.0, "sharpe": 0.0, "sharpe_star": 0.0, "skew": 0.0, "kurt": 3.0}.items()})
    return rows.withColumn("is_valid", F.coalesce((F.col("dsr") >= 0.95) & (F.col("pbo") < 0.10), F.lit(False)))


def overfit_gate(records: DataFrame, fail: bool = False, max_pbo: float = 0.10, min_dsr: float = 0.95) -> DataFrame:
    """The records that violate the gate, with a message; a NULL statistic violates. fail: raise instead."""
    bad = F.coalesce((F.col("pbo") >= max_pbo) | (F.col("dsr") < min_dsr), F.lit(True))
    text = F.format_string("Strategy failed overfitting verification gate: PBO=%.4f (must be < 0.10), DSR=%.4f (must be >= 0.95).", F.col("pbo"), F.col("dsr"))
    out = records.where(bad).withColumn("message", text)
    if fail and (first := out.first()) is not None:
        raise ValueError(first["message"])
    return out
