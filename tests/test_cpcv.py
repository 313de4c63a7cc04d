"""Roles of cross-validation as intervals, against the rule row by row."""

from itertools import combinations

import pytest

from foliospark.operators import validation

KIND = "strategy_id long, idx long, ret double"


def plain_roles(n, splits, k, purge, embargo):
    size = n // splits
    block = lambda i: splits - 1 if size == 0 else min(i // size, splits - 1)
    start = lambda b: 0 if size == 0 else b * size
    end = lambda b: n if b == splits - 1 else (0 if size == 0 else (b + 1) * size)
    out = {}
    for s, tests in enumerate(combinations(range(splits), k)):
        for i in range(n):
            if any(start(b) <= i < end(b) for b in tests):
                role = "test"
            elif any(start(b) - purge <= i < start(b) for b in tests):
                role = "purged"
            elif any(end(b) <= i < end(b) + embargo for b in tests):
                role = "embargoed"
            else:
                role = "train"
            out[s, i] = (block(i), role)
    return out


@pytest.mark.parametrize("splits,k,purge,embargo", [(6, 2, 5, 5), (4, 1, 0, 0), (5, 3, 40, 2), (3, 2, 1, 100), (1, 1, 2, 2)])
def test_intervals_equal_the_rule(spark, splits, k, purge, embargo):
    lengths = {1: 120, 2: 61, 3: 6, 4: 5, 5: 1}
    returns = spark.createDataFrame([(s, i, 0.1) for s, n in lengths.items() for i in range(n)], KIND)
    intervals = validation.cpcv_intervals(returns, splits, k, purge, embargo).collect()
    rows = validation.cpcv_splits(returns, splits, k, purge, embargo).collect()
    for s, n in lengths.items():
        want = plain_roles(n, splits, k, purge, embargo)
        got = {(r.split_id, i): (r.block, r.role) for r in intervals if r.strategy_id == s for i in range(r.first_idx, r.end_idx)}
        assert got == want and sum(r.end_idx - r.first_idx for r in intervals if r.strategy_id == s) == len(want)
        mine = [r for r in rows if r.strategy_id == s]
        assert len(mine) == len(want) and {(r.split_id, r.idx): (r.block, r.role) for r in mine} == want


def test_rows_follow_splits_and_blocks(spark):
    """Ten times the returns make no more intervals, and no cross join."""
    for n in (600, 6000):
        returns = spark.range(n).selectExpr("1L as strategy_id", "id as idx", "0.1D as ret")
        assert validation.cpcv_intervals(returns).count() <= 15 * (6 + 4 * 2)
    plan = validation.cpcv_splits(returns)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_one_split_alone(spark):
    returns = spark.range(60).selectExpr("1L as strategy_id", "id as idx", "0.1D as ret", "'x' as block_name")
    intervals = validation.cpcv_intervals(returns).where("split_id = 3 AND role = 'train'")
    want = [i for (s, i), (_, role) in plain_roles(60, 6, 2, 5, 5).items() if s == 3 and role == "train"]
    assert sorted(r.idx for r in validation.with_roles(returns, intervals).collect()) == want
