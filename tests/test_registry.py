import pytest

from foliospark.plans import registry
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLE[name], connect(SF))


@pytest.mark.parametrize("name", ["risk_parity_weights", "strategy_replay", "regime_model"])
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


#: Every query of the library.
NAMES = """normalize_ticks tick_events event_log book_depth_2pct margin_ratio cvd_regime regime_rules trade_cost daily_yield executable_orders overfit_gate weight_drift asof_market returns_90d
asset_universe pnl_attribution onchain_metrics altcoin_season_index effective_collateral pretrade_check rebalance_decision allocation_plan portfolio_vol portfolio_vol_covariance vol_target_weights
regime_adjusted_weights returns_covariance risk_contributions trial_sharpe_star trial_sharpe_star_value deflated_sharpe deflated_sharpe_score deflated_gate path_pbo backtest_summary position_ledger
portfolio_state portfolio_state_from_start position_weights state_at state_at_from_start realized_vol_30 daily_equity daily_returns drawdown cpcv_blocks cpcv_splits cpcv_path_sharpe risk_parity_weights
risk_parity_pairs strategy_replay strategy_replay_idle regime_model stream_portfolio_state stream_market_cache
states_at_instants state_from_snapshot asof_trades_quotes asof_derivatives_ticks rolling_covariance cpcv_intervals stream_positions event_log_days tiled_covariance""".split()


def test_all_keys_of_the_inventory_are_there():
    assert set(NAMES) <= set(registry.QUERIES)
    assert set(registry.QUERIES) - set(registry.ORACLE) == {"risk_parity_weights", "strategy_replay", "regime_model"}


def test_risk_parity_weights_have_equal_contributions(spark):
    """Of four assets in every group: each contributes the same risk."""
    weights = registry.QUERIES["risk_parity_weights"](spark, SF)
    shares = registry.allocation.risk_contributions(weights, registry.covariance(spark, SF)).toPandas()
    for _, g in shares.groupby("grp"):
        assert len(g) == 4 and (g["rc"] > 0).all() and g["rc"].max() <= g["rc"].min() * (1 + 1e-4)
    assert weights.toPandas().groupby("grp")["weight"].sum().sub(1).abs().max() < 1e-9


def test_regime_scores_are_those_of_all_rows(spark):
    rows = registry.QUERIES["regime_model"](spark, SF).toPandas()
    assert len(rows) == registry.view(spark, SF, "regime_features").count() and rows["obs"].is_unique
    assert (rows[["p_bull", "p_bear", "p_consolidation"]].sum(axis=1) - 1).abs().max() < 1e-6
    assert set(rows["regime"]) <= {"BULL", "BEAR", "CONSOLIDATION"} and 0 < rows["held_out"].sum() < len(rows)
    best = rows[["p_bull", "p_bear", "p_consolidation"]].to_numpy().argmax(axis=1)
    assert [("BULL", "BEAR", "CONSOLIDATION")[k] for k in best] == list(rows["regime"])
