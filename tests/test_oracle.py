"""A quick slice of the registered queries against DuckDB; tests/oracle_check.py runs all of them."""

import pytest

import __spark_entry__ as entry
from navstead.plans import load_all
from navstead.plans.registry import ORACLES, QUERIES
from tests.oracle_check import compare, connect

QUICK = (
    "daily_returns", "fund_return_metrics", "spike_removal", "asof_join", "peer_group_keys", "holdings_structure", "scheme_master_scan", "universe_gate",
    "override_validation", "resolve_curated", "tied_percentile_rank", "utility_weights", "eligibility_gate", "live_gate_state", "model_health_report",
)


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, sf, con, name):
    assert compare(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name]).startswith("ok")


#: Queries whose result no DuckDB text gives: fits, and what stands on live scores.
WITHOUT_ORACLE = {
    "batch_coverage", "boosted_tree_holdout", "coefficient_ranking", "coefficient_sign_stability", "elastic_net_folds", "fold_grid_auc", "ledger_rows_from_scores", "live_scores",
    "monitoring_block", "stored_model_artifact",
}


def test_registry_is_consistent():
    load_all()
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150
    assert set(QUERIES) - set(ORACLES) == WITHOUT_ORACLE


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
