"""Every query with an oracle must return its rows on the smallest tables; those that
need a wider market are compared on the next size, where they have rows."""

import pytest

from catalog import all_oracles, all_queries
from tests.oracle_compare import compare, connect

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


#: Months of the smallest tables have too few symbols for these.
WIDER = "d30_rank_ic d33_factor_portfolio d34_scored_months d34_score_evaluation d14_period_performance d36_context_table h5_gated_period_returns h3_rule_picks c11_purged_folds h8_walk_forward_folds d43_t_of_means d44_annual_compounding d35_volatility_matched".split()


@pytest.mark.parametrize("name", sorted(set(ORACLES) - set(WIDER)))
def test_matches_oracle(spark, duck, sf_dir, name):
    _, diff = compare(spark, duck, sf_dir, QUERIES[name], ORACLES[name])
    assert not diff, diff


@pytest.mark.parametrize("name", WIDER)
def test_matches_oracle_with_rows(spark, name):
    where = "/root/testdata/sf0.01"
    rows, diff = compare(spark, connect(where), where, QUERIES[name], ORACLES[name])
    assert rows and not diff, diff
