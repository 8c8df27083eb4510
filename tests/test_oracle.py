"""Registered queries against their oracle SQL, and the driver contract."""

import os

import pytest
from oracle_check import compare, duck

FOLDER = "/root/testdata/sf0.001"
# One query per operator family; ``python tests/oracle_check.py`` runs all of them.
CHOSEN = ["bars_hourly", "features_latest", "motion_pivot", "rollup_audit_sparse_feed", "clean_bars_audit", "segments", "lifecycle_state", "lifecycle_illegal_steps",
          "close_intervals", "signal_field", "identity_remap", "holding_changes", "named_relations", "quote_containment", "tree_check", "backtest_curve"]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_oracle(spark, connection, name):
    from chronoweave.plans import ORACLES, QUERIES

    problem = compare(spark, connection, FOLDER, QUERIES[name], ORACLES[name])
    assert problem in (None, "no rows")


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 70
    assert entry.entry(spark).count() > 0
