"""Registered queries against their SQL.

A few run by default. FOREWARN_ALL=1 runs every one, FOREWARN_SF_DIR picks the tables.
"""

import os

import pytest

import __spark_entry__ as contract
from tests.sqlcheck import connect, differences

SAMPLE = ["val4_quarantined_rows", "ts5_window_features_fleet", "jn2_forward_asof_large_table", "ts14_cadence_profile", "ag13_policy_metrics"]
NAMES = list(contract.oracle_sql()) if os.environ.get("FOREWARN_ALL") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, name):
    found = contract.queries()[name](spark, sf_dir)
    assert differences(found, connect(sf_dir), contract.oracle_sql()[name]) == []


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_answers_per_horizon(spark):
    rows = contract.entry(spark).collect()
    assert sorted(r["horizon_hours"] for r in rows) == [1, 3, 6, 12]
    assert all(r["predictive_windows"] == r["positive_windows"] + r["negative_windows"] > 0 for r in rows)
