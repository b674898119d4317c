"""Every registered query against its SQL on the smallest test data."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SLOW = {"learning_curve", "outlier_rows_robust", "outlier_rows_chi_square", "audit_summary", "findings"}
# No row may qualify on the smallest data.
MAY_BE_EMPTY = {"iqr_outliers_events", "mar_signals"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    diff = compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name])
    if name in MAY_BE_EMPTY:
        diff = [d for d in diff if d != "both are empty"]
    assert diff == []


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - SLOW))
def test_rows_without_sql(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 11
