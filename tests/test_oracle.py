"""Every query with an oracle equals it on the small data set; the others return rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from voltlake import plans  # noqa: E402
from tools.check import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
SLOW = {"ml_tune"}  # a hundred fits; run by tools/check.py
EMPTY_OK = {"cost_anomalous", "cost_budget_levels", "st_budget_alert", "drift_missing_baseline", "gov_access_audit"}  # nothing to report in the smallest sample


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in plans.QUERIES if n not in SLOW])
def test_query(spark, con, name):
    rows, state, note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert state in ("ok", "rows-only") or (state == "EMPTY" and name in EMPTY_OK), (rows, state, note)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
