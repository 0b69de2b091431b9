"""Registered queries against their SQL on DuckDB.

All queries run with EVENTLOOM_ALL=1; by default one or two per area.
"""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import connect, difference  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = os.environ.get("EVENTLOOM_SF", "/root/testdata/sf0.001")
CORE = (
    "window_matrix", "scan_events", "meas_persistent_positivity", "signals_all_domains", "drug_repeat_at_least_n", "resolve_all",
    "coverage_report", "build_cohort_relaxed", "attrition", "ancestor_flags", "acute_severity", "titer_features", "lab_summary",
    "temporal_trends", "late_divergence", "assemble_full", "balance", "auroc", "average_precision", "net_benefit", "cal_slope",
    "paired_tests", "table_one", "selection_frequency",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("EVENTLOOM_ALL") else CORE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert difference(got, duck.execute(entry.oracle_sql()[name]).fetchdf()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
