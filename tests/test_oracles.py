"""Registered queries against DuckDB on the smallest tables.

A sample runs by default; ALL_ORACLES=1 runs every query.
"""

import os

import pytest

from compare import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "ag01_daily_warehouse_features", "ag03_level_distribution_by_period", "ag10_level_patterns", "ag14_partner_volumes",
    "ag20_category_insights", "js05_new_and_gone", "js09_ordered_page", "qa2_inflow_page", "vq02_row_rules", "vq07_assessment",
    "pf07_prepare_stock", "pf08_process_periods", "wz04_winsorize_by_rank", "ts03_gap_fill_methods", "ts08_rolling_stats", "ts14_resample",
    "ts18_trend_change", "st06_label_drift", "st09_drift_report", "st15_trend_comparison", "od06_flagged_rows", "od07_series_anomalies",
    "ev02_extended_accuracy", "ev11_ensemble", "fc15_recommend_model", "in02_reorder_by_cell", "in12_insight_run", "in15_policy_projection",
    "io06_catalog", "io09_forecast_export",
]


def _names():
    import __spark_entry__ as entry

    return sorted(entry.oracle_sql()) if os.environ.get("ALL_ORACLES") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", _names())
def test_query_equals_oracle(spark, duck, name):
    import __spark_entry__ as entry

    verdict, detail = compare(spark, duck, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert verdict == "exact", detail


def test_every_inventory_row_has_a_query():
    import __spark_entry__ as entry

    names = entry.queries()
    counts = {"io": 13, "vq": 11, "pf": 20, "wz": 4, "ts": 21, "ag": 25, "js": 11, "st": 20, "od": 11, "fc": 19, "ev": 14, "in": 18}
    for family, n in counts.items():
        for i in range(1, n + 1):
            assert any(q.startswith(f"{family}{i:02d}_") for q in names), f"{family}{i:02d}"
    assert all(any(q.startswith(f"qa{i}_") for q in names) for i in range(1, 5))


def test_flagship_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
