"""Every registered query against its reference SQL on the smallest data folder."""

import pytest

from tools.check import compare
from wardlens.plans.catalogue import ORACLES, PLANS


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, tables, database):
    ok, _, detail = compare(database, tables, name)
    assert ok, detail


def test_queries_without_sql_are_known():
    # Trained forests, NFKC and file listings have no SQL equivalent.
    assert set(PLANS) - set(ORACLES) == {
        "actual_vs_predicted", "admission_demand_model", "bed_demand_model", "clean_table_cells_nfkc", "clean_text",
        "equipment_failure_model", "file_manifest", "forecast_beds_7d", "forecast_beds_7d_by_department", "forecast_next_month",
        "history_plus_forecast", "los_model", "no_show_model", "save_model", "score_equipment",
    }
