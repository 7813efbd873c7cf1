"""What plans must and must not contain."""

import pathlib
import re

import pytest

import __spark_entry__ as contract
from wardlens.plans.catalogue import ORACLES, PLANS

PACKAGE = pathlib.Path(__file__).resolve().parents[1] / "wardlens"
TRAINING = ("_model", "forecast", "score_equipment", "actual_vs_predicted", "encode_features", "save_model")


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_contract(spark):
    # Besides the plans of the library there may be the corpus queries, where their folder is present.
    assert set(PLANS) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert all(re.match(r"op\d+_|pipeline$", name) for name in set(contract.queries()) - set(PLANS))
    assert contract.entry(spark).columns == ["department_name", "total_admissions", "admission_rank"]


@pytest.mark.parametrize("name", sorted(n for n in PLANS if not any(t in n for t in TRAINING)))
def test_no_cross_product(name, tables):
    plan = physical(PLANS[name](tables))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_no_forbidden_calls():
    for path in PACKAGE.rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text, path
        if path.parent.name == "llm":  # broadcasts samples whose size is a parameter
            continue
        assert "wardlens.llm" not in text, path
        for word in ("localCheckpoint", "toPandas", "crossJoin", ".rdd.map", "F.udf("):
            assert word not in text, (path, word)
        # Forced only where the row numbers prove the size (fewer than 1 / hot_share keys).
        assert "F.broadcast(" not in text or path.name == "stats.py", path


def test_scan_is_pruned_and_filtered(tables):
    plan = PLANS["cancelled_last_month"](tables)._jdf.queryExecution().toString()
    assert "o_totalprice" not in plan.split("== Physical Plan ==")[1]
    plan = physical(PLANS["admissions_by_department"](tables))
    assert "l_extendedprice" not in plan


def test_top_k_is_not_a_full_sort(tables):
    assert "TakeOrderedAndProject" in physical(PLANS["equipment_priority"](tables))
    assert "WindowGroupLimit" in physical(PLANS["lexical_search"](tables))


def test_forecasts(tables):
    rows = PLANS["forecast_beds_7d"](tables).collect()
    assert len(rows) == 7 and all(r["predicted_occupied_beds"] >= 0 for r in rows)
    assert len({r["date"] for r in rows}) == 7
    mean = sum(r["predicted_occupied_beds"] for r in rows) / 7
    assert abs(rows[0]["average_predicted_occupied_beds"] - mean) < 0.011


def test_saved_model_predicts_the_same(tables):
    (row,) = PLANS["save_model"](tables).collect()
    assert row["saved"] == row["loaded"]


def test_classifier_metrics_are_shares(tables):
    (row,) = PLANS["equipment_failure_model"](tables).collect()
    assert all(0 <= row[c] <= 1 for c in ("accuracy", "precision", "recall", "f1"))


def test_scores_cover_complete_units(tables):
    (row,) = PLANS["score_equipment"](tables).collect()
    complete = tables.equipment.where("next_maintenance_date IS NOT NULL").count()
    assert row["records_scored"] == complete and 0 <= row["predicted_high_risk"] <= complete
