"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
"""

import json
import os
import time

from wardlens.plans.catalogue import PLANS
from wardlens.session import get_spark
from wardlens.sources.tables import Tables

HEADLINE = (
    "department_admission_rank", "monthly_admission_change", "above_average_los_departments", "no_show_rate_by_department",
    "database_snapshot", "validation_report", "patient_overlap", "duplicate_rows", "describe_numeric", "department_activity",
    "adaptive_kpis", "dashboard_charts", "time_chart", "resolve_roles", "daily_lag_features", "stratified_split", "equipment_impute",
    "equipment_priority", "fixed_chunks", "paragraph_chunks", "tokenize", "lexical_search", "vector_search", "classify_questions",
    "answer_questions", "workspace_latest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, folder)
    PLANS["admissions_by_department"](tables).collect()  # start-up cost is not a query's cost
    timings = {}
    for name in HEADLINE:
        started = time.perf_counter()
        PLANS[name](tables).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": timings, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
