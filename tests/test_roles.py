"""Role resolution: text comparisons equal the patterns, one name in most tables, and a plan that hashes."""

from pyspark.sql import functions as F

from wardlens.functions import roles as rules
from wardlens.operators import catalog

NAMES = [
    "department", "dept_id", "my_dept_x", "admission_id", "admit_number", "id_admission", "los", "los_days", "xlos", "stay_length", "total_beds",
    "capacity", "capacity_available", "available_capacity", "utilization_rate", "failures", "equipment_failures", "failures_x", "status", "type",
    "asset_state", "patient_no", "patient_id", "datetime", "", "failed_event", "a_(id", "wait_2", "unnamed",
]


def test_comparisons_equal_patterns(spark):
    patterns = {p.lstrip("!") for table in (rules.ROLE_PATTERNS, dict(rules.MODULES)) for some in table.values() for one in some for p in one}
    patterns |= {p for one in rules.FAILURE_EVENT_PATTERNS for p in one} | {rules.EQUIPMENT_WORDS, "(fail|x).*e"}
    names = spark.createDataFrame([(n,) for n in [*NAMES, None]], "name string")
    for pattern in sorted(patterns):
        differs = ~catalog._found(F.col("name"), pattern).eqNullSafe(F.col("name").rlike(pattern))
        assert names.where(differs).count() == 0, pattern


def test_roles_of_one_name_everywhere(spark):
    """Ties go to the first position, bare names need an equipment column, and no step meets on the name."""
    rows = [(f"t{i}", p, n) for i in range(300) for p, n in enumerate(["status", "dept", "department_name", "date"])]
    rows += [("tools", 0, "device_tag"), ("tools", 1, "state"), ("tools", 2, "status"), ("tools", 3, "type"), ("bare", 0, "type")]
    frame = spark.createDataFrame(rows, "dataset_id string, position bigint, name string")
    found = catalog.resolve_roles(frame)
    got = {}
    for r in found.collect():
        assert got.setdefault(r.dataset_id, {}).setdefault(r.role, r.column_name) == r.column_name
    for dataset in ("t0", "t299", "tools", "bare"):
        names = [n for d, _, n in rows if d == dataset]
        want = {role: c for role in rules.ROLE_ALIASES if (c := rules.resolve(names, role))}
        assert got.get(dataset, {}) == want
    assert catalog.resolve_roles(frame.where("false")).count() == 0
    assert "SortAggregate" not in found._jdf.queryExecution().toString()


def test_the_gate_does_not_read_the_names_again(spark):
    """Which roles are played decides; the join that fetches their names shuffled the whole catalogue."""
    frame = spark.createDataFrame([(1, 0, "record_date"), (1, 1, "occupied_beds"), (2, None, "occupied_beds")], "dataset_id long, position long, name string")
    gate = catalog.feature_gate(frame)
    assert gate._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert {(r.dataset_id, r.missing) for r in gate.where("model = 'bed_forecast'").collect()} == {(1, ""), (2, "date,occupied_beds")}


def test_large_positions_are_kept_apart(spark):
    frame = spark.createDataFrame([(1, (1 << 50) + 3, "admission_date"), (1, 5, "note")], "dataset_id long, position long, name string")
    assert [tuple(r) for r in catalog.resolve_roles(frame).where("role = 'date'").collect()] == [(1, "date", "admission_date")]
