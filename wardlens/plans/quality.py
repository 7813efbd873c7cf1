"""V: validation and cleaning."""

from pyspark.sql import functions as F

from wardlens.operators import quality as op
from wardlens.plans.registry import query, r2

TABLES = ("admissions", "appointments", "beds", "departments", "equipment")
COLUMNS = {
    "admissions": "admission_id patient_id department_id admission_date discharge_date admission_type age gender length_of_stay bed_type discharge_status".split(),
    "appointments": "appointment_id patient_id department_id appointment_date appointment_type booking_date wait_time_days appointment_status".split(),
    "beds": "bed_record_id department_id record_date bed_type total_beds occupied_beds available_beds occupancy_rate".split(),
    "departments": "department_id department_name department_type".split(),
    "equipment": "equipment_id department_id equipment_type installation_date last_maintenance_date next_maintenance_date equipment_status usage_hours maintenance_count failure_count".split(),
}
TYPES = {
    **dict.fromkeys("patient_id appointment_id equipment_id".split(), "bigint"),
    **dict.fromkeys("department_id age length_of_stay wait_time_days total_beds occupied_beds available_beds maintenance_count failure_count".split(), "int"),
    **dict.fromkeys("occupancy_rate usage_hours".split(), "double"),
}


def all_tables(t):
    return {name: getattr(t, name) for name in TABLES}


def missing_sql(names, source=lambda n: n):
    parts = [
        f"""SELECT '{n}' AS table_name, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing_count,
            {r2(f'(COUNT(*) - COUNT({c})) / CAST(COUNT(*) AS DOUBLE) * 100')} AS missing_percent FROM {source(n)}"""
        for n in names
        for c in COLUMNS[n]
    ]
    return " UNION ALL ".join(parts)


@query("missing_counts", missing_sql(["admissions"]))
def _(t):
    return op.missing_counts(t.admissions, "admissions")


@query("missing_percent", f"SELECT * FROM ({missing_sql(TABLES)}) WHERE missing_count > 0")
def _(t):
    return op.missing_percent(all_tables(t))


def duplicates_sql(name, source=None):
    return f"SELECT '{name}' AS table_name, (SELECT COUNT(*) FROM {source or name}) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {source or name})) AS duplicate_rows"


FIVE = ("admissions", "appointments", "beds", "departments", "equipment")
VISITS = "(SELECT patient_id, department_id, admission_date, admission_type FROM admissions)"


@query("duplicate_rows", " UNION ALL ".join([duplicates_sql("visits", VISITS), *map(duplicates_sql, FIVE)]))
def _(t):
    visits = t.admissions.select("patient_id", "department_id", "admission_date", "admission_type")
    return op.duplicate_rows({"visits": visits, **{name: getattr(t, name) for name in FIVE}})


def type_of(column):
    return TYPES.get(column, "date" if column.endswith("_date") else "string")


@query("column_types", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, '{c}' AS column_name, '{type_of(c)}' AS data_type, COUNT({c}) AS values_present FROM {n}"
    for n in TABLES for c in COLUMNS[n]))
def _(t):
    return op.column_types(all_tables(t))


DATES = {n: [c for c in COLUMNS[n] if c.endswith("_date")] for n in ("admissions", "appointments", "beds", "equipment")}


@query("date_ranges", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, '{c}' AS column_name, CAST(MIN({c}) AS DATE) AS earliest, CAST(MAX({c}) AS DATE) AS latest FROM {n}"
    for n, cs in DATES.items() for c in cs))
def _(t):
    # The columns arrive as text, as they would from a raw file.
    texts = {n: getattr(t, n).select(*[F.col(c).cast("string").alias(c) for c in cs]) for n, cs in DATES.items()}
    return op.date_ranges({n: (texts[n], DATES[n]) for n in DATES})


RULES_SQL = {
    "discharge_before_admission": ("admissions", "discharge_date < admission_date"),
    "los_mismatch": ("admissions", "COALESCE(length_of_stay <> discharge_date - admission_date, TRUE)"),
    "booking_after_appointment": ("appointments", "booking_date > appointment_date"),
    "occupied_over_total": ("beds", "occupied_beds > total_beds"),
    "available_mismatch": ("beds", "COALESCE(available_beds <> total_beds - occupied_beds, TRUE)"),
    "occupancy_rate_mismatch": ("beds", "ABS(occupancy_rate / 100e0 - occupied_beds / CAST(total_beds AS DOUBLE)) > 0.01e0"),
    "maintenance_before_installation": ("equipment", "last_maintenance_date < installation_date"),
    "next_before_last_maintenance": ("equipment", "next_maintenance_date < last_maintenance_date"),
}
RULE_SETS = {
    "admissions": op.admission_rules,
    "appointments": op.appointment_rules,
    "beds": lambda: op.bed_rules(scale=100.0),
    "equipment": op.equipment_rules,
}

for _rule, (_table, _condition) in RULES_SQL.items():

    @query(_rule, f"SELECT '{_rule}' AS rule, COUNT(*) AS violations FROM {_table} WHERE {_condition}")
    def _(t, rule=_rule, table=_table):
        return op.violations(getattr(t, table), {rule: RULE_SETS[table]()[rule]})


FACTS = ("admissions", "appointments", "beds", "equipment")
REFERENCES_SQL = " UNION ALL ".join(
    f"""SELECT '{n}' AS table_name, 'invalid_department' AS rule, COUNT(*) AS violations FROM {n}
        WHERE department_id IS NULL OR department_id NOT IN (SELECT department_id FROM departments_partial)"""
    for n in FACTS
)


@query("invalid_department_refs", REFERENCES_SQL)
def _(t):
    return op.invalid_department_refs({n: getattr(t, n) for n in FACTS}, t.departments_partial)


@query("patient_overlap", f"""WITH a AS (SELECT DISTINCT patient_id FROM admissions), b AS (SELECT DISTINCT patient_id FROM appointments),
    common AS (SELECT patient_id FROM a INTERSECT SELECT patient_id FROM b), only_b AS (SELECT patient_id FROM b EXCEPT SELECT patient_id FROM a)
    SELECT (SELECT COUNT(*) FROM b) AS appointment_patients, (SELECT COUNT(*) FROM a) AS admission_patients,
    (SELECT COUNT(*) FROM only_b) AS appointment_only_patients, (SELECT COUNT(*) FROM common) AS patients_in_both,
    {r2('(SELECT COUNT(*) FROM common) / CAST((SELECT COUNT(*) FROM a) AS DOUBLE) * 100')} AS percent_of_admission_patients""")
def _(t):
    return op.patient_overlap(t.admissions, t.appointments)


@query("median_imputation_values", """SELECT 'age' AS column_name, median(age) AS median FROM admissions
    UNION ALL SELECT 'wait_time_days', median(wait_time_days) FROM appointments""")
def _(t):
    return op.median_imputation_values(t.admissions, t.appointments)


@query("fill_missing", """SELECT * REPLACE (COALESCE(CAST(age AS DOUBLE), (SELECT median(age) FROM admissions)) AS age,
    COALESCE(gender, 'Unknown') AS gender, COALESCE(bed_type, 'Unknown') AS bed_type,
    COALESCE(discharge_status, 'Unknown') AS discharge_status) FROM admissions""")
def _(t):
    return op.fill_missing(t.admissions, {"age": None}, ["gender", "bed_type", "discharge_status"])


@query("fill_missing_appointments", """SELECT * REPLACE (COALESCE(CAST(wait_time_days AS DOUBLE), 8.0) AS wait_time_days,
    COALESCE(appointment_type, 'Unknown') AS appointment_type, COALESCE(appointment_status, 'Unknown') AS appointment_status) FROM appointments""")
def _(t):
    return op.fill_missing(t.appointments, {"wait_time_days": 8.0}, ["appointment_type", "appointment_status"])


@query("joint_missing", """SELECT COUNT(*) FILTER (WHERE last_maintenance_date IS NULL) AS missing_last_maintenance,
    COUNT(*) FILTER (WHERE next_maintenance_date IS NULL) AS missing_next_maintenance,
    COUNT(*) FILTER (WHERE last_maintenance_date IS NULL AND next_maintenance_date IS NULL) AS missing_both FROM equipment""")
def _(t):
    return op.joint_missing(t.equipment)


@query("coerce_dates_keep_null", """SELECT equipment_id,
    CASE WHEN equipment_id % 7 = 0 THEN NULL ELSE last_maintenance_date END AS last_maintenance_date, next_maintenance_date FROM equipment""")
def _(t):
    # Every seventh unit carries text that is not a date.
    raw = t.equipment.select(
        "equipment_id",
        F.when(F.col("equipment_id") % 7 == 0, "not recorded").otherwise(F.col("last_maintenance_date").cast("string")).alias("last_maintenance_date"),
        F.col("next_maintenance_date").cast("string").alias("next_maintenance_date"),
    )
    return op.coerce_dates_keep_null(raw, ["last_maintenance_date", "next_maintenance_date"])


@query("remaining_missing", " UNION ALL ".join(
    f"SELECT 'equipment' AS table_name, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing_count FROM equipment HAVING COUNT(*) > COUNT({c})"
    for c in COLUMNS["equipment"]))
def _(t):
    admissions = op.fill_missing(t.admissions, {"age": 46.0}, ["gender", "bed_type", "discharge_status"])
    appointments = op.fill_missing(t.appointments, {"wait_time_days": 8.0}, ["appointment_type", "appointment_status"])
    return op.remaining_missing({**all_tables(t), "admissions": admissions, "appointments": appointments})


@query("validation_report", " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, '{rule}' AS rule, COUNT(*) AS violations FROM {table} WHERE {condition}"
    for rule, (table, condition) in RULES_SQL.items()) + " UNION ALL " + REFERENCES_SQL)
def _(t):
    return op.validation_report(t.admissions, t.appointments, t.beds, t.equipment, t.departments_partial, scale=100.0)
