"""K: adaptive KPIs."""

from pyspark.sql import functions as F

from wardlens.functions.roles import roles_of
from wardlens.operators import kpis as op
from wardlens.plans.registry import query, r2


def kpi_sql(pairs, source):
    return f"SELECT kpi, value FROM (SELECT unnest([{', '.join(repr(k) for k in pairs)}]) AS kpi, unnest([{', '.join(f'CAST({v} AS DOUBLE)' for v in pairs.values())}]) AS value FROM {source}) WHERE value IS NOT NULL"


ADMISSION = {"Total Admissions": "COUNT(admission_id)", "Average Length of Stay": r2("AVG(length_of_stay)"),
             "Peak Length of Stay": "MAX(length_of_stay)", "Unique Patients": "COUNT(DISTINCT patient_id)"}


@query("admission_kpis", kpi_sql(ADMISSION, "admissions"))
def _(t):
    return op.admission_kpis(t.admissions)


MISSED = "SUM(CASE WHEN appointment_status = 'No-Show' THEN {w} ELSE 0 END)"
DONE = "SUM(CASE WHEN appointment_status = 'Completed' THEN {w} ELSE 0 END)"


def appointment_sql(total, weight):
    missed, done = MISSED.format(w=weight), DONE.format(w=weight)
    rate = f"ROUND(CAST({missed} / CAST(SUM({weight}) AS DOUBLE) * 100 AS DECIMAL(38, 12)), 1)"
    return {"Total Appointments": total, "Completed Appointments": done, "No-Shows": missed, "No-Show Rate": rate}


@query("appointment_kpis", kpi_sql(appointment_sql("COUNT(appointment_id)", "1"), "appointments"))
def _(t):
    return op.appointment_kpis(t.appointments)


@query("appointment_kpis_weighted", "WITH daily AS (SELECT appointment_date, appointment_status, COUNT(*) AS number_of_appointments FROM appointments GROUP BY 1, 2) "
       + kpi_sql(appointment_sql("SUM(number_of_appointments)", "number_of_appointments"), "daily"))
def _(t):
    # A pre-counted upload: one row per day and status, with a count column in text form.
    daily = t.appointments.groupBy("appointment_date", "appointment_status").agg(F.count(F.lit(1)).cast("string").alias("number_of_appointments"))
    return op.appointment_kpis(daily)


@query("average_wait", kpi_sql({"Average Wait (days)": r2("AVG(wait_time_days)")}, "appointments"))
def _(t):
    return op.average_wait(t.appointments)


DAYS = "WITH days AS (SELECT record_date, SUM(occupied_beds) AS occupied, SUM(total_beds) AS total, SUM(available_beds) AS available FROM beds GROUP BY 1) "
BED = {"Average Bed Capacity": r2("AVG(total)"), "Average Occupied Beds": r2("AVG(occupied)"),
       "Average Available Beds": r2("AVG(available)"), "Peak Occupied Beds": "MAX(occupied)"}
OCCUPANCY = r2("AVG(CASE WHEN total > 0 THEN occupied / CAST(total AS DOUBLE) * 100 END)")


@query("bed_kpis", DAYS + kpi_sql(BED, "days"))
def _(t):
    return op.bed_kpis(t.beds)


@query("bed_kpis_undated", kpi_sql({"Average Bed Capacity": r2("AVG(total_beds)"), "Average Occupied Beds": r2("AVG(occupied_beds)"),
       "Average Available Beds": r2("AVG(available_beds)"), "Peak Occupied Beds": "MAX(occupied_beds)"}, "beds"))
def _(t):
    return op.bed_kpis(t.beds.drop("record_date"))


@query("bed_available_derived", DAYS + kpi_sql({"Average Available Beds (derived)": r2("AVG(total - occupied)")}, "days"))
def _(t):
    return op.bed_available_derived(t.beds.drop("available_beds"))


@query("bed_occupancy", DAYS + kpi_sql({"Average Occupancy": OCCUPANCY}, "days"))
def _(t):
    return op.bed_occupancy(t.beds)


@query("bed_occupancy_derived", DAYS + kpi_sql({"Average Occupancy (derived)": OCCUPANCY}, "days"))
def _(t):
    return op.bed_occupancy(t.beds.drop("occupancy_rate"))


@query("bed_occupancy_fraction", kpi_sql({"Average Occupancy": r2("AVG(LEAST(occupancy_rate / 100, 1)) * 100")}, "beds"))
def _(t):
    # A stored fraction and no date: the rate is scaled because its maximum is one.
    fractions = t.beds.select("department_id", F.least(F.col("occupancy_rate") / 100, F.lit(1.0)).alias("occupancy_rate"))
    return op.bed_occupancy(fractions)


EQUIPMENT = {"Equipment Records": "COUNT(DISTINCT equipment_id)", "Recorded Equipment Failures": "SUM(failure_count)",
             "Operational Equipment": "COUNT(*) FILTER (WHERE regexp_matches(lower(equipment_status), 'operational|active|working'))"}


@query("equipment_kpis", kpi_sql(EQUIPMENT, "equipment"))
def _(t):
    return op.equipment_kpis(t.equipment)


@query("equipment_kpis_events", kpi_sql({"Equipment Records": "COUNT(*)", "Recorded Equipment Failures": "COUNT(*) FILTER (WHERE failure_count > 0)"}, "equipment"))
def _(t):
    # Failures as dated events: no count column, no id.
    events = t.equipment.select("equipment_type", F.when(F.col("failure_count") > 0, F.col("next_maintenance_date").cast("string")).alias("d"), "failure_count")
    dated = events.select("equipment_type", F.when(F.col("failure_count") > 0, F.coalesce("d", F.lit("undated"))).alias("failure_date"))
    return op.equipment_kpis(dated)


@query("department_count", kpi_sql({"Departments": "COUNT(DISTINCT department_id)"}, "admissions"))
def _(t):
    return op.department_count(t.admissions)


@query("record_count", kpi_sql({"Records": "COUNT(*)"}, "events"))
def _(t):
    return op.adaptive_kpis(t.events)


@query("adaptive_kpis", DAYS + kpi_sql(BED, "days") + " UNION ALL " + kpi_sql({"Average Occupancy": OCCUPANCY}, "days")
       + " UNION ALL " + kpi_sql({"Departments": "COUNT(DISTINCT department_id)"}, "beds"))
def _(t):
    return op.adaptive_kpis(t.beds)


@query("bed_summary", DAYS.rstrip() + f""", top AS (SELECT CAST(department_id AS VARCHAR) AS label, {r2('AVG(occupied_beds)')} AS value FROM beds GROUP BY 1
    ORDER BY AVG(occupied_beds) DESC, 1 LIMIT 20), one AS (SELECT {BED['Average Bed Capacity']} AS total_beds, {BED['Average Occupied Beds']} AS occupied_beds,
    {BED['Average Available Beds']} AS available_beds, {OCCUPANCY} AS average_occupancy, CAST(MAX(occupied) AS DOUBLE) AS peak_occupied_beds FROM days)
    SELECT one.*, label AS department, value AS department_occupied_beds FROM one, top""")
def _(t):
    record = op.bed_summary(t.beds, roles_of(t.beds.columns))
    return record.withColumn("d", F.explode("department_occupancy")).select(
        "total_beds", "occupied_beds", "available_beds", "average_occupancy", "peak_occupied_beds",
        F.col("d.label").alias("department"), F.col("d.value").alias("department_occupied_beds"))
