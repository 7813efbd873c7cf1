"""E: exploratory analysis."""

from pyspark.sql import functions as F

from wardlens.operators import explore as op
from wardlens.plans.quality import COLUMNS, TABLES, all_tables
from wardlens.plans.registry import query, r2


@query("table_shapes", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS row_count, {len(COLUMNS[n])} AS column_count, '{','.join(COLUMNS[n])}' AS column_names FROM {n}"
    for n in TABLES))
def _(t):
    return op.table_shapes(all_tables(t))


def describe_sql(source, columns, extra=""):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT({c}) AS count, ROUND(AVG({c}), 6) AS mean, ROUND(stddev_samp({c}), 6) AS std,
            CAST(MIN({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,
            quantile_cont({c}, 0.75) AS p75, CAST(MAX({c}) AS DOUBLE) AS max {extra} FROM {source}"""
        for c in columns
    )


def rounded(frame):
    return frame.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("describe_numeric", describe_sql("admissions", ["age", "length_of_stay"]))
def _(t):
    return rounded(op.describe_numeric(t.admissions, ["age", "length_of_stay"]))


@query("describe_equipment", describe_sql("equipment", ["usage_hours", "maintenance_count", "failure_count"]))
def _(t):
    return rounded(op.describe_numeric(t.equipment, ["usage_hours", "maintenance_count", "failure_count"]))


CATEGORIES = ["admission_type", "gender", "bed_type", "discharge_status"]


def counts_sql(table, columns, where="WHERE {c} IS NOT NULL"):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value, COUNT(*) AS n FROM {table} {where.format(c=c)} GROUP BY {c}" for c in columns
    )


@query("value_counts", counts_sql("admissions", CATEGORIES) + " UNION ALL " + counts_sql("appointments", ["appointment_type", "appointment_status"])
       + " UNION ALL " + counts_sql("equipment", ["equipment_status"]))
def _(t):
    return (
        op.value_counts_many(t.admissions, CATEGORIES)
        .unionAll(op.value_counts_many(t.appointments, ["appointment_type", "appointment_status"]))
        .unionAll(op.value_counts(t.equipment, "equipment_status"))
    )


@query("value_counts_with_nulls", counts_sql("admissions", CATEGORIES[1:], ""))
def _(t):
    return op.value_counts_many(t.admissions, CATEGORIES[1:], keep_null=True)


@query("department_admissions_named", f"""SELECT a.department_id, d.department_name, d.department_type, COUNT(a.admission_id) AS total_admissions,
    {r2('AVG(a.length_of_stay)')} AS average_length_of_stay FROM admissions a LEFT JOIN departments_partial d ON a.department_id = d.department_id
    GROUP BY ALL""")
def _(t):
    return op.department_admissions_named(t.admissions, t.departments_partial)


@query("monthly_admissions_period", "SELECT strftime(admission_date, '%Y-%m') AS admission_date, COUNT(*) AS total_admissions FROM admissions GROUP BY 1")
def _(t):
    return op.monthly_admissions_period(t.admissions)


@query("status_percentages", f"""SELECT appointment_status, COUNT(*) AS n, {r2('COUNT(*) / CAST((SELECT COUNT(*) FROM appointments) AS DOUBLE) * 100')} AS percentage,
    {r2('COUNT(*) / CAST((SELECT COUNT(appointment_status) FROM appointments) AS DOUBLE) * 100')} AS percentage_of_known
    FROM appointments WHERE appointment_status IS NOT NULL GROUP BY appointment_status""")
def _(t):
    return op.status_percentages(t.appointments, "appointment_status")


@query("department_wait", f"""SELECT a.department_id, d.department_name, COUNT(a.appointment_id) AS total_appointments,
    {r2('AVG(a.wait_time_days)')} AS average_wait_time FROM appointments a LEFT JOIN departments_partial d ON a.department_id = d.department_id GROUP BY ALL""")
def _(t):
    return op.department_wait(t.appointments, t.departments_partial)


@query("department_no_show", f"""SELECT a.department_id, d.department_name, COUNT(a.appointment_id) AS total_appointments,
    COUNT(*) FILTER (WHERE appointment_status = 'No-Show') AS no_show_count,
    {r2("COUNT(*) FILTER (WHERE appointment_status = 'No-Show') / CAST(COUNT(a.appointment_id) AS DOUBLE) * 100")} AS no_show_rate
    FROM appointments a LEFT JOIN departments_partial d ON a.department_id = d.department_id GROUP BY ALL""")
def _(t):
    return op.department_no_show(t.appointments, t.departments_partial)


@query("department_occupancy", f"""SELECT a.department_id, d.department_name, {r2('AVG(occupancy_rate)')} AS average_occupancy_rate,
    {r2('AVG(occupied_beds)')} AS average_occupied_beds, {r2('AVG(available_beds)')} AS average_available_beds
    FROM beds a LEFT JOIN departments_partial d ON a.department_id = d.department_id GROUP BY ALL""")
def _(t):
    return op.department_occupancy(t.beds, t.departments_partial)


@query("occupancy_scale_check", "SELECT MIN(occupancy_rate) AS minimum, MAX(occupancy_rate) AS maximum, CASE WHEN MAX(occupancy_rate) <= 1 THEN 'fraction' ELSE 'percent' END AS scale FROM beds")
def _(t):
    return op.occupancy_scale_check(t.beds)


@query("monthly_occupancy_period", f"SELECT strftime(record_date, '%Y-%m') AS record_date, {r2('AVG(occupancy_rate)')} AS average_occupancy_rate FROM beds GROUP BY 1")
def _(t):
    return op.monthly_occupancy_period(t.beds)


@query("equipment_type_analysis", f"""SELECT equipment_type, COUNT(equipment_id) AS total_equipment, CAST(SUM(failure_count) AS BIGINT) AS total_failures,
    CAST(SUM(maintenance_count) AS BIGINT) AS total_maintenance, {r2('AVG(usage_hours)')} AS average_usage_hours,
    {r2('SUM(failure_count) / CAST(COUNT(equipment_id) AS DOUBLE)')} AS failure_rate FROM equipment GROUP BY equipment_type""")
def _(t):
    return op.equipment_type_analysis(t.equipment)


for _name, _x in (("usage_vs_failures", "usage_hours"), ("maintenance_vs_failures", "maintenance_count")):

    @query(_name, f"SELECT equipment_type, {r2(f'AVG({_x})')} AS average_{_x}, {r2('AVG(failure_count)')} AS average_failure_count FROM equipment GROUP BY 1")
    def _(t, x=_x):
        return op.paired_means(t.equipment, x, "failure_count")

    @query(f"{_name}_correlation", f"SELECT '{_x}' AS x, 'failure_count' AS y, ROUND(corr({_x}, failure_count), 6) AS correlation FROM equipment")
    def _(t, x=_x):
        return op.correlation(t.equipment, x, "failure_count")


@query("department_activity", """WITH a AS (SELECT department_id, COUNT(admission_id) AS total_admissions FROM admissions GROUP BY 1),
    b AS (SELECT department_id + 2 AS department_id, COUNT(appointment_id) AS total_appointments FROM appointments GROUP BY 1)
    SELECT department_id, department_name, total_admissions, total_appointments FROM a FULL JOIN b USING (department_id) LEFT JOIN departments USING (department_id)""")
def _(t):
    # Appointment departments are shifted by two, so both outer halves are exercised.
    shifted = t.appointments.withColumn("department_id", F.col("department_id") + 2)
    return op.department_activity(t.admissions, shifted, t.departments)


@query("integer_distribution", "SELECT 'failure_count' AS column_name, failure_count AS value, COUNT(*) AS n FROM equipment GROUP BY 2 UNION ALL SELECT 'length_of_stay', length_of_stay, COUNT(*) FROM admissions GROUP BY 2")
def _(t):
    return op.integer_distribution(t.equipment, "failure_count").unionAll(op.integer_distribution(t.admissions, "length_of_stay"))


@query("daily_bed_demand", "WITH daily AS (SELECT record_date, SUM(occupied_beds) AS total_occupied_beds, SUM(available_beds) AS total_available_beds FROM beds GROUP BY 1) "
       + describe_sql("daily", ["total_occupied_beds", "total_available_beds"], ", MIN(record_date) AS first_day, MAX(record_date) AS last_day, COUNT(record_date) AS days"))
def _(t):
    return rounded(op.daily_bed_demand_summary(t.beds))
