"""Q: fixed reports and their reference SQL."""

from wardlens.operators import reports as op
from wardlens.plans.registry import query, r2
from wardlens.sources.fixtures import AS_OF

JOINED = "FROM {0} a JOIN departments d ON a.department_id = d.department_id GROUP BY d.department_name"


@query("admissions_by_department", f"SELECT d.department_name, COUNT(a.admission_id) AS total_admissions {JOINED.format('admissions')}")
def _(t):
    return op.admissions_by_department(t.admissions, t.departments)


@query("avg_los_by_department", f"SELECT d.department_name, {r2('AVG(a.length_of_stay)')} AS average_length_of_stay {JOINED.format('admissions')}")
def _(t):
    return op.avg_los_by_department(t.admissions, t.departments)


@query("monthly_admissions", """SELECT strftime(admission_date, '%Y-%m') AS admission_month, COUNT(admission_id) AS total_admissions
    FROM admissions GROUP BY 1""")
def _(t):
    return op.monthly_admissions(t.admissions)


@query("appointment_status_summary", f"""SELECT appointment_status, COUNT(appointment_id) AS total_appointments,
    {r2('COUNT(appointment_id) * 100.0e0 / (SELECT COUNT(*) FROM appointments)')} AS percentage FROM appointments GROUP BY appointment_status""")
def _(t):
    return op.status_summary(t.appointments, "appointment_status", "appointment_id", "total_appointments")


@query("wait_time_by_department", f"""SELECT d.department_name, COUNT(a.appointment_id) AS total_appointments,
    {r2('AVG(a.wait_time_days)')} AS average_wait_time {JOINED.format('appointments')}""")
def _(t):
    return op.wait_time_by_department(t.appointments, t.departments)


@query("no_show_rate_by_department", f"""SELECT d.department_name, COUNT(a.appointment_id) AS total_appointments,
    CAST(SUM(CASE WHEN a.appointment_status = 'No-Show' THEN 1 ELSE 0 END) AS BIGINT) AS no_show_count,
    {r2("SUM(CASE WHEN a.appointment_status = 'No-Show' THEN 1 ELSE 0 END) * 100.0e0 / COUNT(a.appointment_id)")} AS no_show_rate
    {JOINED.format('appointments')}""")
def _(t):
    return op.no_show_rate_by_department(t.appointments, t.departments)


@query("occupancy_by_department", f"SELECT d.department_name, {r2('AVG(a.occupancy_rate)')} AS average_occupancy_rate {JOINED.format('beds')}")
def _(t):
    return op.occupancy_by_department(t.beds, t.departments)


@query("bed_usage_by_department", f"""SELECT d.department_name, {r2('AVG(a.occupied_beds)')} AS average_occupied_beds,
    {r2('AVG(a.available_beds)')} AS average_available_beds {JOINED.format('beds')}""")
def _(t):
    return op.bed_usage_by_department(t.beds, t.departments)


@query("monthly_occupancy", f"""SELECT strftime(record_date, '%Y-%m') AS record_month, {r2('AVG(occupancy_rate)')} AS average_occupancy_rate
    FROM beds GROUP BY 1""")
def _(t):
    return op.monthly_occupancy(t.beds)


@query("equipment_status_summary", f"""SELECT equipment_status, COUNT(equipment_id) AS total_equipment,
    {r2('COUNT(equipment_id) * 100.0e0 / (SELECT COUNT(*) FROM equipment)')} AS percentage FROM equipment GROUP BY equipment_status""")
def _(t):
    return op.status_summary(t.equipment, "equipment_status", "equipment_id", "total_equipment")


@query("failures_by_equipment_type", """SELECT equipment_type, COUNT(equipment_id) AS total_equipment,
    CAST(SUM(failure_count) AS BIGINT) AS total_failures, CAST(SUM(maintenance_count) AS BIGINT) AS total_maintenance
    FROM equipment GROUP BY equipment_type""")
def _(t):
    return op.failures_by_equipment_type(t.equipment)


@query("equipment_by_department", f"""SELECT d.department_name, COUNT(a.equipment_id) AS total_equipment,
    {r2('AVG(a.usage_hours)')} AS average_usage_hours, CAST(SUM(a.failure_count) AS BIGINT) AS total_failures {JOINED.format('equipment')}""")
def _(t):
    return op.equipment_by_department(t.equipment, t.departments)


@query("department_admission_rank", """WITH totals AS (SELECT department_id, COUNT(admission_id) AS total_admissions FROM admissions GROUP BY department_id)
    SELECT d.department_name, total_admissions, RANK() OVER (ORDER BY total_admissions DESC) AS admission_rank
    FROM totals JOIN departments d ON totals.department_id = d.department_id""")
def _(t):
    return op.department_admission_rank(t.admissions, t.departments)


@query("monthly_admission_change", """WITH monthly AS (SELECT strftime(admission_date, '%Y-%m') AS admission_month,
    COUNT(admission_id) AS total_admissions FROM admissions GROUP BY 1)
    SELECT admission_month, total_admissions, LAG(total_admissions) OVER (ORDER BY admission_month) AS previous_month_admissions,
    total_admissions - LAG(total_admissions) OVER (ORDER BY admission_month) AS change_from_previous_month FROM monthly""")
def _(t):
    return op.monthly_admission_change(t.admissions)


@query("above_average_los_departments", f"""WITH los AS (SELECT department_id, AVG(length_of_stay) AS mean FROM admissions GROUP BY department_id),
    hospital AS (SELECT AVG(length_of_stay) AS hospital_mean FROM admissions)
    SELECT d.department_name, {r2('mean')} AS average_length_of_stay, {r2('hospital_mean')} AS hospital_average_los
    FROM los JOIN departments d ON los.department_id = d.department_id CROSS JOIN hospital WHERE mean > hospital_mean""")
def _(t):
    return op.above_average_los_departments(t.admissions, t.departments)


FIVE = ("departments", "admissions", "appointments", "beds", "equipment")


@query("table_row_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS total_rows FROM {n}" for n in FIVE))
def _(t):
    return op.table_row_counts({name: getattr(t, name) for name in FIVE})


for _table in FIVE[1:]:
    _alias = {"admissions": "invalid_admission_departments", "appointments": "invalid_appointment_departments",
              "beds": "invalid_bed_departments", "equipment": "invalid_equipment_departments"}[_table]

    @query(f"orphan_{_table}", f"""SELECT COUNT(*) AS {_alias} FROM {_table} a
        LEFT JOIN departments_partial d ON a.department_id = d.department_id WHERE d.department_id IS NULL""")
    def _(t, table=_table, alias=_alias):
        return op.orphan_count(getattr(t, table), t.departments_partial, alias)


@query("hospital_avg_los", f"SELECT {r2('AVG(length_of_stay)')} AS average_length_of_stay FROM admissions")
def _(t):
    return op.hospital_avg_los(t.admissions)


@query("avg_los_for_department", f"""SELECT {r2('AVG(a.length_of_stay)')} AS average_length_of_stay FROM admissions a
    JOIN departments d ON a.department_id = d.department_id WHERE LOWER(d.department_name) = LOWER('Germany')""")
def _(t):
    return op.avg_los_for_department(t.admissions, t.departments, "Germany")


@query("cancelled_last_month", f"""SELECT COUNT(appointment_id) AS appointment_records,
    CAST(SUM(CASE WHEN LOWER(TRIM(appointment_status)) IN ('cancelled', 'canceled') THEN 1 ELSE 0 END) AS BIGINT) AS cancelled_appointments
    FROM appointments WHERE appointment_date >= date_trunc('month', DATE '{AS_OF}') - INTERVAL 1 MONTH
    AND appointment_date < date_trunc('month', DATE '{AS_OF}')""")
def _(t):
    return op.cancelled_last_month(t.appointments, AS_OF)


@query("occupied_beds_latest", """SELECT MAX(record_date) AS record_date, CAST(SUM(occupied_beds) AS BIGINT) AS occupied_beds
    FROM beds WHERE record_date = (SELECT MAX(record_date) FROM beds)""")
def _(t):
    return op.occupied_beds_latest(t.beds)


@query("operational_equipment_count", """SELECT COUNT(equipment_id) AS operational_equipment FROM equipment
    WHERE LOWER(TRIM(equipment_status)) IN ('operational', 'active', 'working', 'in service')""")
def _(t):
    return op.operational_equipment_count(t.equipment)


@query("busiest_department", """SELECT d.department_name, COUNT(a.admission_id) AS total_admissions FROM admissions a
    JOIN departments d ON a.department_id = d.department_id GROUP BY d.department_name ORDER BY 2 DESC, 1 LIMIT 1""")
def _(t):
    return op.busiest_department(t.admissions, t.departments)


@query("database_snapshot", f"""
    SELECT 'kpi' AS kind, 'kpi' AS series, 'Database admissions' AS label, CAST(COUNT(*) AS DOUBLE) AS value
      FROM admissions a JOIN departments d ON a.department_id = d.department_id
    UNION ALL SELECT 'kpi', 'kpi', 'Average length of stay', {r2('AVG(length_of_stay)')} FROM admissions
    UNION ALL SELECT 'chart', 'admissions_by_department', d.department_name, CAST(COUNT(*) AS DOUBLE) {JOINED.format('admissions')}
    UNION ALL SELECT 'chart', 'appointment_status', COALESCE(appointment_status, 'Unknown'), CAST(COUNT(*) AS DOUBLE) FROM appointments GROUP BY appointment_status
    UNION ALL SELECT 'chart', 'occupied_beds_by_department', d.department_name, {r2('AVG(a.occupied_beds)')} {JOINED.format('beds')}
    UNION ALL SELECT 'chart', 'equipment_status', COALESCE(equipment_status, 'Unknown'), CAST(COUNT(*) AS DOUBLE) FROM equipment GROUP BY equipment_status""")
def _(t):
    return op.database_snapshot(t.admissions, t.appointments, t.beds, t.equipment, t.departments)
