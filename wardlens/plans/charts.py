"""G: group tables, charts and insights."""

from pyspark.sql import functions as F

from wardlens.functions.roles import roles_of
from wardlens.operators import charts as op
from wardlens.operators import kpis
from wardlens.plans.kpis import DAYS, OCCUPANCY
from wardlens.plans.registry import query, r2


def top_sql(title, table, dimension, value="CAST(COUNT(*) AS DOUBLE)", top=20):
    """Largest groups of one dimension; ``raw`` orders, ``value`` is shown."""
    label = f"COALESCE(CAST({dimension} AS VARCHAR), 'Unknown')"
    return f"SELECT '{title}' AS title, label, {r2('raw')} AS value FROM (SELECT {label} AS label, {value} AS raw FROM {table} GROUP BY 1 ORDER BY raw DESC NULLS LAST, label LIMIT {top})"


def union(*parts):
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


SERVICE = {"service": "appointment_type"}


def appointment_roles(t):
    return {**roles_of(t.appointments.columns), **SERVICE}


@query("group_table", top_sql("Stay by bed type", "admissions", "bed_type", "SUM(length_of_stay)"))
def _(t):
    return op.group_table(t.admissions, "bed_type", "length_of_stay", "sum", "Stay by bed type")


@query("admissions_by_type", top_sql("Admissions by Type", "admissions", "admission_type"))
def _(t):
    return op.group_tables(t.admissions).where("title = 'Admissions by Type'")


@query("admissions_by_dept_table", top_sql("Admissions by Department", "admissions", "department_id", "COUNT(admission_id)"))
def _(t):
    return op.group_tables(t.admissions).where("title = 'Admissions by Department'")


for _name, _title, _dimension in (
    ("appointment_status_table", "Appointment Status", "appointment_status"),
    ("appointments_by_dept_table", "Appointments by Department", "department_id"),
    ("appointments_by_service", "Appointments by Service", "appointment_type"),
):

    @query(_name, top_sql(_title, "appointments", _dimension))
    def _(t, title=_title):
        return op.group_tables(t.appointments, appointment_roles(t)).where(F.col("title") == title)


@query("mean_occupied_by_dept", top_sql("Average Occupied Beds by Department", "beds", "department_id", "AVG(occupied_beds)"))
def _(t):
    return op.group_tables(t.beds)


@query("equipment_status_table", top_sql("Equipment Status", "equipment", "equipment_status"))
def _(t):
    return op.group_tables(t.equipment).where("title = 'Equipment Status'")


@query("equipment_by_type", top_sql("Equipment by Type", "equipment", "equipment_type"))
def _(t):
    return op.group_tables(t.equipment).where("title = 'Equipment by Type'")


@query("department_workload", union(
    top_sql("Department Workload", "equipment", "department_id"), top_sql("Department records", "equipment", "department_id", top=12)))
def _(t):
    # Equipment status and type tables do not name a department, so the workload table is added.
    table = op.group_tables(t.equipment).where("title = 'Department Workload'")
    return table.unionByName(op.department_workload(t.equipment).select("title", "label", "value"))


CHART = "chart_id, title, type, dimension, metric, unit, ord, label, value"


def chart_sql(title, table, dimension, kind, metric, unit, value="CAST(COUNT(*) AS DOUBLE)", where="", number=None):
    label = f"COALESCE(CAST({dimension} AS VARCHAR), 'Unknown')"
    unit = "CAST(NULL AS VARCHAR)" if unit is None else f"'{unit}'"
    first = "" if number is None else f"{number} AS chart_no, "
    return f"""SELECT {first}'{title.lower().replace(' ', '-')}' AS chart_id, '{title}' AS title, {kind} AS type, '{dimension}' AS dimension, '{metric}' AS metric,
        {unit} AS unit, ROW_NUMBER() OVER (ORDER BY value DESC, label) AS ord, label, value FROM (SELECT label, {r2('raw')} AS value FROM
        (SELECT {label} AS label, {value} AS raw FROM {table} {where} GROUP BY 1) WHERE raw IS NOT NULL ORDER BY raw DESC, label LIMIT 12)"""


@query("group_chart", chart_sql("Bed Type breakdown", "admissions", "bed_type", "'bar'", "length_of_stay", None, "SUM(length_of_stay)"))
def _(t):
    return op.group_chart(t.admissions, "bed_type", "length_of_stay", "sum")


ADMISSION_CHARTS = [
    ("Admissions by Department", "admissions", "department_id", "'bar'", "admissions", "admissions"),
    ("Admission type distribution", "admissions", "admission_type", "'donut'", "records", "admissions"),
]


@query("admission_charts", union(*[chart_sql(*c) for c in ADMISSION_CHARTS]))
def _(t):
    return op.module_charts(t.admissions, "Admission Analytics")


APPOINTMENT_CHARTS = [
    ("Appointment status", "appointments", "appointment_status", "'donut'", "records", "appointments"),
    ("Appointments by Department", "appointments", "department_id", "'bar'", "appointments", "appointments"),
    ("Appointments by Service", "appointments", "appointment_type",
     "CASE WHEN (SELECT COUNT(DISTINCT appointment_type) FROM appointments) <= 8 THEN 'donut' ELSE 'bar' END", "appointments", "appointments"),
]


@query("appointment_charts", union(*[chart_sql(*c) for c in APPOINTMENT_CHARTS]))
def _(t):
    return op.module_charts(t.appointments, "Appointment Analytics", appointment_roles(t))


BED_CHART = ("Average occupied beds by Department", "beds", "department_id", "'bar'", "occupied_beds", "beds", "AVG(occupied_beds)")


@query("bed_chart", chart_sql(*BED_CHART))
def _(t):
    return op.module_charts(t.beds, "Bed & Capacity Analytics")


EQUIPMENT_CHARTS = [
    ("Equipment status", "equipment", "equipment_status", "'donut'", "records", "equipment"),
    ("Recorded failures by equipment type", "equipment", "equipment_type", "'bar'", "failure_count", "failures", "SUM(failure_count)"),
]


@query("equipment_charts", union(*[chart_sql(*c) for c in EQUIPMENT_CHARTS]))
def _(t):
    return op.module_charts(t.equipment, "Equipment Analytics")


def time_sql(metric, table, date, grain, value="CAST(COUNT(*) AS DOUBLE)", where="", number=None):
    title = f"{metric.replace('_', ' ').title()} over time"
    dimension = {"month": "month", "week": "week", "day": "date"}[grain]
    first = "" if number is None else f"{number} AS chart_no, "
    return f"""SELECT {first}'{title.lower().replace(' ', '-')}' AS chart_id, '{title}' AS title, 'line' AS type, '{dimension}' AS dimension, '{metric}' AS metric,
        CAST(NULL AS VARCHAR) AS unit, ROW_NUMBER() OVER (ORDER BY period) AS ord, strftime(period, '%Y-%m-%d') AS label, value FROM
        (SELECT CAST(date_trunc('{grain}', {date}) AS DATE) AS period, {r2(value)} AS value FROM {table} {where} GROUP BY 1 ORDER BY 1 DESC LIMIT 120)"""


@query("time_chart", time_sql("admissions", "admissions", "admission_date", "month"))
def _(t):
    return op.module_time_chart(t.admissions, "Admission Analytics", roles_of(t.admissions.columns))


@query("time_chart_week", "WITH folded AS (SELECT DATE '1997-01-03' + CAST((record_date - DATE '1995-01-01') % 60 AS INT) AS record_date, occupied_beds FROM beds) "
       + time_sql("occupied_beds", "folded", "record_date", "week", "SUM(occupied_beds)"))
def _(t):
    # All records folded into sixty days: the grain becomes the week.
    day = F.expr("date_add(DATE'1997-01-03', CAST(datediff(record_date, DATE'1995-01-01') % 60 AS INT))")
    two_months = t.beds.withColumn("record_date", day)
    return op.module_time_chart(two_months, "Bed & Capacity Analytics", roles_of(two_months.columns))


@query("time_chart_day", time_sql("records", "events", "ts", "day", "AVG(value)"))
def _(t):
    return op.time_chart(t.events, "ts", "value", "mean")


@query("time_chart_rate", time_sql("occupancy_rate", "beds", "record_date", "month", "AVG(occupancy_rate)"))
def _(t):
    rates = t.beds.select("record_date", "department_id", "occupancy_rate")
    return op.module_time_chart(rates, "Bed & Capacity Analytics", roles_of(rates.columns))


DAILY = "WITH daily AS (SELECT event_type, CAST(ts AS DATE) AS day, COUNT(*) AS value FROM events GROUP BY 1, 2) "


@query("trailing_range_filter", DAILY + "SELECT event_type, day, value FROM daily WHERE day >= (SELECT MAX(day) FROM daily) - 14")
def _(t):
    daily = t.events.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("value"))
    return op.trailing_range_filter(daily, "day", 14)


BALANCE = "WITH g AS (SELECT c_mktsegment, SUM(CASE WHEN c_mktsegment = 'BUILDING' THEN -c_custkey ELSE c_custkey END) AS v FROM customer GROUP BY 1) "


@query("category_share", BALANCE + """, c AS (SELECT c_mktsegment, GREATEST(CAST(v AS DOUBLE), 0e0) AS value FROM g)
    SELECT c_mktsegment, value, (SELECT SUM(value) FROM c) AS total, ROUND(value / (SELECT SUM(value) FROM c), 6) AS share FROM c""")
def _(t):
    groups = t.customer.groupBy("c_mktsegment").agg(F.sum(F.expr("CASE WHEN c_mktsegment = 'BUILDING' THEN -c_custkey ELSE c_custkey END")).alias("v"))
    return op.category_share(groups, "c_mktsegment", "v")


def dashboard_sql(table):
    lists = {
        "appointments": [time_sql("appointments", "appointments", "appointment_date", "month", number=0)]
        + [chart_sql(*c, number=i + 1) for i, c in enumerate(APPOINTMENT_CHARTS)],
        "beds": [time_sql("occupied_beds", "beds", "record_date", "month", "SUM(occupied_beds)", number=0), chart_sql(*BED_CHART, number=1)],
        "equipment": [time_sql("failures", "equipment", "installation_date", "month", "SUM(failure_count)", number=0)]
        + [chart_sql(*c, number=i + 1) for i, c in enumerate(EQUIPMENT_CHARTS)]
        + [chart_sql("Department records", "equipment", "department_id", "'bar'", "records", "records", number=3)],
    }
    return union(*lists[table])


@query("dashboard_charts", dashboard_sql("appointments"))
def _(t):
    return op.dashboard_charts(t.appointments, appointment_roles(t))


@query("dashboard_charts_equipment", dashboard_sql("equipment"))
def _(t):
    return op.dashboard_charts(t.equipment)


@query("dashboard_charts_fallback", """SELECT 0 AS chart_no, 'category-distribution' AS chart_id, 'Category distribution' AS title, 'bar' AS type, 'event_type' AS dimension, 'records' AS metric,
    'records' AS unit, ROW_NUMBER() OVER (ORDER BY n DESC, event_type) AS ord, event_type AS label, CAST(n AS DOUBLE) AS value FROM (SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1) QUALIFY ord <= 12""")
def _(t):
    return op.dashboard_charts(t.events)


@query("group_tables_unknown", "SELECT '' AS title, event_type AS label, 0.0::DOUBLE AS value FROM events WHERE FALSE")
def _(t):
    return op.group_tables(t.events)


TREND = """SELECT chart_no, title, arg_min(value, ord) AS first_value, arg_max(value, ord) AS last_value,
    CASE WHEN arg_max(value, ord) > arg_min(value, ord) THEN 'increased' WHEN arg_max(value, ord) < arg_min(value, ord) THEN 'decreased' ELSE 'was unchanged' END AS direction
    FROM charts WHERE type = 'line' GROUP BY 1, 2 HAVING COUNT(*) >= 2"""
TOP = """SELECT chart_no, title, metric, arg_min(label, ord) AS label, arg_min(value, ord) AS value FROM charts
    WHERE type <> 'line' AND dimension = 'department_id' GROUP BY 1, 2, 3"""
MISSED = "SELECT chart_no, title, label, value FROM charts WHERE title = 'Appointment status' AND label = 'No-Show' AND value > 0"


@query("trend_insight", f"WITH charts AS ({dashboard_sql('appointments')}) {TREND}")
def _(t):
    return op.trend_insight(op.dashboard_charts(t.appointments, appointment_roles(t)))


@query("top_department_insight", f"WITH charts AS ({dashboard_sql('appointments')}) {TOP}")
def _(t):
    return op.top_department_insight(op.dashboard_charts(t.appointments, appointment_roles(t)))


@query("missed_appointment_insight", f"WITH charts AS ({dashboard_sql('appointments')}) {MISSED}")
def _(t):
    return op.missed_appointment_insight(op.dashboard_charts(t.appointments, appointment_roles(t)))


@query("occupancy_insight", DAYS + f"SELECT 'Average Occupancy' AS kpi, {OCCUPANCY} AS value FROM days")
def _(t):
    return op.kpi_insight(kpis.adaptive_kpis(t.beds), "occupancy")


@query("failure_insight", "SELECT 'Recorded Equipment Failures' AS kpi, CAST(SUM(failure_count) AS DOUBLE) AS value FROM equipment HAVING SUM(failure_count) > 0")
def _(t):
    return op.kpi_insight(kpis.adaptive_kpis(t.equipment), "failure", positive=True)


FEED = f"""trends AS ({TREND}), tops AS ({TOP}), missed AS ({MISSED}), feed AS (
    SELECT chart_no AS ord, 'Observed trend' AS insight, title AS source, NULL AS label, last_value AS value, direction AS detail FROM trends
    UNION ALL SELECT chart_no, 'Highest department workload', title, label, value, metric FROM tops
    UNION ALL SELECT chart_no, 'Missed appointments recorded', title, label, value, NULL FROM missed"""


@query("insight_feed", f"WITH charts AS ({dashboard_sql('appointments')}), {FEED}) SELECT * FROM feed ORDER BY ord LIMIT 6")
def _(t):
    charts = op.dashboard_charts(t.appointments, appointment_roles(t))
    return op.insight_feed(charts, kpis.adaptive_kpis(t.appointments), ["Appointment Analytics", "Department Analytics"])


@query("insight_feed_beds", DAYS.rstrip() + f""", charts AS ({dashboard_sql('beds')}), {FEED}
    UNION ALL SELECT 1000, 'Bed utilization', 'Average Occupancy', NULL, {OCCUPANCY}, NULL FROM days) SELECT * FROM feed ORDER BY ord LIMIT 6""")
def _(t):
    return op.insight_feed(op.dashboard_charts(t.beds), kpis.adaptive_kpis(t.beds), ["Bed & Capacity Analytics", "Department Analytics"])
