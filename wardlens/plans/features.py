"""F: features, splits and weights; the metric half of M."""

from pyspark.sql import functions as F

from wardlens.operators import features as op
from wardlens.operators import metrics
from wardlens.plans.registry import query
from wardlens.sources.fixtures import AS_OF


def series_sql(table, date):
    return f"""m AS (SELECT CAST(date_trunc('month', {date}) AS DATE) AS month_start, COUNT(*) AS n FROM {table} WHERE {date} IS NOT NULL GROUP BY 1),
    series AS (SELECT CAST(c.month_start AS DATE) AS month_start, COALESCE(m.n, 0) AS admissions FROM
      (SELECT unnest(generate_series((SELECT MIN(month_start) FROM m), (SELECT MAX(month_start) FROM m), INTERVAL 1 MONTH)) AS month_start) c
      LEFT JOIN m ON m.month_start = CAST(c.month_start AS DATE))"""


LAGS = """lags AS (SELECT month_start, ROW_NUMBER() OVER (ORDER BY month_start) - 1 AS time_index, year(month_start) AS year, month(month_start) AS month, admissions,
    LAG(admissions, 1) OVER (ORDER BY month_start) AS lag_1, LAG(admissions, 2) OVER (ORDER BY month_start) AS lag_2, LAG(admissions, 3) OVER (ORDER BY month_start) AS lag_3 FROM series)"""


@query("monthly_series", f"WITH {series_sql('admissions', 'admission_date')} SELECT * FROM series")
def _(t):
    return op.monthly_series(t.admissions, "admission_date")


@query("monthly_series_gaps", f"WITH {series_sql('equipment', 'installation_date')} SELECT * FROM series")
def _(t):
    return op.monthly_series(t.equipment, "installation_date")


@query("monthly_lag_features", f"WITH {series_sql('admissions', 'admission_date')}, {LAGS} SELECT * FROM lags WHERE lag_3 IS NOT NULL")
def _(t):
    return op.monthly_lag_features(op.monthly_series(t.admissions, "admission_date"))


@query("next_month_row", f"""WITH {series_sql('admissions', 'admission_date')}, {LAGS}, last AS (SELECT * FROM lags ORDER BY month_start DESC LIMIT 1)
    SELECT CAST(month_start + INTERVAL 1 MONTH AS DATE) AS month_start, time_index + 1 AS time_index, year(month_start + INTERVAL 1 MONTH) AS year,
    month(month_start + INTERVAL 1 MONTH) AS month, CAST(admissions AS DOUBLE) AS lag_1, CAST(lag_1 AS DOUBLE) AS lag_2, CAST(lag_2 AS DOUBLE) AS lag_3 FROM last""")
def _(t):
    return op.next_month_row(op.monthly_series(t.admissions, "admission_date"))


def daily_sql(keys=""):
    group, over = (f"{keys}, ", f"PARTITION BY {keys} ") if keys else ("", "")
    w = f"OVER ({over}ORDER BY record_date)"
    return f"""WITH d AS (SELECT {group}record_date, CAST(SUM(occupied_beds) AS BIGINT) AS occupied_beds FROM beds GROUP BY ALL),
    f AS (SELECT {group}record_date, ROW_NUMBER() {w} - 1 AS time_index, isodow(record_date) - 1 AS dayofweek, month(record_date) AS month, dayofyear(record_date) AS dayofyear,
    occupied_beds, LAG(occupied_beds, 1) {w} AS lag_1, LAG(occupied_beds, 7) {w} AS lag_7, LAG(occupied_beds, 30) {w} AS lag_30 FROM d)
    SELECT * FROM f WHERE lag_30 IS NOT NULL"""


@query("daily_lag_features", daily_sql())
def _(t):
    return op.daily_lag_features(t.beds)


@query("daily_lag_features_by_department", daily_sql("department_id"))
def _(t):
    return op.daily_lag_features(t.beds, ["department_id"])


def equipment_sql(reference, source="equipment"):
    return f"""SELECT equipment_id, department_id, equipment_type, {reference} - installation_date AS equipment_age_days,
    next_maintenance_date - {reference} AS days_until_next_maintenance, usage_hours, maintenance_count, CAST(failure_count > 0 AS INT) AS failure_risk FROM {source}"""


@query("equipment_features", equipment_sql("(SELECT MAX(installation_date) FROM equipment)"))
def _(t):
    return op.equipment_features(t.equipment)


@query("equipment_features_as_of", equipment_sql(f"DATE '{AS_OF}'"))
def _(t):
    return op.equipment_features(t.equipment, AS_OF)


GAPS = "gaps AS (SELECT * REPLACE (CASE WHEN equipment_id % 13 = 0 THEN NULL ELSE usage_hours END AS usage_hours, CASE WHEN equipment_id % 17 = 0 THEN NULL ELSE maintenance_count END AS maintenance_count) FROM equipment)"


def equipment_with_gaps(t):
    """Units whose meter or service log is unreadable."""
    return t.equipment.withColumns(
        {
            "usage_hours": F.when(F.col("equipment_id") % 13 != 0, F.col("usage_hours")),
            "maintenance_count": F.when(F.col("equipment_id") % 17 != 0, F.col("maintenance_count")),
        }
    )


@query("equipment_impute", f"""WITH {GAPS}, f AS ({equipment_sql('(SELECT MAX(installation_date) FROM gaps)', 'gaps')})
    SELECT equipment_id, COALESCE(CAST(department_id AS VARCHAR), 'Unknown') AS department_id, COALESCE(equipment_type, 'Unknown') AS equipment_type,
    COALESCE(CAST(equipment_age_days AS DOUBLE), (SELECT median(equipment_age_days) FROM f)) AS equipment_age_days,
    COALESCE(days_until_next_maintenance, 0) AS days_until_next_maintenance, COALESCE(usage_hours, (SELECT median(usage_hours) FROM f)) AS usage_hours,
    COALESCE(CAST(maintenance_count AS DOUBLE), (SELECT median(maintenance_count) FROM f)) AS maintenance_count, failure_risk FROM f""")
def _(t):
    return op.equipment_impute(op.equipment_features(equipment_with_gaps(t)))


NO_SHOW = """SELECT appointment_id, department_id, appointment_type, CASE WHEN lead <= -1 THEN NULL WHEN lead <= 2 THEN 'Very Short' WHEN lead <= 7 THEN 'Short'
    WHEN lead <= 14 THEN 'Medium' WHEN lead > 14 THEN 'Long' END AS booking_lead_group, wait_time_days, lead AS booking_lead_days,
    isodow(appointment_date) - 1 AS appointment_dayofweek, month(appointment_date) AS appointment_month, CAST(COALESCE(appointment_status = 'No-Show', FALSE) AS INT) AS no_show
    FROM (SELECT *, appointment_date - booking_date AS lead FROM appointments)"""


@query("no_show_features", NO_SHOW)
def _(t):
    return op.no_show_features(t.appointments)


LOS = """SELECT admission_id, department_id, admission_type, age, gender, bed_type, isodow(admission_date) - 1 AS admission_dayofweek,
    month(admission_date) AS admission_month, length_of_stay FROM admissions"""


@query("los_features", LOS)
def _(t):
    return op.los_features(t.admissions)


def mode_sql(source, column):
    return f"""SELECT '{column}' AS column_name, CAST(NULL AS DOUBLE) AS number, (SELECT CAST({column} AS VARCHAR) FROM {source} WHERE {column} IS NOT NULL
        GROUP BY {column} ORDER BY COUNT(*) DESC, CAST({column} AS VARCHAR) LIMIT 1) AS text"""


def median_sql(source, column):
    return f"SELECT '{column}' AS column_name, CAST(median({column}) AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS text FROM {source}"


@query("impute_encode", f"WITH f AS ({LOS}) " + " UNION ALL ".join(
    [median_sql("f", c) for c in ("age", "admission_dayofweek", "admission_month")] + [mode_sql("f", c) for c in ("department_id", "admission_type", "gender", "bed_type")]))
def _(t):
    return op.imputation_values(op.los_features(t.admissions), ["age", "admission_dayofweek", "admission_month"], ["department_id", "admission_type", "gender", "bed_type"])


def split_sql(source, key, label):
    return f"""SELECT {key}, {label}, ROW_NUMBER() OVER (PARTITION BY {label} ORDER BY md5('42-' || CAST({key} AS VARCHAR))) <=
        floor(0.8e0 * COUNT(*) OVER (PARTITION BY {label})) AS is_train FROM {source}"""


@query("stratified_split", f"WITH f AS ({NO_SHOW}) {split_sql('f', 'appointment_id', 'no_show')}")
def _(t):
    return op.stratified_split(op.no_show_features(t.appointments), "appointment_id", "no_show").select("appointment_id", "no_show", "is_train")


@query("random_split", """SELECT admission_id, ROW_NUMBER() OVER (ORDER BY md5('42-' || admission_id)) <= floor(0.8e0 * COUNT(*) OVER ()) AS is_train FROM admissions""")
def _(t):
    return op.stratified_split(t.admissions.select("admission_id"), "admission_id")


@query("time_split", f"WITH f AS ({daily_sql().replace('WITH d AS', 'WITH d AS')}) SELECT record_date, ROW_NUMBER() OVER (ORDER BY record_date) <= floor(COUNT(*) OVER () * 0.8e0) AS is_train FROM f")
def _(t):
    return op.time_split(op.daily_lag_features(t.beds), "record_date").select("record_date", "is_train")


@query("balanced_weights", f"""WITH f AS ({NO_SHOW}) SELECT appointment_id, no_show, COUNT(*) OVER () / CAST(2 * COUNT(*) OVER (PARTITION BY no_show) AS DOUBLE) AS weight FROM f""")
def _(t):
    return op.balanced_weights(op.no_show_features(t.appointments), "no_show").select("appointment_id", "no_show", "weight")


def graded(t):
    """Document grades as a (label, prediction) table."""
    return t.labels.select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


def rounded(frame, *columns):
    return frame.withColumns({c: F.round(c, 6) for c in columns})


TP, SAID, ACTUAL = "SUM(quality * toxic)", "SUM(toxic)", "SUM(quality)"
ZERO = "CAST(ROUND(COALESCE({0} / CAST(NULLIF({1}, 0) AS DOUBLE), 0), 6) AS DOUBLE)"


@query("classification_metrics", f"""SELECT {ZERO.format('COUNT(*) FILTER (WHERE quality = toxic)', 'COUNT(*)')} AS accuracy, {ZERO.format(TP, SAID)} AS precision,
    {ZERO.format(TP, ACTUAL)} AS recall, {ZERO.format(f'2 * {TP}', f'{SAID} + {ACTUAL}')} AS f1 FROM labels""")
def _(t):
    return rounded(metrics.classification_metrics(graded(t)), "accuracy", "precision", "recall", "f1")


@query("confusion_matrix", """SELECT quality AS label, COUNT(*) FILTER (WHERE toxic = 0) AS predicted_0, COUNT(*) FILTER (WHERE toxic = 1) AS predicted_1 FROM labels GROUP BY 1""")
def _(t):
    return metrics.confusion_matrix(graded(t))


CLASS = "SELECT '{c}' AS class, COUNT(*) FILTER (WHERE quality = {c} AND toxic = {c}) AS tp, COUNT(*) FILTER (WHERE toxic = {c}) AS said, COUNT(*) FILTER (WHERE quality = {c}) AS support FROM labels"


@query("classification_report", f"""WITH k AS ({CLASS.format(c=0)} UNION ALL {CLASS.format(c=1)}),
    s AS (SELECT class, COALESCE(tp / CAST(NULLIF(said, 0) AS DOUBLE), 0) AS precision, COALESCE(tp / CAST(NULLIF(support, 0) AS DOUBLE), 0) AS recall,
      COALESCE(2 * tp / CAST(NULLIF(said + support, 0) AS DOUBLE), 0) AS f1, support FROM k),
    u AS (SELECT * FROM s UNION ALL SELECT 'macro avg', AVG(precision), AVG(recall), AVG(f1), SUM(support) FROM s
      UNION ALL SELECT 'weighted avg', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support), SUM(f1 * support) / SUM(support), SUM(support) FROM s)
    SELECT class, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM u""")
def _(t):
    return rounded(metrics.classification_report(graded(t)), "precision", "recall", "f1")


@query("regression_metrics", """WITH p AS (SELECT CAST(length_of_stay AS DOUBLE) AS y, AVG(length_of_stay) OVER (PARTITION BY department_id) AS guess FROM admissions),
    m AS (SELECT AVG(y) AS mean FROM p)
    SELECT ROUND(AVG(ABS(y - guess)), 6) AS mae, ROUND(SQRT(AVG((y - guess) * (y - guess))), 6) AS rmse,
    ROUND(1 - SUM((y - guess) * (y - guess)) / SUM((y - mean) * (y - mean)), 6) AS r2 FROM p, m""")
def _(t):
    return rounded(metrics.regression_metrics(metrics.department_mean_baseline(t.admissions)), "mae", "rmse", "r2")
