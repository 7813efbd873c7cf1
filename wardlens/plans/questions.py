"""C: question logs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlens.functions import routing
from wardlens.functions.scalars import WHITESPACE
from wardlens.operators import charts, kpis
from wardlens.operators import questions as op
from wardlens.plans.charts import chart_sql, top_sql, union
from wardlens.plans.kpis import ADMISSION
from wardlens.plans.registry import query, r2
from wardlens.sources.fixtures import AS_OF


def says(pattern, column="text"):
    return f"regexp_matches({column}, '(?i){pattern.replace(chr(39), chr(39) * 2)}')"


def matches(patterns):
    cases = ", ".join(f"CASE WHEN {says(p)} THEN '{name}' END" for name, p in patterns)
    return f"list_filter([{cases}], lambda m: m IS NOT NULL)"


def said(patterns):
    return "(" + " OR ".join(says(p) for p in patterns) + ")"


SPACED = f"trim(regexp_replace(COALESCE(question, ''), '{WHITESPACE}+', ' ', 'g'))"
DEPARTMENT = f"trim(regexp_replace(regexp_extract(text, '(?i){routing.DEPARTMENT.replace(chr(39), chr(39) * 2)}', 1), ' +', ' ', 'g'), ' ' || chr(9) || '.,?!:;-')"
ROUTED = f"""flagged AS (SELECT question_id, text, {matches(routing.ML_PATTERNS)} AS ml, {said(routing.DOCUMENT_PATTERNS)} AS document, {said(routing.OPERATIONAL_PATTERNS)} AS operational,
      {matches(routing.SQL_PATTERNS)} AS sql, {said(routing.DATASET_PATTERNS)} AS dataset, {says(routing.RAW_SQL)} AS statement,
      CASE WHEN {DEPARTMENT} <> '' AND length({DEPARTMENT}) <= 80 THEN {DEPARTMENT} END AS place FROM (SELECT question_id, {SPACED} AS text FROM question_log)),
    chosen AS (SELECT *, CASE WHEN text = '' THEN 1 WHEN len(ml) = 1 AND NOT document THEN 2 WHEN len(ml) >= 1 THEN 3 WHEN document THEN 4 WHEN operational THEN 5
      WHEN len(sql) = 1 THEN 6 WHEN len(sql) > 1 THEN 7 WHEN dataset THEN 8 WHEN statement THEN 9 ELSE 10 END AS k FROM flagged),
    routed AS (SELECT question_id, ['clarify', 'ml', 'clarify', 'rag', 'dataset', 'sql', 'clarify', 'dataset', 'clarify', 'clarify'][k] AS intent,
      [0e0, 0.96e0, 0.35e0, 0.94e0, 0.9e0, 0.93e0, 0.3e0, 0.78e0, 0.1e0, 0.2e0][k] AS confidence, CASE k WHEN 2 THEN ml[1] WHEN 6 THEN sql[1] END AS model,
      CASE WHEN k = 6 AND sql[1] = 'average_length_of_stay' THEN place END AS department FROM chosen)"""


@query("classify_questions", f"WITH {ROUTED} SELECT * FROM routed")
def _(t):
    return op.classify_questions(t.question_log)


@query("extract_department", f"WITH {ROUTED} SELECT question_id, place AS department FROM flagged")
def _(t):
    return op.extract_department(t.question_log)


@query("intent_summary", f"WITH {ROUTED} SELECT intent, model, COUNT(*) AS questions FROM routed GROUP BY ALL")
def _(t):
    return op.intent_summary(op.classify_questions(t.question_log))


def numbered_kpis(t):
    """Admission KPIs and the department count in label order (a handful of rows)."""
    rows = kpis.adaptive_kpis(t.admissions)
    return rows.select(F.row_number().over(Window.orderBy("kpi")).alias("kpi_no"), "kpi", "value")


KPI_ROWS = {**ADMISSION, "Departments": "COUNT(DISTINCT department_id)"}
KPIS = f"""k AS (SELECT kpi, value FROM (SELECT unnest([{', '.join(repr(n) for n in KPI_ROWS)}]) AS kpi,
    unnest([{', '.join(f'CAST({v} AS DOUBLE)' for v in KPI_ROWS.values())}]) AS value FROM admissions)),
    kpis AS (SELECT ROW_NUMBER() OVER (ORDER BY kpi) AS kpi_no, kpi, value FROM k)"""
WORDS = f"""q AS (SELECT question_id, list_transform(list_filter(string_split({SPACED}, ' '), lambda w: length(w) > 2), lambda w: trim(lower(w), '{routing.WORD_EDGES}')) AS words FROM question_log),
    qw AS (SELECT DISTINCT question_id, unnest(words) AS word FROM q)"""


def label_words(expression):
    return f"list_transform(regexp_split_to_array(replace({expression}, '_', ' '), '\\s+'), lambda w: trim(lower(w), '{routing.WORD_EDGES}'))"


@query("match_kpis", f"""WITH {WORDS}, {KPIS}, kw AS (SELECT DISTINCT kpi_no, unnest({label_words('kpi')}) AS word FROM kpis),
    pairs AS (SELECT DISTINCT question_id, kpi_no FROM qw JOIN kw USING (word)),
    found AS (SELECT question_id, kpi_no FROM pairs QUALIFY ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY kpi_no) <= 10)
    SELECT question_id, kpi, value, TRUE AS matched FROM found JOIN kpis USING (kpi_no)
    UNION ALL SELECT question_id, kpi, value, FALSE FROM question_log, kpis WHERE kpi_no <= 6 AND question_id NOT IN (SELECT question_id FROM pairs)""")
def _(t):
    return op.match_kpis(t.question_log, numbered_kpis(t))


def result_tables(t):
    rows = charts.group_tables(t.admissions)
    order = F.row_number().over(Window.partitionBy("title").orderBy(F.desc("value"), "label"))
    columns = F.when(F.col("title") == "Admissions by Type", "admission_type admissions").otherwise("department_id admissions")
    return rows.select("title", columns.alias("columns"), order.alias("ord"), "label", "value")


TABLES = f"""rows_ AS ({union(top_sql('Admissions by Type', 'admissions', 'admission_type'), top_sql('Admissions by Department', 'admissions', 'department_id', 'COUNT(admission_id)'))}),
    tables_ AS (SELECT title, CASE title WHEN 'Admissions by Type' THEN 'admission_type admissions' ELSE 'department_id admissions' END AS columns,
      ROW_NUMBER() OVER (PARTITION BY title ORDER BY value DESC, label) AS ord, label, value FROM rows_)"""


@query("match_tables", f"""WITH {WORDS}, {TABLES}, tw AS (SELECT DISTINCT title, unnest({label_words("title || ' ' || columns")}) AS word FROM (SELECT DISTINCT title, columns FROM tables_)),
    pairs AS (SELECT DISTINCT question_id, title FROM qw JOIN tw USING (word)) SELECT question_id, title, ord, label, value FROM pairs JOIN tables_ USING (title) WHERE ord <= 3""")
def _(t):
    return op.match_tables(t.question_log, result_tables(t))


HIGHEST = ", ".join(f"'{w}'" for w in routing.HIGHEST_WORDS)


@query("highest_admissions_answer", f"""WITH {WORDS}, {TABLES}, top AS (SELECT label, value FROM tables_ WHERE title = 'Admissions by Department' AND ord = 1)
    SELECT question_id, label AS department, value AS admissions FROM q, top
    WHERE len(list_intersect(words, [{HIGHEST}])) > 0 AND len(list_intersect(words, ['admission', 'admissions'])) > 0""")
def _(t):
    table = result_tables(t).where("title = 'Admissions by Department'").select("label", "value")
    return op.highest_admissions_answer(t.question_log, table)


def lookup_sql():
    for i, (rule, phrases, source, pattern) in enumerate(routing.LOOKUPS):
        asked = " OR ".join(f"contains(lower(question), '{p}')" for p in phrases)
        if source == "kpi":
            answer = f"(SELECT kpi AS label, value FROM kpis WHERE {says(pattern, 'kpi')} ORDER BY kpi_no LIMIT 1)"
        else:
            answer = f"(SELECT label, value FROM charts WHERE {says(pattern, 'title')} ORDER BY chart_no, value DESC, label LIMIT 1)"
        yield f"SELECT question_id, {i} AS n, '{rule}' AS rule, label, value FROM question_log, {answer} WHERE {asked}"


CHARTS = "charts AS (" + union(
    chart_sql("Admissions by Department", "admissions", "department_id", "'bar'", "admissions", "admissions", number=1),
    chart_sql("Admission type distribution", "admissions", "admission_type", "'donut'", "records", "admissions", number=2)) + ")"


@query("kpi_phrase_lookup", f"""WITH {KPIS}, {CHARTS}, hits AS ({' UNION ALL '.join(lookup_sql())})
    SELECT question_id, rule, label, value FROM hits QUALIFY ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY n) = 1""")
def _(t):
    answers = op.lookup_answers(numbered_kpis(t), charts.dashboard_charts(t.admissions).where("type <> 'line'"))
    return op.kpi_phrase_lookup(t.question_log, answers)


@query("answer_questions", f"""WITH {ROUTED}, names AS (SELECT d.department_name, COUNT(*) AS n, {r2('AVG(length_of_stay)')} AS mean FROM admissions a JOIN departments d ON a.department_id = d.department_id GROUP BY 1),
    figures AS (SELECT 'average_length_of_stay' AS model, '' AS place, CAST(NULL AS VARCHAR) AS label, {r2('AVG(length_of_stay)')} AS value FROM admissions
      UNION ALL SELECT 'average_length_of_stay', lower(department_name), NULL, mean FROM names
      UNION ALL (SELECT 'most_admissions', '', department_name, CAST(n AS DOUBLE) FROM names ORDER BY n DESC, department_name LIMIT 1)
      UNION ALL SELECT 'cancelled_appointments_last_month', '', NULL, CAST(SUM(CASE WHEN lower(trim(appointment_status)) IN ('cancelled', 'canceled') THEN 1 ELSE 0 END) AS DOUBLE)
        FROM appointments WHERE appointment_date >= date_trunc('month', DATE '{AS_OF}') - INTERVAL 1 MONTH AND appointment_date < date_trunc('month', DATE '{AS_OF}') HAVING COUNT(*) > 0
      UNION ALL SELECT 'occupied_beds', '', strftime(MAX(record_date), '%Y-%m-%d'), CAST(SUM(occupied_beds) AS DOUBLE) FROM beds WHERE record_date = (SELECT MAX(record_date) FROM beds)
      UNION ALL SELECT 'operational_equipment', '', NULL, CAST(COUNT(*) AS DOUBLE) FROM equipment WHERE lower(trim(equipment_status)) IN ('operational', 'active', 'working', 'in service'))
    SELECT question_id, r.model, department, label, value FROM routed r LEFT JOIN figures f ON r.model = f.model AND COALESCE(lower(r.department), '') = f.place WHERE intent = 'sql'""")
def _(t):
    routed = op.classify_questions(op.sql_candidates(t.question_log))
    return op.answer_questions(routed, t.admissions, t.appointments, t.beds, t.equipment, t.departments, AS_OF)
