"""U: schema understanding."""

from functools import reduce

from pyspark.sql import DataFrame

from wardlens.functions import roles as rules
from wardlens.operators import catalog as op
from wardlens.plans.quality import COLUMNS, type_of
from wardlens.plans.registry import query
from wardlens.session import stored

NAMES = """bases AS (SELECT *, COALESCE(NULLIF(trim(regexp_replace(lower(column_name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unnamed') AS base FROM upload_catalog),
    copies AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_id, base ORDER BY position) AS k FROM bases),
    cat AS (SELECT dataset_id, position, column_name, dtype, CASE WHEN k = 1 THEN base ELSE concat(base, '_', k) END AS name FROM copies)"""


def fits_sql(alternatives, name="name"):
    def holds(pattern):
        return f"NOT regexp_matches({name}, '{pattern[1:]}')" if pattern.startswith("!") else f"regexp_matches({name}, '{pattern}')"

    return " OR ".join("(" + " AND ".join(holds(p) for p in patterns) + ")" for patterns in alternatives)


def names(t):
    """The normalised catalogue as the stored table the other operators read."""
    return stored(op.normalize_columns(t.upload_catalog), "catalog")


@query("normalize_columns", f"WITH {NAMES} SELECT * FROM cat")
def _(t):
    return op.normalize_columns(t.upload_catalog)


FLAGS = "flags AS (SELECT dataset_id, " + ", ".join(
    f"bool_or({fits_sql(alternatives)}) AS m{i}" for i, (_, alternatives) in enumerate(rules.MODULES)) + " FROM cat GROUP BY dataset_id)"
LISTED = "listed AS (SELECT dataset_id, list_filter([" + ", ".join(
    f"CASE WHEN m{i} THEN '{module}' END" for i, (module, _) in enumerate(rules.MODULES)) + "], lambda x: x IS NOT NULL) AS modules FROM flags)"
EXPLODED = "found AS (SELECT dataset_id, unnest(range(len(modules))) AS module_order, unnest(modules) AS module FROM listed)"


@query("detect_modules", f"WITH {NAMES}, {FLAGS}, {LISTED}, {EXPLODED} SELECT * FROM found")
def _(t):
    return op.detect_modules(names(t))


@query("dataset_type", f"""WITH {NAMES}, {FLAGS}, {LISTED} SELECT dataset_id,
    CASE WHEN len(modules) = 1 THEN lower(replace(modules[1], ' Analytics', '')) WHEN len(modules) > 1 THEN 'hospital operations' ELSE 'general dataset' END AS profile_type,
    CASE WHEN len(modules) = 1 THEN lower(replace(modules[1], ' Analytics', '')) WHEN len(modules) > 1 THEN 'hospital_operations' ELSE 'general' END AS analytics_type
    FROM listed""")
def _(t):
    return op.dataset_type(names(t))


def role_parts():
    for role, aliases in rules.ROLE_ALIASES.items():
        listed = "[" + ", ".join(f"'{a}'" for a in aliases) + "]"
        yield f"SELECT dataset_id, '{role}' AS role, 1 AS tier, list_position({listed}, name) AS rank, position, name FROM cat WHERE list_contains({listed}, name)"
        yield f"SELECT dataset_id, '{role}', 2, 0, position, name FROM cat WHERE {fits_sql(rules.ROLE_PATTERNS[role])}"
        if role in rules.BARE_NAMES:
            bare = ", ".join(f"'{b}'" for b in rules.BARE_NAMES[role])
            yield f"""SELECT dataset_id, '{role}', 3, 0, position, name FROM cat WHERE name IN ({bare})
                AND dataset_id IN (SELECT dataset_id FROM cat WHERE regexp_matches(name, '{rules.EQUIPMENT_WORDS}'))"""


ROLES = f"""candidates AS ({' UNION ALL '.join(role_parts())}),
    ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_id, role ORDER BY tier, rank, position) AS pick FROM candidates),
    roles AS (SELECT dataset_id, role, name AS column_name FROM ranked WHERE pick = 1)"""


@query("resolve_roles", f"WITH {NAMES}, {ROLES} SELECT * FROM roles")
def _(t):
    return op.resolve_roles(names(t))


@query("failure_event_role", f"""WITH {NAMES} SELECT dataset_id, arg_min(name, position) AS failure_event_column FROM cat
    WHERE {fits_sql(rules.FAILURE_EVENT_PATTERNS)} GROUP BY dataset_id""")
def _(t):
    return op.failure_event_role(names(t))


def gate_parts():
    for model, features in rules.MODEL_FEATURES.items():
        for feature, source in features.items():
            if isinstance(source, str):
                yield f"SELECT dataset_id, '{model}' AS model, '{feature}' AS feature FROM roles WHERE role = '{source}'"
            else:
                listed = ", ".join(f"'{s}'" for s in source)
                yield f"SELECT dataset_id, '{model}' AS model, '{feature}' AS feature FROM cat WHERE name IN ({listed})"


NEEDED = ", ".join(f"('{m}', '{f}')" for m, features in rules.MODEL_FEATURES.items() for f in features)


@query("feature_gate", f"""WITH {NAMES}, {ROLES}, found AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(gate_parts())})),
    wanted AS (SELECT dataset_id, model, feature FROM (SELECT DISTINCT dataset_id FROM cat), (VALUES {NEEDED}) AS needed(model, feature))
    SELECT w.dataset_id, w.model, COUNT(f.feature) AS features_found, COUNT(*) AS features_needed,
    COALESCE(string_agg(w.feature, ',' ORDER BY w.feature) FILTER (WHERE f.feature IS NULL), '') AS missing, COUNT(f.feature) = COUNT(*) AS available
    FROM wanted w LEFT JOIN found f ON w.dataset_id = f.dataset_id AND w.model = f.model AND w.feature = f.feature GROUP BY w.dataset_id, w.model""")
def _(t):
    return op.feature_gate(names(t))


PREFERRED = " UNION ALL ".join(
    f"SELECT dataset_id, '{m}' AS module, list_position([{', '.join(repr(d) for d in dates)}], name) AS rank, name FROM cat WHERE name IN ({', '.join(repr(d) for d in dates)})"
    for m, dates in rules.MODULE_DATES.items())


@query("module_date_column", f"""WITH {NAMES}, {FLAGS}, {LISTED}, {EXPLODED}, {ROLES}, preferred AS ({PREFERRED}),
    best AS (SELECT dataset_id, module, arg_min(name, rank) AS name FROM preferred GROUP BY 1, 2)
    SELECT f.dataset_id, f.module, COALESCE(b.name, r.column_name) AS date_column FROM found f
    LEFT JOIN best b ON f.dataset_id = b.dataset_id AND f.module = b.module
    LEFT JOIN roles r ON f.dataset_id = r.dataset_id AND r.role = 'date' WHERE f.module <> 'Department Analytics'""")
def _(t):
    return op.module_date_column(names(t))


def profile_sql(name):
    columns = COLUMNS[name]
    parts = []
    for i, c in enumerate(columns):
        kind = type_of(c)
        numeric = kind in op.NUMERIC_TYPES
        dated = f"COUNT({c}) / CAST(COUNT(*) AS DOUBLE) >= 0.7" if "date" in c or "time" in c else "FALSE"
        parts.append(f"""SELECT '{name}' AS dataset_id, {i} AS position, '{c}' AS column_name, '{kind}' AS data_type, COUNT(*) - COUNT({c}) AS missing,
            COUNT(DISTINCT {c}) AS distinct_values, {numeric} AS is_numeric, {dated} AS is_date, COUNT(*) AS row_count, {len(columns)} AS column_count,
            COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {name})) AS duplicate_rows FROM {name}""")
    return " UNION ALL ".join(parts)


@query("profile_dataset", profile_sql("appointments"))
def _(t):
    return op.profile_dataset(t.appointments, "appointments")


PROFILED = ("admissions", "appointments", "beds", "departments", "equipment")
TARGET = "NOT (column_name LIKE '%\\_id' ESCAPE '\\' OR distinct_values = row_count) AND NOT is_date AND distinct_values BETWEEN 2 AND 20"


@query("dataset_capabilities", f"""WITH p AS ({' UNION ALL '.join(profile_sql(n) for n in PROFILED)}),
    s AS (SELECT dataset_id, MAX(row_count) AS n, MAX(column_count) AS k, SUM(missing) AS missing, COUNT(*) FILTER (WHERE is_numeric) AS numeric_n,
      COUNT(*) FILTER (WHERE NOT is_numeric AND NOT is_date) AS text_n, COUNT(*) FILTER (WHERE is_date) AS date_n, COUNT(*) FILTER (WHERE {TARGET}) AS targets FROM p GROUP BY 1),
    l AS (SELECT dataset_id, list_filter([CASE WHEN n > 0 AND k > 0 THEN 'Descriptive statistics' END, CASE WHEN missing > 0 THEN 'Missing-value analysis' END,
      CASE WHEN numeric_n >= 1 THEN 'Numeric analysis' END, CASE WHEN numeric_n >= 2 THEN 'Correlation analysis' END, CASE WHEN numeric_n >= 2 THEN 'Numeric visualizations' END,
      CASE WHEN text_n >= 1 THEN 'Categorical analysis' END, CASE WHEN text_n >= 1 THEN 'Categorical visualizations' END, CASE WHEN n >= 10 THEN 'Data distribution analysis' END,
      CASE WHEN date_n >= 1 THEN 'Date/time analysis' END, CASE WHEN date_n >= 1 THEN 'Trend analysis' END, CASE WHEN date_n >= 1 THEN 'Time-series visualizations' END,
      CASE WHEN n >= 20 AND k >= 2 AND targets >= 1 THEN 'Machine learning candidate analysis' END], lambda x: x IS NOT NULL) AS c FROM s)
    SELECT dataset_id, unnest(range(len(c))) AS capability_order, unnest(c) AS capability FROM l""")
def _(t):
    profiles = [op.profile_dataset(getattr(t, name), name) for name in PROFILED]
    return op.dataset_capabilities(reduce(DataFrame.unionByName, profiles))


@query("safe_preview", """SELECT appointment_id, department_id, appointment_date, appointment_type, booking_date, wait_time_days, appointment_status
    FROM appointments ORDER BY appointment_id LIMIT 8""")
def _(t):
    return op.safe_preview(t.appointments, "appointment_id")


@query("fallback_category_chart", """SELECT 'event_type' AS column_name, event_type AS label, COUNT(*) AS value FROM events GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 12""")
def _(t):
    return op.fallback_category_chart(t.events)
