"""P: equipment priority."""

from pyspark.sql import functions as F

from wardlens.operators import priority as op
from wardlens.plans.registry import query, r2
from wardlens.sources.fixtures import AS_OF


def untidy(t):
    """The equipment table as an upload: text everywhere, blank ids, unreadable numbers, other names."""
    blank = F.when(F.col("equipment_id") % 37 == 0, " null ").when(F.col("equipment_id") % 41 == 0, "  ")
    return t.equipment.select(
        F.coalesce(blank, F.concat(F.lit(" EQ"), F.col("equipment_id"))).alias("Device ID"),
        F.col("department_id").cast("string").alias("Department"),
        F.col("equipment_type").alias("Device Type"),
        F.when(F.col("equipment_id") % 3 == 0, F.regexp_replace(F.upper("equipment_status"), " ", "-")).otherwise(F.col("equipment_status")).alias("Status"),
        F.when(F.col("equipment_id") % 13 == 0, "n/a").otherwise(F.col("usage_hours").cast("string")).alias("Usage"),
        (F.col("maintenance_count") + 0.75).cast("string").alias("Maintenance Counts"),
        F.col("failure_count").cast("string").alias("Failure Counts"),
        F.col("last_maintenance_date").cast("string").alias("Last Maintenance"),
        F.coalesce(F.col("next_maintenance_date").cast("string"), F.lit("unknown")).alias("Next Maintenance"),
    )


UNTIDY = """clean AS (SELECT CASE WHEN equipment_id % 37 = 0 OR equipment_id % 41 = 0 THEN NULL ELSE concat('EQ', equipment_id) END AS equipment_id,
    CAST(department_id AS VARCHAR) AS department_id, equipment_type,
    CASE WHEN equipment_id % 3 = 0 THEN replace(upper(equipment_status), ' ', '-') ELSE equipment_status END AS equipment_status,
    CASE WHEN equipment_id % 13 = 0 THEN 0e0 ELSE usage_hours END AS usage_hours, maintenance_count + 0.75e0 AS maintenance_value, CAST(failure_count AS DOUBLE) AS failure_value,
    CAST(maintenance_count AS BIGINT) AS maintenance_count, CAST(failure_count AS BIGINT) AS failure_count, last_maintenance_date, next_maintenance_date FROM equipment)"""
TIDY = """clean AS (SELECT CAST(equipment_id AS VARCHAR) AS equipment_id, CAST(department_id AS VARCHAR) AS department_id, equipment_type, equipment_status, usage_hours,
    CAST(maintenance_count AS DOUBLE) AS maintenance_value, CAST(failure_count AS DOUBLE) AS failure_value, CAST(maintenance_count AS BIGINT) AS maintenance_count,
    CAST(failure_count AS BIGINT) AS failure_count, last_maintenance_date, next_maintenance_date {more} FROM {source})"""


def scaled_sql(value, source):
    low, high = f"(SELECT MIN({source}) FROM clean)", f"(SELECT MAX({source}) FROM clean)"
    return f"CASE WHEN {high} <= {low} THEN 0e0 ELSE LEAST(GREATEST((CAST({value} AS DOUBLE) - {low}) / ({high} - {low}) * 100, 0e0), 100e0) END"


SCALED = f"""scaled AS (SELECT *, {scaled_sql('failure_count', 'failure_value')} AS failure_score, {scaled_sql('usage_hours', 'usage_hours')} AS usage_score,
    {scaled_sql('maintenance_count', 'maintenance_value')} AS maintenance_history_score FROM clean)"""
URGENCY = f"""CASE WHEN next_maintenance_date IS NULL THEN 50e0 WHEN next_maintenance_date <= DATE '{AS_OF}' THEN 100e0
    ELSE LEAST(GREATEST(100e0 - (next_maintenance_date - DATE '{AS_OF}') / 365e0 * 100e0, 0e0), 100e0) END"""
STATUS = """CASE replace(lower(equipment_status), '-', ' ') WHEN 'out of service' THEN 100e0 WHEN 'out_of_service' THEN 100e0 WHEN 'under maintenance' THEN 60e0
    WHEN 'under_maintenance' THEN 60e0 WHEN 'operational' THEN 20e0 WHEN 'active' THEN 20e0 WHEN 'working' THEN 20e0 WHEN 'in service' THEN 20e0 ELSE 50e0 END"""
PARTS = ("failure_score", "usage_score", "maintenance_history_score", "maintenance_urgency_score", "status_score")
TOTAL = "failure_score * 0.4e0 + usage_score * 0.25e0 + maintenance_history_score * 0.15e0 + maintenance_urgency_score * 0.1e0 + status_score * 0.1e0"
SCORED = f"""{SCALED}, scored AS (SELECT *, {URGENCY} AS maintenance_urgency_score, {STATUS} AS status_score FROM scaled WHERE equipment_id IS NOT NULL),
    ranked AS (SELECT *, {r2(f'LEAST(GREATEST({TOTAL}, 0e0), 100e0)')} AS priority_score FROM scored),
    listed AS (SELECT equipment_id, department_id, equipment_type, equipment_status, {r2('usage_hours')} AS usage_hours, maintenance_count, failure_count,
      {', '.join(f'{r2(p)} AS {p}' for p in PARTS)}, priority_score, last_maintenance_date, next_maintenance_date,
      CASE WHEN priority_score >= 80 THEN 'Critical' WHEN priority_score >= 60 THEN 'High' WHEN priority_score >= 40 THEN 'Medium' ELSE 'Low' END AS priority_level FROM ranked)"""


@query("priority_input_clean", f"WITH {UNTIDY} SELECT * FROM clean")
def _(t):
    return op.priority_input_clean(untidy(t))


@query("priority_min_max", f"WITH {UNTIDY}, {SCALED} SELECT equipment_id, ROUND(failure_score, 6) AS failure_score, ROUND(usage_score, 6) AS usage_score, ROUND(maintenance_history_score, 6) AS maintenance_history_score FROM scaled")
def _(t):
    scores = op.priority_min_max(op.priority_input_clean(untidy(t)))
    return scores.select("equipment_id", *[F.round(c, 6).alias(c) for c in PARTS[:3]])


@query("maintenance_urgency", f"SELECT equipment_id, ROUND({URGENCY}, 6) AS maintenance_urgency_score FROM equipment")
def _(t):
    return t.equipment.select("equipment_id", F.round(op.maintenance_urgency("next_maintenance_date", AS_OF), 6).alias("maintenance_urgency_score"))


@query("status_score", f"SELECT equipment_id, equipment_status, {STATUS} AS status_score FROM (SELECT equipment_id, CASE equipment_id % 5 WHEN 0 THEN 'In-Service' WHEN 1 THEN 'retired' WHEN 2 THEN NULL ELSE equipment_status END AS equipment_status FROM equipment)")
def _(t):
    spelled = F.expr("CASE equipment_id % 5 WHEN 0 THEN 'In-Service' WHEN 1 THEN 'retired' WHEN 2 THEN NULL ELSE equipment_status END")
    return t.equipment.select("equipment_id", spelled.alias("equipment_status")).withColumn("status_score", op.status_score("equipment_status"))


@query("equipment_priority", f"WITH {TIDY.format(source='equipment', more='')}, {SCORED} SELECT * FROM listed ORDER BY priority_score DESC, equipment_id LIMIT 20")
def _(t):
    return op.equipment_priority(t.equipment, AS_OF, 20)


@query("equipment_priority_all", f"WITH {UNTIDY}, {SCORED} SELECT * FROM listed")
def _(t):
    return op.equipment_priority(untidy(t), AS_OF, None)


SNAPSHOTS = """snapshots AS (SELECT *, 2 AS snapshot FROM equipment UNION ALL SELECT * REPLACE (usage_hours * 3 AS usage_hours), 1 AS snapshot FROM equipment)"""


def snapshots(t):
    earlier = t.equipment.withColumn("usage_hours", F.col("usage_hours") * 3).withColumn("snapshot", F.lit(1))
    return t.equipment.withColumn("snapshot", F.lit(2)).unionByName(earlier)


LATEST = SCORED.replace("FROM scaled WHERE equipment_id IS NOT NULL", "FROM scaled WHERE equipment_id IS NOT NULL AND snapshot = 2")


@query("equipment_priority_latest", f"WITH {SNAPSHOTS}, {TIDY.format(source='snapshots', more=', snapshot')}, {LATEST} SELECT * FROM listed ORDER BY priority_score DESC, equipment_id LIMIT 20")
def _(t):
    return op.equipment_priority(snapshots(t), AS_OF, 20, order="snapshot")


RISKED = TIDY.format(source="equipment", more=", usage_hours / (1 + failure_count) AS failure_risk")


@query("equipment_priority_risk", f"WITH {RISKED}, {SCORED.replace(scaled_sql('failure_count', 'failure_value'), scaled_sql('failure_risk', 'failure_risk'))} SELECT * FROM listed ORDER BY priority_score DESC, equipment_id LIMIT 20")
def _(t):
    # A model's risk column replaces the failure count.
    risked = t.equipment.withColumn("risk_score", F.col("usage_hours") / (1 + F.col("failure_count")))
    return op.equipment_priority(risked, AS_OF, 20)


@query("priority_summary", f"""WITH {UNTIDY}, {SCORED} SELECT 'records_processed' AS measure, COUNT(DISTINCT equipment_id) AS units FROM listed
    UNION ALL SELECT 'listed', LEAST(COUNT(*), 20) FROM listed UNION ALL SELECT priority_level, COUNT(*) FROM listed GROUP BY 1""")
def _(t):
    return op.priority_summary(untidy(t), AS_OF, 20)
