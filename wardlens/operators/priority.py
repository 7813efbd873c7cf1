"""Equipment maintenance priority: a weighted score, ranked by a top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions.scalars import number, scalar, strip, timestamp

# Weights, status scores, level thresholds and accepted column names.
WEIGHTS = {"failure": 0.40, "usage": 0.25, "maintenance_history": 0.15, "maintenance_urgency": 0.10, "status": 0.10}
STATUS_SCORES = {
    "out of service": 100.0,
    "out_of_service": 100.0,
    "under maintenance": 60.0,
    "under_maintenance": 60.0,
    "operational": 20.0,
    "active": 20.0,
    "working": 20.0,
    "in service": 20.0,
}
LEVELS = ((80, "Critical"), (60, "High"), (40, "Medium"))
CANDIDATES = {
    "equipment_id": ("equipment_id", "equipmentid", "equipment", "device_id", "deviceid"),
    "department_id": ("department_id", "department", "department_name"),
    "equipment_type": ("equipment_type", "equipment", "device_type"),
    "equipment_status": ("equipment_status", "status"),
    "usage_hours": ("usage_hours", "usage", "hours_used"),
    "maintenance_count": ("maintenance_count", "maintenance_counts", "number_of_maintenance"),
    "failure_count": ("failure_count", "failure_counts", "number_of_failures"),
    "last_maintenance_date": ("last_maintenance_date", "last_maintenance"),
    "next_maintenance_date": ("next_maintenance_date", "next_maintenance"),
    "failure_risk": ("failure_risk", "failure_probability", "predicted_failure_risk", "risk_score"),
}
NULL_WORDS = ("", "nan", "none", "null")


def _text(value: Column) -> Column:
    trimmed = strip(value.cast("string"))
    return F.when(~F.lower(trimmed).isin(*NULL_WORDS), trimmed)


def priority_input_clean(table: DataFrame, order: str | None = None) -> DataFrame:
    """Accepted columns under standard names; text, numbers and dates coerced.

    ``*_value`` keeps the number as recorded (it sets the range), the count is
    its whole part (it is scored).
    """
    available = {c.strip().lower().replace(" ", "_"): c for c in table.columns}
    found = {name: next((available[c] for c in options if c in available), None) for name, options in CANDIDATES.items()}
    if not found["equipment_id"]:
        raise ValueError("the table has no equipment id column")

    def source(name: str) -> Column:
        return F.col(f"`{found[name]}`") if found[name] else F.lit(None).cast("string")

    def amount(name: str) -> Column:
        return F.coalesce(number(source(name)), F.lit(0.0))

    columns = [_text(source(n)).alias(n) for n in ("equipment_id", "department_id", "equipment_type", "equipment_status")]
    columns += [
        amount("usage_hours").alias("usage_hours"),
        amount("maintenance_count").alias("maintenance_value"),
        amount("failure_count").alias("failure_value"),
        amount("maintenance_count").cast("bigint").alias("maintenance_count"),
        amount("failure_count").cast("bigint").alias("failure_count"),
        *[timestamp(source(n)).cast("date").alias(n) for n in ("last_maintenance_date", "next_maintenance_date")],
    ]
    if found["failure_risk"]:
        columns.append(amount("failure_risk").alias("failure_risk"))
    if order:
        columns.append(F.col(order).alias("order_"))
    return table.select(*columns)


def _scaled(value: Column, low: Column, high: Column) -> Column:
    share = (value - low) / (high - low) * 100
    return F.when(high <= low, F.lit(0.0)).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0)))


def priority_min_max(clean: DataFrame) -> DataFrame:
    """Adds the three scaled scores. Ranges cover all rows and arrive as one scalar subquery."""
    risk = "failure_risk" if "failure_risk" in clean.columns else "failure_value"
    ranged = ("usage_hours", "maintenance_value", risk)
    bounds = scalar(clean, F.struct(*[f(c).alias(f"{n}_{c}") for c in ranged for n, f in (("low", F.min), ("high", F.max))]))
    scored = {"failure_score": (risk if risk == "failure_risk" else "failure_count", risk), "usage_score": ("usage_hours", "usage_hours"),
              "maintenance_history_score": ("maintenance_count", "maintenance_value")}
    return clean.withColumns(
        {
            name: _scaled(F.col(value).cast("double"), bounds.getField(f"low_{source}"), bounds.getField(f"high_{source}"))
            for name, (value, source) in scored.items()
        }
    )


def maintenance_urgency(due: str | Column, as_of: str) -> Column:
    """50 without a date, 100 when due, falling to 0 a year ahead."""
    days = F.date_diff(F.col(due) if isinstance(due, str) else due, F.lit(as_of).cast("date"))
    later = F.lit(100.0) - days / F.lit(365.0) * 100.0
    return F.when(days.isNull(), F.lit(50.0)).when(days <= 0, F.lit(100.0)).otherwise(F.least(F.greatest(later, F.lit(0.0)), F.lit(100.0)))


def status_score(status: str | Column) -> Column:
    plain = F.replace(F.lower(F.col(status) if isinstance(status, str) else status), F.lit("-"), F.lit(" "))
    scores = F.create_map(*[F.lit(v) for pair in STATUS_SCORES.items() for v in pair])
    return F.coalesce(F.try_element_at(scores, plain), F.lit(50.0))


def priority_scores(table: DataFrame, as_of: str, order: str | None = None) -> DataFrame:
    """Every unit with its component scores, total and level.

    With ``order`` a unit may occur repeatedly and its last record counts; the
    last record is found by a pre-aggregating maximum, not a sort per unit.
    """
    scored = priority_min_max(priority_input_clean(table, order)).where("equipment_id IS NOT NULL")
    if order:
        rest = [c for c in scored.columns if c not in ("equipment_id", "order_")]
        scored = scored.groupBy("equipment_id").agg(F.max(F.struct("order_", *rest)).alias("last")).select(
            "equipment_id", *[F.col(f"last.{c}").alias(c) for c in rest]
        )
    scored = scored.withColumns(
        {"maintenance_urgency_score": maintenance_urgency("next_maintenance_date", as_of), "status_score": status_score("equipment_status")}
    )
    total = sum((F.col(f"{part}_score") * F.lit(weight) for part, weight in list(WEIGHTS.items())[1:]), F.col("failure_score") * F.lit(WEIGHTS["failure"]))
    priority = F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 2)
    level = F.lit("Low")
    for floor, name in reversed(LEVELS):
        level = F.when(F.col("priority_score") >= floor, name).otherwise(level)
    parts = [f"{part}_score" for part in WEIGHTS]
    return (
        scored.withColumn("priority_score", priority)
        .withColumn("priority_level", level)
        .select(
            "equipment_id", "department_id", "equipment_type", "equipment_status", F.round("usage_hours", 2).alias("usage_hours"),
            "maintenance_count", "failure_count", *[F.round(p, 2).alias(p) for p in parts], "priority_score",
            "last_maintenance_date", "next_maintenance_date", "priority_level",
        )
    )


def equipment_priority(table: DataFrame, as_of: str, top: int | None = 20, order: str | None = None) -> DataFrame:
    ranked = priority_scores(table, as_of, order).orderBy(F.desc("priority_score"), "equipment_id")
    return ranked if top is None else ranked.limit(max(1, top))


def priority_summary(table: DataFrame, as_of: str, top: int = 20, order: str | None = None) -> DataFrame:
    """Units processed and listed, and units per level, as ``(measure, units)``."""
    levels = priority_scores(table, as_of, order).groupBy("priority_level").agg(F.count(F.lit(1)).alias("units"))
    total = F.coalesce(F.sum("units"), F.lit(0))
    totals = levels.agg(total.alias("processed"), F.least(total, F.lit(max(1, top))).alias("listed"))
    rows = totals.select(
        F.explode(
            F.array(
                F.struct(F.lit("records_processed").alias("measure"), F.col("processed").alias("units")),
                F.struct(F.lit("listed").alias("measure"), F.col("listed").cast("bigint").alias("units")),
            )
        ).alias("r")
    ).select("r.*")
    return rows.unionByName(levels.select(F.col("priority_level").alias("measure"), "units"))
