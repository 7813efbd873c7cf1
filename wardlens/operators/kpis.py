"""KPIs of an uploaded table whose columns are found by role.

Every function returns ``(kpi, value)`` rows from one aggregate over the table;
a KPI whose columns are absent, or whose values are all missing, gives no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions.roles import modules_of, roles_of
from wardlens.functions.scalars import count_where, number, ratio, stack, strip, timestamp
from wardlens.operators.charts import group_table

# Status spellings after everything but letters is dropped.
COMPLETED = ("completed", "complete", "attended")
MISSED = ("noshow", "missed", "didnotattend")
OPERATIONAL = "operational|active|working"


def _kpis(table: DataFrame, measures: dict[str, Column], digits: dict[str, int] | None = None) -> DataFrame:
    names = list(measures)
    one = table.agg(*[F.round(measures[n].cast("double"), (digits or {}).get(n, 2)).alias(n) for n in names])
    return stack(one, [(n, F.col(f"`{n}`")) for n in names], "kpi", "value").where("value IS NOT NULL")


def _total(count: str | None, key: str | None) -> Column:
    """Sum of a count column, else the non-null ids, else the rows."""
    if count:
        return F.coalesce(F.sum(number(count)), F.lit(0.0))
    return F.count(key) if key else F.count(F.lit(1))


def admission_kpis(table: DataFrame, roles: dict | None = None) -> DataFrame:
    roles = roles or roles_of(table.columns)
    measures = {"Total Admissions": _total(roles["admission_count"], roles["admission_id"])}
    if roles["length_of_stay"]:
        stay = number(roles["length_of_stay"])
        measures["Average Length of Stay"] = F.avg(stay)
        measures["Peak Length of Stay"] = F.max(stay)
    if roles["patient_id"]:
        measures["Unique Patients"] = F.count_distinct(roles["patient_id"])
    return _kpis(table, measures)


def appointment_kpis(table: DataFrame, roles: dict | None = None) -> DataFrame:
    roles = roles or roles_of(table.columns)
    count = roles["appointment_count"]
    measures = {"Total Appointments": _total(count, roles["appointment_id"])}
    if roles["appointment_status"]:
        status = F.regexp_replace(F.lower(strip(F.coalesce(F.col(roles["appointment_status"]).cast("string"), F.lit("")))), "[^a-z]", "")
        weight = F.coalesce(number(count), F.lit(0.0)) if count else F.lit(1.0)
        completed = F.coalesce(F.sum(F.when(status.isin(*COMPLETED), weight)), F.lit(0.0))
        missed = F.coalesce(F.sum(F.when(status.isin(*MISSED), weight)), F.lit(0.0))
        measures |= {"Completed Appointments": completed, "No-Shows": missed, "No-Show Rate": ratio(missed, F.sum(weight)) * 100}
    return _kpis(table, measures, {"No-Show Rate": 1})


def average_wait(table: DataFrame, roles: dict | None = None) -> DataFrame:
    roles = roles or roles_of(table.columns)
    return _kpis(table, {"Average Wait (days)": F.avg(number(roles["wait_time"]))})


def _bed_days(table: DataFrame, roles: dict) -> tuple[DataFrame, bool]:
    """Daily sums of the bed measures, or the rows themselves when nothing is dated."""
    measures = {m: number(roles[r]) for m, r in (("occupied", "occupied_beds"), ("total", "total_beds"), ("available", "available_beds")) if roles[r]}
    if not roles["date"]:
        return table.withColumns(measures), False
    dated = table.withColumn("day_", timestamp(roles["date"])).where("day_ IS NOT NULL")
    return dated.groupBy("day_").agg(*[F.sum(c).alias(m) for m, c in measures.items()]), True


def bed_kpis(table: DataFrame, roles: dict | None = None) -> DataFrame:
    """Mean daily capacity, occupied and available beds, and the busiest day.

    Departments of one day are summed before days are averaged.
    """
    roles = roles or roles_of(table.columns)
    days, _ = _bed_days(table, roles)
    present = {m for m, r in (("occupied", "occupied_beds"), ("total", "total_beds"), ("available", "available_beds")) if roles[r]}
    measures = {}
    for label, m in (("Average Bed Capacity", "total"), ("Average Occupied Beds", "occupied"), ("Average Available Beds", "available")):
        if m in present:
            measures[label] = F.avg(m)
    if "occupied" in present:
        measures["Peak Occupied Beds"] = F.max("occupied")
    return _kpis(days, measures)


def bed_available_derived(table: DataFrame, roles: dict | None = None) -> DataFrame:
    """Capacity minus occupancy, for tables without an availability column."""
    roles = roles or roles_of(table.columns)
    days, _ = _bed_days(table, roles)
    return _kpis(days, {"Average Available Beds (derived)": F.avg(F.col("total") - F.col("occupied"))})


def bed_occupancy(table: DataFrame, roles: dict | None = None) -> DataFrame:
    """Mean daily occupancy in percent; a stored rate is used only when no daily ratio can be formed."""
    roles = roles or roles_of(table.columns)
    days, dated = _bed_days(table, roles)
    label = "Average Occupancy" if roles["occupancy_rate"] else "Average Occupancy (derived)"
    if dated and roles["occupied_beds"] and roles["total_beds"]:
        return _kpis(days, {label: F.avg(F.when(F.col("total") > 0, F.col("occupied") / F.col("total") * 100))})
    rate = number(roles["occupancy_rate"])
    return _kpis(table, {label: F.avg(rate) * F.when(F.max(rate) <= 1, 100).otherwise(1)})


def equipment_kpis(table: DataFrame, roles: dict | None = None) -> DataFrame:
    roles = roles or roles_of(table.columns)
    key = roles["equipment_id"]
    measures = {"Equipment Records": F.count_distinct(key) if key else F.count(F.lit(1))}
    if roles["equipment_status"]:
        status = F.lower(F.col(roles["equipment_status"]).cast("string"))
        measures["Operational Equipment"] = count_where(status.rlike(OPERATIONAL))
    if roles["failure_count"]:
        measures["Recorded Equipment Failures"] = F.sum(number(roles["failure_count"]))
    elif roles["failure_event"]:
        measures["Recorded Equipment Failures"] = F.count(roles["failure_event"])
    return _kpis(table, measures)


def department_count(table: DataFrame, roles: dict | None = None) -> DataFrame:
    roles = roles or roles_of(table.columns)
    return _kpis(table, {"Departments": F.count_distinct(roles["department"])})


def record_count(table: DataFrame) -> DataFrame:
    return _kpis(table, {"Records": F.count(F.lit(1))})


def adaptive_kpis(table: DataFrame, roles: dict | None = None) -> DataFrame:
    """All KPIs the table's own column names allow."""
    roles = roles or roles_of(table.columns)
    modules = modules_of(table.columns)
    parts = []
    if "Admission Analytics" in modules:
        parts.append(admission_kpis(table, roles))
    if "Appointment Analytics" in modules:
        parts.append(appointment_kpis(table, roles))
        if roles["wait_time"]:
            parts.append(average_wait(table, roles))
    if "Bed & Capacity Analytics" in modules:
        parts.append(bed_kpis(table, roles))
        if roles["total_beds"] and roles["occupied_beds"] and not roles["available_beds"]:
            parts.append(bed_available_derived(table, roles))
        if roles["occupancy_rate"] or (roles["date"] and roles["total_beds"] and roles["occupied_beds"]):
            parts.append(bed_occupancy(table, roles))
    if "Equipment Analytics" in modules:
        parts.append(equipment_kpis(table, roles))
    if "Department Analytics" in modules and roles["department"]:
        parts.append(department_count(table, roles))
    return reduce(DataFrame.unionByName, parts) if parts else record_count(table)


def bed_summary(table: DataFrame, roles: dict | None = None) -> DataFrame:
    """The bed KPIs as one record, with the (at most twenty) busiest departments nested."""
    roles = roles or roles_of(table.columns)
    kpis = adaptive_kpis(table, roles)

    def first(*labels: str) -> Column:
        return F.coalesce(*[F.max(F.when(F.col("kpi") == label, F.col("value"))) for label in labels])

    record = kpis.agg(
        first("Average Bed Capacity").alias("total_beds"),
        first("Average Occupied Beds").alias("occupied_beds"),
        first("Average Available Beds", "Average Available Beds (derived)").alias("available_beds"),
        first("Average Occupancy", "Average Occupancy (derived)").alias("average_occupancy"),
        first("Peak Occupied Beds").alias("peak_occupied_beds"),
    )
    busiest = group_table(table, roles["department"], roles["occupied_beds"], "mean", "Average Occupied Beds by Department")
    nested = busiest.agg(F.sort_array(F.collect_list(F.struct("label", "value"))).alias("value")).scalar()
    return record.withColumn("department_occupancy", nested)
