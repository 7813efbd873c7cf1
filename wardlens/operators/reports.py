"""Standard operational reports.

Facts are reduced by ``department_id`` before the department names are joined,
so the join touches one row per department whatever the fact size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from wardlens.functions.scalars import count_where, ratio, scalar, share_of_total, strip

CANCELLED = ("cancelled", "canceled")
OPERATIONAL = ("operational", "active", "working", "in service")


def _named(partial: DataFrame, departments: DataFrame, *finals: Column) -> DataFrame:
    """Join per-id partials to names, then fold ids that share a name."""
    names = departments.select("department_id", "department_name")
    return partial.join(names, "department_id").groupBy("department_name").agg(*finals)


def _mean(total: str, n: str) -> Column:
    return F.round(ratio(F.sum(total), F.sum(n)), 2)


def admissions_by_department(admissions, departments) -> DataFrame:
    partial = admissions.groupBy("department_id").agg(F.count("admission_id").alias("n"))
    return _named(partial, departments, F.sum("n").alias("total_admissions")).orderBy(
        F.desc("total_admissions"), "department_name"
    )


def avg_los_by_department(admissions, departments) -> DataFrame:
    partial = admissions.groupBy("department_id").agg(
        F.sum("length_of_stay").alias("days"), F.count("length_of_stay").alias("n")
    )
    return _named(partial, departments, _mean("days", "n").alias("average_length_of_stay")).orderBy(
        F.desc("average_length_of_stay"), "department_name"
    )


def monthly_admissions(admissions) -> DataFrame:
    return (
        admissions.groupBy(F.date_format("admission_date", "yyyy-MM").alias("admission_month"))
        .agg(F.count("admission_id").alias("total_admissions"))
        .orderBy("admission_month")
    )


def status_summary(table: DataFrame, status: str, key: str, total: str) -> DataFrame:
    """Count per status and its percentage of all rows."""
    grouped = table.groupBy(status).agg(F.count(key).alias(total), F.count(F.lit(1)).alias("rows_"))
    share = F.round(ratio(F.col(total) * 100.0, share_of_total(grouped, "rows_")), 2)
    return grouped.select(status, total, share.alias("percentage")).orderBy(F.desc(total), status)


def wait_time_by_department(appointments, departments) -> DataFrame:
    partial = appointments.groupBy("department_id").agg(
        F.count("appointment_id").alias("n"),
        F.sum("wait_time_days").alias("days"),
        F.count("wait_time_days").alias("waits"),
    )
    return _named(
        partial, departments, F.sum("n").alias("total_appointments"), _mean("days", "waits").alias("average_wait_time")
    ).orderBy(F.desc("average_wait_time"), "department_name")


def no_show_rate_by_department(appointments, departments) -> DataFrame:
    partial = appointments.groupBy("department_id").agg(
        F.count("appointment_id").alias("n"), count_where(F.col("appointment_status") == "No-Show").alias("missed")
    )
    return _named(
        partial,
        departments,
        F.sum("n").alias("total_appointments"),
        F.sum("missed").alias("no_show_count"),
        F.round(ratio(F.sum("missed") * 100.0, F.sum("n")), 2).alias("no_show_rate"),
    ).orderBy(F.desc("no_show_rate"), "department_name")


def occupancy_by_department(beds, departments) -> DataFrame:
    partial = beds.groupBy("department_id").agg(
        F.sum("occupancy_rate").alias("rate"), F.count("occupancy_rate").alias("n")
    )
    return _named(partial, departments, _mean("rate", "n").alias("average_occupancy_rate")).orderBy(
        F.desc("average_occupancy_rate"), "department_name"
    )


def bed_usage_by_department(beds, departments) -> DataFrame:
    partial = beds.groupBy("department_id").agg(
        F.sum("occupied_beds").alias("occupied"),
        F.count("occupied_beds").alias("occupied_n"),
        F.sum("available_beds").alias("available"),
        F.count("available_beds").alias("available_n"),
    )
    return _named(
        partial,
        departments,
        _mean("occupied", "occupied_n").alias("average_occupied_beds"),
        _mean("available", "available_n").alias("average_available_beds"),
    ).orderBy(F.desc("average_occupied_beds"), "department_name")


def monthly_occupancy(beds) -> DataFrame:
    return (
        beds.groupBy(F.date_format("record_date", "yyyy-MM").alias("record_month"))
        .agg(F.round(F.avg("occupancy_rate"), 2).alias("average_occupancy_rate"))
        .orderBy("record_month")
    )


def failures_by_equipment_type(equipment) -> DataFrame:
    return (
        equipment.groupBy("equipment_type")
        .agg(
            F.count("equipment_id").alias("total_equipment"),
            F.sum("failure_count").alias("total_failures"),
            F.sum("maintenance_count").alias("total_maintenance"),
        )
        .orderBy(F.desc("total_failures"), "equipment_type")
    )


def equipment_by_department(equipment, departments) -> DataFrame:
    partial = equipment.groupBy("department_id").agg(
        F.count("equipment_id").alias("n"),
        F.sum("usage_hours").alias("hours"),
        F.count("usage_hours").alias("hours_n"),
        F.sum("failure_count").alias("failures"),
    )
    return _named(
        partial,
        departments,
        F.sum("n").alias("total_equipment"),
        _mean("hours", "hours_n").alias("average_usage_hours"),
        F.sum("failures").alias("total_failures"),
    ).orderBy(F.desc("total_failures"), "department_name")


def department_admission_rank(admissions, departments) -> DataFrame:
    totals = admissions.groupBy("department_id").agg(F.count("admission_id").alias("total_admissions"))
    # The window sees one row per department, never the facts.
    by_total = Window.orderBy(F.desc("total_admissions"))
    return (
        totals.join(departments.select("department_id", "department_name"), "department_id")
        .select("department_name", "total_admissions", F.rank().over(by_total).alias("admission_rank"))
        .orderBy("admission_rank", "department_name")
    )


def monthly_admission_change(admissions) -> DataFrame:
    months = Window.orderBy("admission_month")
    previous = F.lag("total_admissions").over(months)
    return (
        monthly_admissions(admissions)
        .withColumn("previous_month_admissions", previous)
        .withColumn("change_from_previous_month", F.col("total_admissions") - F.col("previous_month_admissions"))
        .orderBy("admission_month")
    )


def above_average_los_departments(admissions, departments) -> DataFrame:
    partial = admissions.groupBy("department_id").agg(
        F.sum("length_of_stay").alias("days"), F.count("length_of_stay").alias("n")
    )
    hospital = scalar(partial, ratio(F.sum("days"), F.sum("n")))
    return (
        partial.withColumn("average_los", ratio(F.col("days"), F.col("n")))
        .withColumn("hospital_los", hospital)
        .where("average_los > hospital_los")
        .join(departments.select("department_id", "department_name"), "department_id")
        .orderBy(F.desc("average_los"), "department_name")
        .select(
            "department_name",
            F.round("average_los", 2).alias("average_length_of_stay"),
            F.round("hospital_los", 2).alias("hospital_average_los"),
        )
    )


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [
        frame.agg(F.count(F.lit(1)).alias("total_rows")).select(F.lit(name).alias("table_name"), "total_rows")
        for name, frame in tables.items()
    ]
    result = counts[0]
    for part in counts[1:]:
        result = result.unionAll(part)
    return result


def orphan_count(table: DataFrame, departments: DataFrame, alias: str) -> DataFrame:
    """Rows whose department is missing from the master list.

    Ids are counted first, so a dominant department costs one row in the join.
    """
    ids = table.groupBy("department_id").agg(F.count(F.lit(1)).alias("n"))
    missing = ids.join(departments.select("department_id"), "department_id", "left_anti")
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(alias))


def hospital_avg_los(admissions) -> DataFrame:
    return admissions.agg(F.round(F.avg("length_of_stay"), 2).alias("average_length_of_stay"))


def avg_los_for_department(admissions, departments, department: str) -> DataFrame:
    """Mean stay of one department, matched without regard to case; the name is a bound parameter."""
    return admissions.sparkSession.sql(
        """SELECT ROUND(AVG(a.length_of_stay), 2) AS average_length_of_stay
           FROM {admissions} a JOIN {departments} d ON a.department_id = d.department_id
           WHERE LOWER(d.department_name) = LOWER(:department)""",
        args={"department": department},
        admissions=admissions,
        departments=departments,
    )


def cancelled_last_month(appointments, as_of: str) -> DataFrame:
    """Cancellations in the calendar month before ``as_of`` (half-open, so the filter reaches the scan)."""
    this_month = F.trunc(F.lit(as_of).cast("date"), "MM")
    in_month = (F.col("appointment_date") >= F.add_months(this_month, -1)) & (F.col("appointment_date") < this_month)
    status = F.lower(F.trim("appointment_status"))
    return appointments.where(in_month).agg(
        F.count("appointment_id").alias("appointment_records"),
        F.sum(F.when(status.isin(*CANCELLED), 1).otherwise(0)).alias("cancelled_appointments"),
    )


def occupied_beds_latest(beds) -> DataFrame:
    """Occupied beds on the newest record date: daily partial sums, then the last day."""
    daily = beds.groupBy("record_date").agg(F.sum("occupied_beds").alias("occupied"))
    return daily.where(F.col("record_date").isNotNull()).agg(
        F.max("record_date").alias("record_date"), F.max_by("occupied", "record_date").alias("occupied_beds")
    )


def operational_equipment_count(equipment) -> DataFrame:
    counts = equipment.groupBy("equipment_status").agg(F.count("equipment_id").alias("n"))
    status = F.lower(strip("equipment_status"))
    return counts.where(status.isin(*OPERATIONAL)).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("operational_equipment")
    )


def busiest_department(admissions, departments) -> DataFrame:
    return admissions_by_department(admissions, departments).limit(1)


def database_snapshot(admissions, appointments, beds, equipment, departments) -> DataFrame:
    """Headline KPIs and four category series as ``(kind, series, label, value)`` rows."""

    def series(frame, name, label, value, unknown=None):
        text = F.coalesce(F.col(label), F.lit(unknown)) if unknown else F.col(label)
        rows = frame.select(
            F.lit("chart").alias("kind"), F.lit(name).alias("series"), text.alias("label"), F.col(value).cast("double").alias("value")
        )
        return rows.where("label IS NOT NULL AND value IS NOT NULL")

    by_department = admissions_by_department(admissions, departments)
    kpi = lambda frame, label: frame.select(
        F.lit("kpi").alias("kind"), F.lit("kpi").alias("series"), F.lit(label).alias("label"), F.col("value").cast("double").alias("value")
    )
    total = by_department.agg(F.sum("total_admissions").alias("value"))
    mean = hospital_avg_los(admissions).withColumnRenamed("average_length_of_stay", "value")
    parts = [
        kpi(total, "Database admissions"),
        kpi(mean, "Average length of stay"),
        series(by_department, "admissions_by_department", "department_name", "total_admissions"),
        series(
            status_summary(appointments, "appointment_status", "appointment_id", "total_appointments"),
            "appointment_status", "appointment_status", "total_appointments", "Unknown",
        ),
        series(bed_usage_by_department(beds, departments), "occupied_beds_by_department", "department_name", "average_occupied_beds"),
        series(
            status_summary(equipment, "equipment_status", "equipment_id", "total_equipment"),
            "equipment_status", "equipment_status", "total_equipment", "Unknown",
        ),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
