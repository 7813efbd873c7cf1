"""Exploratory summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions.scalars import count_where, lookup, ratio, share_of_total
from wardlens.functions.stats import exact_percentiles, long_values

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def table_shapes(tables: dict[str, DataFrame]) -> DataFrame:
    return _union(
        [
            t.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"),
                "row_count",
                F.lit(len(t.columns)).alias("column_count"),
                F.lit(",".join(t.columns)).alias("column_names"),
            )
            for name, t in tables.items()
        ]
    )


def describe_numeric(table: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, range and exact quartiles per column; one pass for the moments, two for the quartiles."""
    moments = (
        long_values(table, columns)
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    )
    quartiles = exact_percentiles(table, columns, QUARTILES)
    return moments.join(quartiles, "column_name").select("column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def value_counts(table: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    source = table if keep_null else table.where(F.col(column).isNotNull())
    return (
        source.groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(column).alias("column_name"), "value", "n")
    )


def value_counts_many(table: DataFrame, columns: list[str], keep_null: bool = False) -> DataFrame:
    """Value counts of several categorical columns in one pass."""
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    long = table.select(F.explode(entries).alias("entry")).select("entry.*")
    return (long if keep_null else long.where("value IS NOT NULL")).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def _with_names(per_department: DataFrame, departments: DataFrame, *columns: str) -> DataFrame:
    return per_department.join(departments.select("department_id", *columns), "department_id", "left")


def department_admissions_named(admissions, departments) -> DataFrame:
    totals = admissions.groupBy("department_id").agg(
        F.count("admission_id").alias("total_admissions"), F.round(F.avg("length_of_stay"), 2).alias("average_length_of_stay")
    )
    return _with_names(totals, departments, "department_name", "department_type").select(
        "department_id", "department_name", "department_type", "total_admissions", "average_length_of_stay"
    )


def monthly_admissions_period(admissions) -> DataFrame:
    month = F.date_format(F.date_trunc("MONTH", "admission_date"), "yyyy-MM")
    return admissions.where("admission_date IS NOT NULL").groupBy(month.alias("admission_date")).agg(F.count(F.lit(1)).alias("total_admissions"))


def status_percentages(table: DataFrame, status: str) -> DataFrame:
    """Counts of present statuses, their share of all rows and of the non-null rows."""
    grouped = table.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    present = grouped.where(F.col(status).isNotNull())
    return present.select(
        status,
        "n",
        F.round(ratio(F.col("n"), share_of_total(grouped, "n")) * 100, 2).alias("percentage"),
        F.round(ratio(F.col("n"), share_of_total(present, "n")) * 100, 2).alias("percentage_of_known"),
    )


def department_wait(appointments, departments) -> DataFrame:
    totals = appointments.groupBy("department_id").agg(
        F.count("appointment_id").alias("total_appointments"), F.round(F.avg("wait_time_days"), 2).alias("average_wait_time")
    )
    return _with_names(totals, departments, "department_name").orderBy(F.desc("average_wait_time"), "department_id")


def department_no_show(appointments, departments) -> DataFrame:
    totals = appointments.groupBy("department_id").agg(
        F.count("appointment_id").alias("total_appointments"),
        count_where(F.col("appointment_status") == "No-Show").alias("no_show_count"),
    )
    rated = totals.withColumn("no_show_rate", F.round(ratio(F.col("no_show_count"), F.col("total_appointments")) * 100, 2))
    return _with_names(rated, departments, "department_name").orderBy(F.desc("no_show_rate"), "department_id")


def department_occupancy(beds, departments) -> DataFrame:
    means = beds.groupBy("department_id").agg(
        F.round(F.avg("occupancy_rate"), 2).alias("average_occupancy_rate"),
        F.round(F.avg("occupied_beds"), 2).alias("average_occupied_beds"),
        F.round(F.avg("available_beds"), 2).alias("average_available_beds"),
    )
    return _with_names(means, departments, "department_name").orderBy(F.desc("average_occupancy_rate"), "department_id")


def occupancy_scale_check(beds) -> DataFrame:
    """Range of the stored rate, and whether it reads as a fraction or a percentage."""
    return beds.agg(F.min("occupancy_rate").alias("minimum"), F.max("occupancy_rate").alias("maximum")).withColumn(
        "scale", F.when(F.col("maximum") <= 1, "fraction").otherwise("percent")
    )


def monthly_occupancy_period(beds) -> DataFrame:
    month = F.date_format(F.date_trunc("MONTH", "record_date"), "yyyy-MM")
    return beds.where("record_date IS NOT NULL").groupBy(month.alias("record_date")).agg(
        F.round(F.avg("occupancy_rate"), 2).alias("average_occupancy_rate")
    )


def equipment_type_analysis(equipment) -> DataFrame:
    return (
        equipment.where("equipment_type IS NOT NULL")
        .groupBy("equipment_type")
        .agg(
            F.count("equipment_id").alias("total_equipment"),
            F.sum("failure_count").alias("total_failures"),
            F.sum("maintenance_count").alias("total_maintenance"),
            F.round(F.avg("usage_hours"), 2).alias("average_usage_hours"),
            F.round(ratio(F.sum("failure_count"), F.count("equipment_id")), 2).alias("failure_rate"),
        )
        .orderBy(F.desc("total_failures"), "equipment_type")
    )


def paired_means(equipment, x: str, y: str) -> DataFrame:
    return equipment.where("equipment_type IS NOT NULL").groupBy("equipment_type").agg(
        F.round(F.avg(x), 2).alias(f"average_{x}"), F.round(F.avg(y), 2).alias(f"average_{y}")
    )


def correlation(table: DataFrame, x: str, y: str) -> DataFrame:
    return table.agg(F.round(F.corr(F.col(x).cast("double"), F.col(y).cast("double")), 6).alias("correlation")).select(
        F.lit(x).alias("x"), F.lit(y).alias("y"), "correlation"
    )


def department_activity(admissions, appointments, departments) -> DataFrame:
    admitted = admissions.groupBy("department_id").agg(F.count("admission_id").alias("total_admissions"))
    booked = appointments.groupBy("department_id").agg(F.count("appointment_id").alias("total_appointments"))
    return _with_names(admitted.join(booked, "department_id", "full"), departments, "department_name").select(
        "department_id", "department_name", "total_admissions", "total_appointments"
    )


def integer_distribution(table: DataFrame, column: str) -> DataFrame:
    return value_counts(table, column).orderBy("value")


def daily_bed_demand(beds) -> DataFrame:
    return beds.groupBy("record_date").agg(
        F.sum("occupied_beds").alias("total_occupied_beds"), F.sum("available_beds").alias("total_available_beds")
    )


def daily_bed_demand_summary(beds) -> DataFrame:
    """Describe the daily sums; the date range and day count ride along."""
    daily = daily_bed_demand(beds)
    columns = ["total_occupied_beds", "total_available_beds"]
    span = daily.agg(F.min("record_date").alias("first_day"), F.max("record_date").alias("last_day"), F.count("record_date").alias("days"))
    values = span.select(F.struct("*").alias("value")).scalar()
    return describe_numeric(daily, columns).select(
        "*",
        values.getField("first_day").alias("first_day"),
        values.getField("last_day").alias("last_day"),
        values.getField("days").alias("days"),
    )


