"""Validation and cleaning. One aggregate per table, whatever the number of rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions.scalars import col, count_where, ratio, stack, timestamp
from wardlens.functions.stats import fill_values, medians


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def missing_counts(table: DataFrame, name: str) -> DataFrame:
    """NULLs per column with their share of the rows."""
    one = table.agg(F.count(F.lit(1)).alias("rows_"), *[count_where(F.col(c).isNull()).alias(c) for c in table.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in table.columns])
    return one.select("rows_", F.explode(entries).alias("entry")).select(
        F.lit(name).alias("table_name"),
        "entry.column_name",
        F.col("entry.missing").alias("missing_count"),
        F.round(ratio(F.col("entry.missing"), F.col("rows_")) * 100, 2).alias("missing_percent"),
    )


def missing_percent(tables: dict[str, DataFrame]) -> DataFrame:
    """Only the columns that miss something, over several tables."""
    return _union([missing_counts(t, n) for n, t in tables.items()]).where("missing_count > 0")


def remaining_missing(tables: dict[str, DataFrame]) -> DataFrame:
    return missing_percent(tables).select("table_name", "column_name", "missing_count")


def repeats_of(table: DataFrame) -> DataFrame:
    """One row: how many rows equal an earlier one. Equal rows collapse in each task before the shuffle."""
    copies = table.groupBy(*table.columns).agg(F.count(F.lit(1)).alias("n_"))
    return copies.agg(F.coalesce(F.sum(F.col("n_") - 1), F.lit(0)).alias("duplicate_rows"))


def duplicate_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows equal to an earlier row of the same table."""
    return _union([repeats_of(table).select(F.lit(name).alias("table_name"), "duplicate_rows") for name, table in tables.items()])


def column_types(tables: dict[str, DataFrame]) -> DataFrame:
    """Type per column, with the number of non-null values that carry it."""
    parts = []
    for name, table in tables.items():
        one = table.agg(*[F.count(c).alias(c) for c in table.columns])
        entries = F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("data_type"), F.col(c).alias("values_present"))
                for c, kind in table.dtypes
            ]
        )
        parts.append(one.select(F.explode(entries).alias("e")).select(F.lit(name).alias("table_name"), "e.*"))
    return _union(parts)


def date_ranges(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Earliest and latest value of each date column, unparseable values ignored."""
    parts = []
    for name, (table, columns) in tables.items():
        one = table.agg(
            *[F.min(timestamp(c)).alias(f"{c}_low") for c in columns], *[F.max(timestamp(c)).alias(f"{c}_high") for c in columns]
        )
        entries = F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.col(f"{c}_low").cast("date").alias("earliest"),
                    F.col(f"{c}_high").cast("date").alias("latest"),
                )
                for c in columns
            ]
        )
        parts.append(one.select(F.explode(entries).alias("e")).select(F.lit(name).alias("table_name"), "e.*"))
    return _union(parts)


def violations(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule, all rules in one pass: ``(rule, violations)``."""
    one = table.agg(*[count_where(condition).alias(rule) for rule, condition in rules.items()])
    return stack(one, [(rule, F.col(rule)) for rule in rules], "rule", "violations", "bigint")


def _differs(left: Column, right: Column) -> Column:
    """Inequality where a missing side counts as different."""
    return F.coalesce(left != right, F.lit(True))


def admission_rules() -> dict[str, Column]:
    stay = F.date_diff("discharge_date", "admission_date")
    return {
        "discharge_before_admission": F.col("discharge_date") < F.col("admission_date"),
        "los_mismatch": _differs(F.col("length_of_stay"), stay),
    }


def appointment_rules() -> dict[str, Column]:
    return {"booking_after_appointment": F.col("booking_date") > F.col("appointment_date")}


def bed_rules(scale: float = 1.0) -> dict[str, Column]:
    """``scale`` is 1 when the stored rate is a fraction and 100 when it is a percentage."""
    expected = ratio(F.col("occupied_beds"), F.col("total_beds"))
    return {
        "occupied_over_total": F.col("occupied_beds") > F.col("total_beds"),
        "available_mismatch": _differs(F.col("available_beds"), F.col("total_beds") - F.col("occupied_beds")),
        "occupancy_rate_mismatch": F.abs(F.col("occupancy_rate") / scale - expected) > 0.01,
    }


def equipment_rules() -> dict[str, Column]:
    return {
        "maintenance_before_installation": F.col("last_maintenance_date") < F.col("installation_date"),
        "next_before_last_maintenance": F.col("next_maintenance_date") < F.col("last_maintenance_date"),
    }


def invalid_department_refs(tables: dict[str, DataFrame], departments: DataFrame) -> DataFrame:
    """Rows whose department is not in the master list; a NULL department is invalid too.

    The ids of all tables are counted together and joined once.
    """
    ids = _union(
        [
            t.groupBy("department_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "department_id", "n")
            for name, t in tables.items()
        ]
    )
    known = departments.select("department_id", F.lit(True).alias("known")).distinct()
    return (
        ids.join(known, "department_id", "left")
        .groupBy("table_name")
        .agg(F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).alias("violations"))
        .select("table_name", F.lit("invalid_department").alias("rule"), "violations")
    )


def patient_overlap(admissions: DataFrame, appointments: DataFrame) -> DataFrame:
    """Distinct patients per table, in both, and in appointments only, from one shuffle on the patient."""
    flagged = admissions.select("patient_id", F.lit(1).alias("admitted"), F.lit(0).alias("booked")).unionAll(
        appointments.select("patient_id", F.lit(0), F.lit(1))
    )
    patients = flagged.groupBy("patient_id").agg(F.max("admitted").alias("admitted"), F.max("booked").alias("booked"))
    both = F.col("admitted") * F.col("booked")
    return patients.agg(
        F.sum("booked").alias("appointment_patients"),
        F.sum("admitted").alias("admission_patients"),
        F.sum(F.col("booked") - both).alias("appointment_only_patients"),
        F.sum(both).alias("patients_in_both"),
        F.round(ratio(F.sum(both), F.sum("admitted")) * 100, 2).alias("percent_of_admission_patients"),
    )


def median_imputation_values(admissions: DataFrame, appointments: DataFrame) -> DataFrame:
    age = medians(admissions, ["age"]).select(F.lit("age").alias("column_name"), F.col("age").alias("median"))
    wait = medians(appointments, ["wait_time_days"]).select(
        F.lit("wait_time_days").alias("column_name"), F.col("wait_time_days").alias("median")
    )
    return age.unionByName(wait)


def fill_missing(table: DataFrame, numeric: dict[str, float | None], categorical: list[str]) -> DataFrame:
    """Numbers take the given constant, or the column's own median when it is None; text takes ``Unknown``."""
    computed = [c for c, constant in numeric.items() if constant is None]
    filled = fill_values(table, medians(table, computed), computed) if computed else table
    constants = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in numeric.items() if v is not None}
    texts = {c: F.coalesce(F.col(c), F.lit("Unknown")) for c in categorical}
    return filled.withColumns({**constants, **texts})


def joint_missing(equipment: DataFrame, first: str = "last_maintenance_date", second: str = "next_maintenance_date") -> DataFrame:
    one, two = F.col(first).isNull(), F.col(second).isNull()
    return equipment.agg(
        count_where(one).alias("missing_last_maintenance"),
        count_where(two).alias("missing_next_maintenance"),
        count_where(one & two).alias("missing_both"),
    )


def coerce_dates_keep_null(table: DataFrame, columns: list[str]) -> DataFrame:
    """Parse to dates; what does not parse stays NULL and is never invented."""
    return table.withColumns({c: timestamp(col(c)).cast("date") for c in columns})


def table_report(table: DataFrame, name: str, rules: dict[str, Column], departments: DataFrame) -> DataFrame:
    """All rules of one table and its department references from a single scan.

    Rules are counted per department id, so the references join a short list.
    """
    counted = table.groupBy("department_id").agg(
        F.count(F.lit(1)).alias("rows_"), *[count_where(condition).alias(rule) for rule, condition in rules.items()]
    )
    known = departments.select("department_id", F.lit(True).alias("known")).distinct()
    one = counted.join(known, "department_id", "left").agg(
        *[F.sum(rule).alias(rule) for rule in rules],
        F.sum(F.when(F.col("known"), 0).otherwise(F.col("rows_"))).alias("invalid_department"),
    )
    rows = stack(one, [(rule, F.coalesce(rule, F.lit(0))) for rule in (*rules, "invalid_department")], "rule", "violations", "bigint")
    return rows.select(F.lit(name).alias("table_name"), "rule", "violations")


def validation_report(admissions, appointments, beds, equipment, departments, scale: float = 1.0) -> DataFrame:
    checks = {
        "admissions": (admissions, admission_rules()),
        "appointments": (appointments, appointment_rules()),
        "beds": (beds, bed_rules(scale)),
        "equipment": (equipment, equipment_rules()),
    }
    return _union([table_report(table, name, rules, departments) for name, (table, rules) in checks.items()])
