"""Feature building, splits and class weights.

Lag windows run over months or days, after the facts are reduced to one row per
period; pass ``keys`` to build one series per department or other group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions.scalars import lookup, scalar
from wardlens.functions.stats import fill_values, medians

SPLIT_SEED = "42"


def monthly_series(table: DataFrame, date: str, value: str = "admissions") -> DataFrame:
    """Rows per month start from first to last month, empty months as zero."""
    months = (
        table.where(F.col(date).isNotNull()).groupBy(F.trunc(date, "MM").alias("month_start")).agg(F.count(F.lit(1)).alias(value))
    )
    calendar = months.agg(F.sequence(F.min("month_start"), F.max("month_start"), F.expr("INTERVAL 1 MONTH")).alias("all")).select(
        F.explode("all").alias("month_start")
    )
    return calendar.join(months, "month_start", "left").select("month_start", F.coalesce(value, F.lit(0)).alias(value))


def _series(keys: list[str] | None, order: str):
    return Window.partitionBy(*(keys or [])).orderBy(order)


def monthly_lags(series: DataFrame, value: str = "admissions", keys: list[str] | None = None) -> DataFrame:
    over = _series(keys, "month_start")
    return series.select(
        *(keys or []),
        "month_start",
        (F.row_number().over(over) - 1).alias("time_index"),
        F.year("month_start").alias("year"),
        F.month("month_start").alias("month"),
        value,
        *[F.lag(value, k).over(over).alias(f"lag_{k}") for k in (1, 2, 3)],
    )


def monthly_lag_features(series: DataFrame, value: str = "admissions", keys: list[str] | None = None) -> DataFrame:
    """Complete rows only; the index counts from before the incomplete ones are dropped."""
    return monthly_lags(series, value, keys).where("lag_3 IS NOT NULL")


def next_month_row(series: DataFrame, value: str = "admissions") -> DataFrame:
    """The feature row of the month after the last; no row with fewer than three months."""
    following = F.add_months("month_start", 1)
    last = monthly_lags(series, value).orderBy(F.desc("month_start")).limit(1).where("lag_2 IS NOT NULL")
    return last.select(
        following.alias("month_start"),
        (F.col("time_index") + 1).alias("time_index"),
        F.year(following).alias("year"),
        F.month(following).alias("month"),
        F.col(value).cast("double").alias("lag_1"),
        F.col("lag_1").cast("double").alias("lag_2"),
        F.col("lag_2").cast("double").alias("lag_3"),
    )


def daily_totals(beds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    complete = beds.where("record_date IS NOT NULL AND occupied_beds IS NOT NULL")
    return complete.groupBy(*(keys or []), "record_date").agg(F.sum("occupied_beds").alias("occupied_beds"))


def calendar_features(date: str | Column) -> list[Column]:
    return [F.weekday(date).alias("dayofweek"), F.month(date).alias("month"), F.dayofyear(date).alias("dayofyear")]


def daily_lag_features(beds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Lags count recorded days, not calendar days."""
    over = _series(keys, "record_date")
    return (
        daily_totals(beds, keys)
        .select(
            *(keys or []),
            "record_date",
            (F.row_number().over(over) - 1).alias("time_index"),
            *calendar_features("record_date"),
            "occupied_beds",
            *[F.lag("occupied_beds", k).over(over).alias(f"lag_{k}") for k in (1, 7, 30)],
        )
        .where("lag_30 IS NOT NULL")
    )


def equipment_features(equipment: DataFrame, as_of: str | None = None) -> DataFrame:
    """Age and days to maintenance, against the newest installation (training) or ``as_of`` (scoring)."""
    reference = F.lit(as_of).cast("date") if as_of else scalar(equipment, F.max("installation_date"))
    return equipment.select(
        "equipment_id",
        "department_id",
        "equipment_type",
        F.date_diff(reference, F.col("installation_date")).alias("equipment_age_days"),
        F.date_diff(F.col("next_maintenance_date"), reference).alias("days_until_next_maintenance"),
        "usage_hours",
        "maintenance_count",
        (F.coalesce("failure_count", F.lit(0)) > 0).cast("int").alias("failure_risk"),
    )


def equipment_impute(features: DataFrame) -> DataFrame:
    columns = ["equipment_age_days", "usage_hours", "maintenance_count"]
    filled = fill_values(features, medians(features, columns), columns)
    return filled.withColumns(
        {
            "days_until_next_maintenance": F.coalesce("days_until_next_maintenance", F.lit(0)),
            "department_id": F.coalesce(F.col("department_id").cast("string"), F.lit("Unknown")),
            "equipment_type": F.coalesce("equipment_type", F.lit("Unknown")),
        }
    )


def no_show_features(appointments: DataFrame) -> DataFrame:
    lead = F.date_diff("appointment_date", "booking_date")
    group = (
        F.when(lead <= -1, None).when(lead <= 2, "Very Short").when(lead <= 7, "Short").when(lead <= 14, "Medium").when(lead > 14, "Long")
    )
    return appointments.select(
        "appointment_id",
        "department_id",
        "appointment_type",
        group.alias("booking_lead_group"),
        "wait_time_days",
        lead.alias("booking_lead_days"),
        F.weekday("appointment_date").alias("appointment_dayofweek"),
        F.month("appointment_date").alias("appointment_month"),
        F.coalesce((F.col("appointment_status") == "No-Show").cast("int"), F.lit(0)).alias("no_show"),
    )


def los_features(admissions: DataFrame) -> DataFrame:
    return admissions.select(
        "admission_id",
        "department_id",
        "admission_type",
        "age",
        "gender",
        "bed_type",
        F.weekday("admission_date").alias("admission_dayofweek"),
        F.month("admission_date").alias("admission_month"),
        "length_of_stay",
    )


def modes(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value per column, the smallest on a tie, from counted values."""
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = (
        frame.select(F.explode(entries).alias("e"))
        .select("e.*")
        .where("value IS NOT NULL")
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("column_name").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("best"))
    return best.select("column_name", F.col("best.value").alias("value"))


def imputation_values(frame: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """``(column_name, number, text)``: medians of the numeric columns, modes of the categorical ones."""
    middle = medians(frame, numeric)
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("number")) for c in numeric])
    numbers = middle.select(F.explode(entries).alias("e")).select("e.column_name", "e.number", F.lit(None).cast("string").alias("text"))
    texts = modes(frame, categorical).select("column_name", F.lit(None).cast("double").alias("number"), F.col("value").alias("text"))
    return numbers.unionByName(texts)


def split_hash(key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{SPLIT_SEED}-"), F.col(key).cast("string")))


def stratified_split(frame: DataFrame, key: str, label: str | None = None, share: float = 0.8) -> DataFrame:
    """Adds ``is_train``: the first ``share`` of each label's rows in hash order.

    A label may hold half of all rows, so they are never ranked together. Hash
    prefixes are counted, only the prefix that holds the cut is ranked, and the
    cut is then a comparison per row: the data itself is not shuffled.
    """
    stratum = F.col(label).cast("string") if label else F.lit("all")
    hashed = frame.select(stratum.alias("stratum"), split_hash(key).alias("hash")).where("stratum IS NOT NULL")
    hashed = hashed.withColumn("prefix", F.substring("hash", 1, 3))
    counts = hashed.groupBy("stratum", "prefix").agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.partitionBy("stratum").orderBy("prefix")
    marks = (
        counts.withColumn("through", F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("target", F.floor(F.lit(share) * F.sum("n").over(Window.partitionBy("stratum"))))
        .where("target > through - n AND target <= through")
        .select("stratum", "prefix", (F.col("target") - F.col("through") + F.col("n")).alias("rank"))
    )
    mark = lookup(marks, "stratum", F.struct("prefix", "rank"))[F.col("stratum")]
    within = Window.partitionBy("stratum").orderBy("hash")
    cuts = (
        hashed.withColumn("mark", mark)
        .where("prefix = mark.prefix")
        .withColumn("position", F.row_number().over(within))
        .where("position = mark.rank")
    )
    cut = lookup(cuts, "stratum", F.col("hash"))
    # A row without a stratum is in neither part.
    return frame.withColumn("is_train", F.when(stratum.isNotNull(), F.coalesce(split_hash(key) <= cut[stratum], F.lit(False))))


def time_split(periods: DataFrame, order: str, share: float = 0.8) -> DataFrame:
    """Adds ``is_train`` to a series already reduced to one row per period."""
    position = F.row_number().over(Window.orderBy(order))
    total = F.count(F.lit(1)).over(Window.partitionBy())
    return periods.withColumn("is_train", position <= F.floor(total * share))


def balanced_weights(frame: DataFrame, label: str) -> DataFrame:
    """Adds ``weight`` = rows / (classes x rows of the class); the class table is a scalar map."""
    classes = frame.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n")).where("class IS NOT NULL")
    totals = classes.select("class", "n", F.sum("n").over(Window.partitionBy()).alias("rows"), F.count(F.lit(1)).over(Window.partitionBy()).alias("kinds"))
    weight = F.col("rows").cast("double") / (F.col("kinds") * F.col("n"))
    return frame.withColumn("weight", lookup(totals, "class", weight)[F.col(label)])
