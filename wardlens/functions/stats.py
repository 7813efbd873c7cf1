"""Exact order statistics and row numbers that no single task has to hold.

Percentiles read borders from a mergeable summary and count between them; row
numbers cut the ordered axis into buckets by a rule that depends only on the
data (minimum and maximum), so every branch of a plan, and every re-run of a
lost task, puts a row into the same bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions.scalars import lookup, number, scalar


def _axis(value: Column) -> Column:
    """Monotone compression, so long-tailed values still spread over the buckets."""
    return F.signum(value) * F.log1p(F.abs(value))


def _bucket(value: Column, low: Column, high: Column, buckets: int) -> Column:
    width = F.nullif(high - low, F.lit(0.0))
    share = F.coalesce((value - low) / width, F.lit(0.0))
    return F.when(low.isNotNull(), F.least(F.floor(share * buckets), F.lit(buckets - 1))).otherwise(0).cast("int")


#: Rank error of the summary that gives the borders, as a share of the rows: 1 / ACCURACY; borders lie MARGIN errors from a wanted rank.
ACCURACY, MARGIN = 20_000, 4


def long_values(frame: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, value)`` for the non-null values of several columns."""
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), number(c).alias("value")) for c in columns])
    return frame.select(F.explode(entries).alias("entry")).select("entry.*").where("value IS NOT NULL")


def exact_percentiles(frame: DataFrame, columns: list[str], shares: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """Linear-interpolated percentiles as ``(column_name, <one column per share>)``; columns without values have no row.

    A mergeable quantile summary (one pass, bounded state per task) gives two borders around every wanted rank. A second pass
    counts what lies below the lower border and collapses the values between both, so what is sorted is at most some
    ``2 * MARGIN / accuracy`` of the rows, and one row where a value is repeated. Outliers move no border and nothing is
    stored. A rank outside its borders, which the summary's guarantee excludes, stops the query.
    """
    long, margin = long_values(frame, columns), MARGIN / accuracy
    points = [min(max(p + side * margin, 0.0), 1.0) for p in shares.values() for side in (-1, 1)]
    spans = long.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("value", points, accuracy).alias("borders"))
    # One row per column, read by the second pass as a map, so the values are not shuffled to meet it.
    span = lookup(spans, "column_name", F.struct("n", "borders"))[F.col("column_name")]
    wanted = F.array(*[F.struct(F.lit(name).alias("share"), F.lit(2 * i).alias("at")) for i, name in enumerate(shares)])
    placed = long.withColumn("span", span).select("column_name", "value", "span", F.explode(wanted).alias("wanted"))
    low, high = F.get("span.borders", F.col("wanted.at")), F.get("span.borders", F.col("wanted.at") + 1)
    # Of the values below and above only the count and the nearest one go on: a rank may be one off the borders.
    zone = F.when(F.col("value") < low, -1).when(F.col("value") > high, 1).otherwise(0)
    between = (
        placed.select("column_name", "wanted.share", zone.alias("zone"), "value")
        .groupBy("column_name", "share", "zone", F.when(F.col("zone") == 0, F.col("value")).alias("inside"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    )
    order = Window.partitionBy("column_name", "share").orderBy("zone", "inside").rowsBetween(Window.unboundedPreceding, 0)
    total = span.getField("n")  # the same subquery again, so that it runs once
    probability = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("share")]
    ranked = between.withColumn("through", F.sum("n").over(order)).withColumn("position", probability * (total - 1))

    def holds(rank):
        here = (rank < F.col("through")) & (rank >= F.col("through") - F.col("n"))
        return here & ((F.col("zone") == 0) | ((F.col("zone") < 0) & (rank == F.col("through") - 1)) | ((F.col("zone") > 0) & (rank == F.col("through") - F.col("n"))))

    nearest = F.when(F.col("zone") < 0, F.col("most")).otherwise(F.col("least"))
    first, last = F.floor("position"), F.ceil("position")
    hits = ranked.groupBy("column_name", "share").agg(
        F.max(F.when(holds(first), nearest)).alias("first"), F.max(F.when(holds(last), nearest)).alias("last"), F.max(F.col("position") - first).alias("fraction")
    )
    missed = F.raise_error(F.lit("a percentile lies outside the borders of its summary")).cast("double")
    exact = hits.select("column_name", "share", F.coalesce(F.col("first") + (F.col("last") - F.col("first")) * F.col("fraction"), missed).alias("exact"))
    return exact.groupBy("column_name").agg(*[F.max(F.when(F.col("share") == name, F.col("exact"))).alias(name) for name in shares])


def medians(frame: DataFrame, columns: list[str]) -> DataFrame:
    """One row holding the exact median of each column, under the column's own name."""
    long = exact_percentiles(frame, columns, {"median": 0.5})
    return long.agg(*[F.max(F.when(F.col("column_name") == c, F.col("median"))).alias(c) for c in columns])


def fill_values(frame: DataFrame, one_row: DataFrame, columns: list[str]) -> DataFrame:
    """Replace NULLs by the values of a one-row frame, read once as a scalar subquery."""
    values = scalar(one_row, F.struct(*columns))
    return frame.withColumns({c: F.coalesce(F.col(c).cast("double"), values.getField(c)) for c in columns})


def row_numbers(
    frame: DataFrame, keys: list[str], order: list[str], axis: str | None = None, name: str = "row_number",
    hot_share: float = 0.001, hot_rows: int = 100_000, buckets: int = 64,
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` with large keys split.

    A key is large when it holds more than ``hot_share`` of all rows (and more
    than ``hot_rows``), so there are fewer than ``1 / hot_share`` of them and
    their tables may be broadcast. Their rows are numbered inside ranges of
    ``axis`` (default: the first order column; a numeric expression the order
    refines) and shifted by the count of the earlier ranges. Other keys are
    numbered in one piece.
    """
    axis_value = F.expr(axis or order[0]).cast("double")
    copies = [f"key_{i}_" for i in range(len(keys))]
    renamed = [F.col(k).alias(c) for k, c in zip(keys, copies, strict=True)]
    is_key = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(c)) for k, c in zip(keys, copies, strict=True)])

    per_key = frame.groupBy(*renamed).agg(F.count(F.lit(1)).alias("n_"), F.min(axis_value).alias("low_"), F.max(axis_value).alias("high_"))
    limit = F.greatest(scalar(per_key, F.sum("n_")) * F.lit(hot_share), F.lit(hot_rows))
    hot = F.broadcast(per_key.where(F.col("n_") > limit).drop("n_"))
    bucket = _bucket(axis_value, F.col("low_"), F.col("high_"), buckets).alias("bucket_")
    split = frame.join(hot, is_key, "left").select(*frame.columns, bucket)

    earlier = Window.partitionBy(*copies).orderBy("of_bucket_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        frame.join(hot, is_key)
        .groupBy(*copies, bucket.alias("of_bucket_"))
        .agg(F.count(F.lit(1)).alias("n_"))
        .withColumn("offset_", F.sum("n_").over(earlier))
        .where("offset_ > 0")
    )
    local = Window.partitionBy(*keys, "bucket_").orderBy(*order)
    in_range = is_key & (F.col("bucket_") == F.col("of_bucket_"))
    return split.join(F.broadcast(offsets), in_range, "left").select(
        *frame.columns, (F.row_number().over(local) + F.coalesce("offset_", F.lit(0))).alias(name)
    )
