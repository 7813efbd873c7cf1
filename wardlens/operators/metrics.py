"""Model quality from a ``(label, prediction)`` table: one aggregate each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions.scalars import count_where, ratio, scalar


def _or_zero(value):
    return F.coalesce(value, F.lit(0.0))


def classification_metrics(frame: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class; zero where undefined."""
    actual, said = F.col(label) == 1, F.col(prediction) == 1
    one = frame.agg(
        F.count(F.lit(1)).alias("n"),
        count_where(F.col(label) == F.col(prediction)).alias("right"),
        count_where(actual & said).alias("tp"),
        count_where(said).alias("positive"),
        count_where(actual).alias("support"),
    )
    precision = _or_zero(ratio(F.col("tp"), F.col("positive")))
    recall = _or_zero(ratio(F.col("tp"), F.col("support")))
    return one.select(
        ratio(F.col("right"), F.col("n")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _or_zero(ratio(2 * F.col("tp"), F.col("positive") + F.col("support"))).alias("f1"),
    )


def confusion_counts(frame: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return frame.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(frame: DataFrame, label: str = "label", prediction: str = "prediction", classes=(0, 1)) -> DataFrame:
    counts = confusion_counts(frame, label, prediction)
    pivoted = counts.groupBy("label").pivot("prediction", list(classes)).agg(F.sum("n"))
    return pivoted.select("label", *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"predicted_{c}") for c in classes])


def classification_report(frame: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted means."""
    counts = confusion_counts(frame, label, prediction)
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero)
    side = lambda c, support, said, tp: F.struct(F.col(c).alias("class"), support.alias("support"), said.alias("said"), tp.alias("tp"))
    sides = F.array(side("label", F.col("n"), zero, hit), side("prediction", zero, F.col("n"), zero))
    per_class = (
        counts.select(F.explode(sides).alias("s"))
        .groupBy(F.col("s.class").cast("string").alias("class"))
        .agg(F.sum("s.support").alias("support"), F.sum("s.said").alias("said"), F.sum("s.tp").alias("tp"))
        .select(
            "class",
            _or_zero(ratio(F.col("tp"), F.col("said"))).alias("precision"),
            _or_zero(ratio(F.col("tp"), F.col("support"))).alias("recall"),
            _or_zero(ratio(2 * F.col("tp"), F.col("said") + F.col("support"))).alias("f1"),
            "support",
        )
    )
    scores = ("precision", "recall", "f1")
    macro = per_class.agg(*[F.avg(s).alias(s) for s in scores], F.sum("support").alias("support"))
    weighted = per_class.agg(*[(F.sum(F.col(s) * F.col("support")) / F.sum("support")).alias(s) for s in scores], F.sum("support").alias("support"))
    named = lambda frame, name: frame.select(F.lit(name).alias("class"), *scores, "support")
    return per_class.unionByName(named(macro, "macro avg")).unionByName(named(weighted, "weighted avg"))


def regression_metrics(frame: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """MAE, RMSE and R squared; the mean is taken first so the total variation does not cancel."""
    y, guess = F.col(label).cast("double"), F.col(prediction).cast("double")
    mean = scalar(frame, F.avg(y))
    residual, spread = F.sum((y - guess) * (y - guess)), F.sum((y - F.col("mean")) * (y - F.col("mean")))
    return frame.withColumn("mean", mean).agg(
        F.avg(F.abs(y - guess)).alias("mae"),
        F.sqrt(residual / F.count(F.lit(1))).alias("rmse"),
        (1 - ratio(residual, spread)).alias("r2"),
    )


def department_mean_baseline(admissions: DataFrame) -> DataFrame:
    """Each stay with its department's mean as the prediction (means come back as a small join)."""
    means = admissions.groupBy("department_id").agg(F.avg("length_of_stay").alias("prediction"))
    return admissions.select("department_id", F.col("length_of_stay").alias("label")).join(means, "department_id").select("label", "prediction")


