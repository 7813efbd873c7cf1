"""Random-forest models: training, scoring, forecasting and their status."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions.roles import MODEL_FEATURES
from wardlens.operators import catalog as schema
from wardlens.operators import growth
from wardlens.operators.features import (
    balanced_weights,
    calendar_features,
    daily_lag_features,
    daily_totals,
    equipment_features,
    equipment_impute,
    imputation_values,
    los_features,
    monthly_lag_features,
    monthly_series,
    next_month_row,
    no_show_features,
    stratified_split,
    time_split,
)
from wardlens.session import stored

SEED = 42
EQUIPMENT_FEATURES = (["equipment_age_days", "days_until_next_maintenance", "usage_hours", "maintenance_count"], ["department_id", "equipment_type"])
NO_SHOW_FEATURES = (
    ["wait_time_days", "booking_lead_days", "appointment_dayofweek", "appointment_month"],
    ["department_id", "appointment_type", "booking_lead_group"],
)
LOS_FEATURES = (["age", "admission_dayofweek", "admission_month"], ["department_id", "admission_type", "gender", "bed_type"])
MONTH_FEATURES = (["time_index", "year", "month", "lag_1", "lag_2", "lag_3"], [])
DAY_FEATURES = (["time_index", "dayofweek", "month", "dayofyear", "lag_1", "lag_7", "lag_30"], [])
FORECAST_DAYS, HISTORY_DAYS = 7, 30
DEEPEST = 30  # the deepest tree Spark grows
ROWS_A_TASK = 50_000  # fewer rows cost less than the statistics of one more task


def preprocessing(train: DataFrame, numeric: list[str], categorical: list[str]) -> list:
    """Pipeline stages: median and most-frequent filling, one-hot codes, one vector.

    The fill values (one per column) are fitted on the training rows and kept
    inside the saved pipeline.
    """
    values = {r["column_name"]: r for r in imputation_values(train, numeric, categorical).collect()} if categorical else {}

    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    filled = []
    for c in numeric:
        default = values[c]["number"] if c in values and values[c]["number"] is not None else 0.0
        filled.append(f"COALESCE(CAST({c} AS DOUBLE), {default!r}D) AS {c}_filled")
    for c in categorical:
        default = values[c]["text"] if c in values else "Unknown"
        filled.append(f"COALESCE(CAST({c} AS STRING), {quoted(default)}) AS {c}_filled")
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")]
    inputs = [f"{c}_filled" for c in numeric]
    if categorical:
        indexed, coded = [f"{c}_index" for c in categorical], [f"{c}_code" for c in categorical]
        stages.append(StringIndexer(inputCols=[f"{c}_filled" for c in categorical], outputCols=indexed, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=coded, handleInvalid="keep"))
        inputs += coded
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return stages


def encode(frame: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Adds the model's feature vector.

    The rows are stored once: the fill values, the codes and the result all read them.
    """
    frame = stored(frame, "features")
    return Pipeline(stages=preprocessing(frame, numeric, categorical)).fit(frame).transform(frame)


def gathered(held: DataFrame) -> DataFrame:
    """Rows that many passes read, in as many partitions as they fill, at most one per core.

    Every task of a forest's pass makes and sends the statistics of all nodes of a level, however few rows it has.
    """
    cores, parts = held.sparkSession.sparkContext.defaultParallelism, held.rdd.getNumPartitions()
    wanted = max(min(cores, -(-held.count() // ROWS_A_TASK)), 1)
    return held.coalesce(wanted) if wanted <= parts else held.repartition(wanted)


def fit_forest(train: DataFrame, features: tuple[list[str], list[str]], estimator) -> PipelineModel:
    """Fit on rows held once in memory or on executor disk for the passes a forest makes."""
    numeric, categorical = features
    needed = [*numeric, *categorical, estimator.getLabelCol()]
    if estimator.isDefined("weightCol") and estimator.isSet("weightCol"):
        needed.append(estimator.getWeightCol())
    held = train.select(*needed).persist()
    try:
        return Pipeline(stages=[*preprocessing(held, numeric, categorical), estimator]).fit(gathered(held))
    finally:
        held.unpersist()


def classifier(label: str, trees: int = 100, depth: int = DEEPEST) -> RandomForestClassifier:
    """Balanced forest, as deep as the library allows unless a caller wants shallower trees.

    Each row keeps its node in every tree between levels: without that, every task of every level is sent the whole forest.
    """
    return RandomForestClassifier(
        labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=SEED, maxMemoryInMB=512, cacheNodeIds=True
    )


def regressor(label: str, trees: int, depth: int, leaf: int = 1) -> RandomForestRegressor:
    return RandomForestRegressor(
        labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="all", seed=SEED, maxMemoryInMB=512,
        cacheNodeIds=True,
    )


def grow_forest(train: DataFrame, features: tuple[list[str], list[str]], label: str, weight: str | None = None, trees: int = 100, depth: int = DEEPEST, leaf: int = 1, classes: int = 0) -> PipelineModel:
    """Like ``fit_forest``, but tasks grow the trees and neither rows nor nodes pass the driver: for models that grow with their rows.

    Classes look at a random square root of the places of the vector at each node, numbers at all of them.
    """
    numeric, categorical = features
    prepared = Pipeline(stages=preprocessing(train, numeric, categorical)).fit(train)
    kinds = [len(labels) + 1 for s in prepared.stages if isinstance(s, StringIndexerModel) for labels in s.labelsArray]
    rules = growth.Rules(trees, depth, leaf, classes, 0 if classes else len(numeric) + sum(kinds), SEED)
    return PipelineModel([*prepared.stages, growth.fit(prepared.transform(train), numeric, categorical, kinds, rules, label, weight)])


def _train_and_test(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both parts of rows stored once: each part else joins the facts and finds the cut again."""
    frame = stored(frame, "split")
    return frame.where("is_train"), frame.where("NOT is_train")


def equipment_failure_model(equipment: DataFrame, trees: int = 100, depth: int = DEEPEST) -> tuple[PipelineModel, DataFrame]:
    """Model and its predictions on the held-out fifth."""
    rows = stratified_split(equipment_impute(stored(equipment_features(equipment), "units")), "equipment_id", "failure_risk")
    train, test = _train_and_test(rows)
    model = grow_forest(balanced_weights(train, "failure_risk"), EQUIPMENT_FEATURES, "failure_risk", "weight", trees, depth, classes=2)
    return model, model.transform(test).select("equipment_id", F.col("failure_risk").alias("label"), F.col("prediction").cast("int").alias("prediction"))


def no_show_model(appointments: DataFrame, trees: int = 100, depth: int = DEEPEST) -> tuple[PipelineModel, DataFrame]:
    rows = stratified_split(stored(no_show_features(appointments), "appointments"), "appointment_id", "no_show")
    train, test = _train_and_test(rows)
    model = grow_forest(balanced_weights(train, "no_show"), NO_SHOW_FEATURES, "no_show", "weight", trees, depth, classes=2)
    return model, model.transform(test).select("appointment_id", F.col("no_show").alias("label"), F.col("prediction").cast("int").alias("prediction"))


def los_model(admissions: DataFrame, trees: int = 30, depth: int = 12, leaf: int = 3) -> tuple[PipelineModel, DataFrame]:
    rows = stratified_split(stored(los_features(admissions), "admissions"), "admission_id")
    train, test = _train_and_test(rows)
    model = grow_forest(train, LOS_FEATURES, "length_of_stay", trees=trees, depth=depth, leaf=leaf)
    return model, model.transform(test).select("admission_id", F.col("length_of_stay").alias("label"), "prediction")


def admission_demand_model(admissions: DataFrame, trees: int = 100, depth: int = 10) -> tuple[PipelineModel, DataFrame]:
    rows = time_split(monthly_lag_features(monthly_series(admissions, "admission_date")), "month_start")
    train, test = _train_and_test(rows)
    model = fit_forest(train, MONTH_FEATURES, regressor("admissions", trees, depth))
    return model, model.transform(test).select(F.col("month_start").alias("date"), F.col("admissions").alias("label"), "prediction")


def bed_demand_model(beds: DataFrame, trees: int = 100, depth: int = 12) -> tuple[PipelineModel, DataFrame]:
    rows = time_split(daily_lag_features(beds), "record_date")
    train, test = _train_and_test(rows)
    model = fit_forest(train, DAY_FEATURES, regressor("occupied_beds", trees, depth))
    return model, model.transform(test).select(F.col("record_date").alias("date"), F.col("occupied_beds").alias("label"), "prediction")


def actual_vs_predicted(predictions: DataFrame) -> DataFrame:
    return predictions.select("date", F.col("label").alias("actual"), F.round("prediction", 0).alias("predicted"))


def forecast_next_month(model: PipelineModel, admissions: DataFrame) -> DataFrame:
    row = next_month_row(monthly_series(admissions, "admission_date"))
    return model.transform(row).select(F.date_format("month_start", "yyyy-MM").alias("forecast_month"), F.round("prediction", 2).alias("predicted_admissions"))


def forecast_beds(model: PipelineModel, beds: DataFrame, keys: list[str] | None = None, days: int = FORECAST_DAYS) -> DataFrame:
    """Recursive daily forecast, per hospital or per group, without leaving the cluster.

    The state is one row per group: last date, day count and the last thirty
    values. Each step appends its own prediction. Groups with fewer than 31
    recorded days are left out.
    """
    keys = keys or []
    totals = daily_totals(beds, keys)
    newest = Window.partitionBy(*keys).orderBy(F.desc("record_date"))
    recent = totals.withColumn("age_", F.row_number().over(newest)).where(F.col("age_") <= HISTORY_DAYS)
    kept = F.transform(F.sort_array(F.collect_list(F.struct("record_date", F.col("occupied_beds").cast("double").alias("v")))), lambda d: d.getField("v"))
    history = recent.groupBy(*keys).agg(F.max("record_date").alias("last_date"), kept.alias("history"))
    counts = totals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HISTORY_DAYS)
    if keys:
        state = history.join(counts, keys)
    else:
        state = history.withColumn("n", F.coalesce(counts.select("n").scalar(), F.lit(0))).where("n > 0")
    state = state.withColumn("forecast", F.array().cast("array<struct<date: date, predicted_occupied_beds: double>>"))
    for _ in range(days):
        date = F.date_add("last_date", 1)
        row = state.select(
            *keys, "history", "forecast", "n", date.alias("last_date"), F.col("n").alias("time_index"), *calendar_features(date),
            F.element_at("history", -1).alias("lag_1"), F.element_at("history", -7).alias("lag_7"), F.element_at("history", -30).alias("lag_30"),
        )
        guess = F.greatest(F.round("prediction", 2), F.lit(0.0))
        state = model.transform(row).select(
            *keys,
            "last_date",
            (F.col("n") + 1).alias("n"),
            F.concat(F.slice("history", 2, HISTORY_DAYS - 1), F.array(guess)).alias("history"),
            F.concat("forecast", F.array(F.struct(F.col("last_date").alias("date"), guess.alias("predicted_occupied_beds")))).alias("forecast"),
        )
    rows = state.select(*keys, F.explode("forecast").alias("f")).select(*keys, "f.date", "f.predicted_occupied_beds")
    mean = F.round(F.avg("predicted_occupied_beds").over(Window.partitionBy(*keys)), 2)
    return rows.withColumn("average_predicted_occupied_beds", mean)


def score_equipment(model: PipelineModel, equipment: DataFrame, as_of: str, most: int | None = None) -> DataFrame:
    """Units flagged among the complete records; ``most`` keeps only the first by id, all are scored without it."""
    numeric, categorical = EQUIPMENT_FEATURES
    rows = equipment_features(equipment, as_of).na.drop(subset=[*numeric, *categorical])
    if most:
        rows = rows.orderBy("equipment_id").limit(most)
    return model.transform(stored(rows, "scored")).agg(
        F.count(F.when(F.col("prediction") == 1, 1)).alias("predicted_high_risk"), F.count(F.lit(1)).alias("records_scored")
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# Which module shows which model, and how much history a model needs.
MODEL_MODULES = (
    ("Admission Analytics", "length_of_stay", 0),
    ("Admission Analytics", "admission_forecast", 3),
    ("Bed & Capacity Analytics", "bed_forecast", 31),
    ("Appointment Analytics", "appointment_no_show", 0),
    ("Equipment Analytics", "equipment_failure", 0),
)


def prediction_status(catalog: DataFrame, predictions: DataFrame, history: DataFrame) -> DataFrame:
    """Availability of every model a dataset's modules show, with the value or the reason against.

    ``predictions`` is ``(dataset_id, model, value, period)`` and ``history``
    ``(dataset_id, model, observations)``.
    """
    shown = F.filter(
        F.array(*[F.struct(F.lit(m).alias("module"), F.lit(k).alias("model"), F.lit(n).alias("needed")) for m, k, n in MODEL_MODULES]),
        lambda s: F.array_contains("modules", s.getField("module")),
    )
    models = schema.module_flags(catalog).select("dataset_id", F.explode(shown).alias("s")).select("dataset_id", "s.model", "s.needed")
    gate = schema.feature_gate(catalog).select("dataset_id", "model", "missing")
    keys = ["dataset_id", "model"]
    joined = models.join(gate, keys, "left").join(history, keys, "left").join(predictions, keys, "left")
    gated = F.col("model").isin(*MODEL_FEATURES)
    reason = (
        F.when(gated & (F.col("missing") != ""), F.concat(F.lit("missing columns: "), F.col("missing")))
        .when(F.coalesce("observations", F.lit(0)) < F.col("needed"), F.concat(F.lit("needs observations: "), F.col("needed")))
        .when(F.col("value").isNull(), "no trained model")
    )
    available = reason.isNull()
    return joined.select(
        *keys,
        F.when(available, "available").otherwise("unavailable").alias("status"),
        F.when(available, F.col("value")).alias("value"),
        F.when(available, F.col("period")).alias("period"),
        reason.alias("reason"),
    )
