"""M: models (predictions are checked for shape and bounds, not against SQL)."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wardlens.functions import roles as rules
from wardlens.operators import charts, features, forests, metrics, models
from wardlens.plans.catalog import EXPLODED, FLAGS, LISTED, NAMES, NEEDED, ROLES, gate_parts, names
from wardlens.plans.features import LOS, daily_sql
from wardlens.plans.registry import query
from wardlens.session import work_dir
from wardlens.sources.fixtures import AS_OF


@query("equipment_failure_model")
def _(t):
    return metrics.classification_metrics(models.equipment_failure_model(t.equipment)[1])


@query("no_show_model")
def _(t):
    return metrics.classification_metrics(models.no_show_model(t.appointments)[1])


@query("los_model")
def _(t):
    return metrics.regression_metrics(models.los_model(t.admissions)[1])


@query("admission_demand_model")
def _(t):
    return metrics.regression_metrics(models.admission_demand_model(t.admissions)[1])


@query("bed_demand_model")
def _(t):
    return metrics.regression_metrics(models.bed_demand_model(t.beds)[1])


def encode_sql(numeric, categorical):
    """Filled numbers, code of each category (commoner first, then by name) and the vector's places that hold a one."""
    common = "(SELECT CAST({0} AS VARCHAR) FROM f WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY COUNT(*) DESC, CAST({0} AS VARCHAR) LIMIT 1)"
    values = ", ".join(f"COALESCE(CAST({c} AS VARCHAR), {common.format(c)}) AS v_{c}" for c in categorical)
    tables, offset, slots = [f"f AS ({LOS})", f"g AS (SELECT *, {values} FROM f)"], str(len(numeric)), []
    for c in categorical:
        tables.append(f"k_{c} AS (SELECT v_{c}, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, v_{c}) - 1 AS k FROM g GROUP BY v_{c})")
        slots.append(f"CAST({offset} + k_{c}.k AS VARCHAR)")
        offset += f" + (SELECT COUNT(*) + 1 FROM k_{c})"
    filled = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), (SELECT median({c}) FROM f), 0) AS {c}_filled" for c in numeric)
    codes = ", ".join(f"CAST(k_{c}.k AS DOUBLE) AS {c}_index" for c in categorical)
    joins = " ".join(f"JOIN k_{c} USING (v_{c})" for c in categorical)
    return f"WITH {', '.join(tables)} SELECT admission_id, {filled}, {codes}, {offset} AS width, concat_ws(',', {', '.join(slots)}) AS slots FROM g {joins}"


@query("encode_features", encode_sql(*models.LOS_FEATURES))
def _(t):
    numeric, categorical = models.LOS_FEATURES
    coded = models.encode(features.los_features(t.admissions), numeric, categorical).withColumn("x", vector_to_array("features"))
    places = F.filter(F.sequence(F.lit(len(numeric)), F.size("x") - 1), lambda i: F.col("x")[i] == 1)
    return coded.select(
        "admission_id", *[f"{c}_filled" for c in numeric], *[f"{c}_index" for c in categorical], F.size("x").cast("long").alias("width"),
        F.array_join(places.cast("array<string>"), ",").alias("slots"),
    )


@query("forecast_next_month")
def _(t):
    return models.forecast_next_month(models.admission_demand_model(t.admissions)[0], t.admissions)


@query("forecast_beds_7d")
def _(t):
    return models.forecast_beds(models.bed_demand_model(t.beds)[0], t.beds)


@query("forecast_beds_7d_by_department")
def _(t):
    rows = features.daily_lag_features(t.beds, ["department_id"])
    model = models.fit_forest(rows, models.DAY_FEATURES, models.regressor("occupied_beds", 100, 12))
    return models.forecast_beds(model, t.beds, ["department_id"])


STUMPS = [(1, "dayofweek"), (4, "lag_1"), (5, "lag_7"), (6, "lag_30")]


def stumps_sql(rows, label, splits):
    """One row: limit and leaf means of each split."""
    limits = ", ".join(f"floor(AVG({c})) AS limit_{i}" for i, (_, c) in enumerate(splits))
    sides = ", ".join(
        f"limit_{i}, COALESCE(AVG({label}) FILTER (WHERE {c} <= limit_{i}), AVG({label})) AS low_{i}, COALESCE(AVG({label}) FILTER (WHERE {c} > limit_{i}), AVG({label})) AS high_{i}"
        for i, (_, c) in enumerate(splits)
    )
    return f"SELECT {sides} FROM {rows}, (SELECT {limits} FROM {rows}) GROUP BY {', '.join(f'limit_{i}' for i in range(len(splits)))}"


def forecast_sql(keys=""):
    """The forecast one day at a time, each day reading the guesses before it."""
    group = f"{keys}, " if keys else ""
    daily = daily_sql(keys)
    now = {"dayofweek": "isodow(last_date + 1) - 1", "lag_1": "h[len(h)]", "lag_7": "h[len(h) - 6]", "lag_30": "h[len(h) - 29]"}
    votes = " + ".join(f"CASE WHEN {now[c]} <= limit_{i} THEN low_{i} ELSE high_{i} END" for i, (_, c) in enumerate(STUMPS))
    return f"""WITH RECURSIVE {daily.removeprefix('WITH ').split('SELECT * FROM f WHERE')[0].rstrip()}, rows AS (SELECT * FROM f WHERE lag_30 IS NOT NULL),
    forest AS ({stumps_sql('rows', 'occupied_beds', STUMPS)}),
    s AS (SELECT {group}0 AS day, MAX(record_date) AS last_date, CAST(list(occupied_beds ORDER BY record_date) AS DOUBLE[]) AS h FROM d GROUP BY ALL HAVING COUNT(*) > 30
      UNION ALL SELECT {group}day + 1, last_date + 1, list_append(h, greatest(ROUND(({votes}) / {len(STUMPS)}, 2), 0)) FROM s, forest WHERE day < {models.FORECAST_DAYS}),
    p AS (SELECT {group}last_date AS date, h[len(h)] AS predicted_occupied_beds FROM s WHERE day > 0)
    SELECT *, ROUND(AVG(predicted_occupied_beds) OVER ({f'PARTITION BY {keys}' if keys else ''}), 2) AS average_predicted_occupied_beds FROM p"""


@query("forecast_beds_stumps", forecast_sql())
def _(t):
    nodes = forests.stumps(features.daily_lag_features(t.beds), "occupied_beds", STUMPS)
    return forests.forecast_days(nodes, t.beds, 1)


@query("forecast_beds_stumps_by_department", forecast_sql("department_id"))
def _(t):
    nodes = forests.stumps(features.daily_lag_features(t.beds, ["department_id"]), "occupied_beds", STUMPS)
    return forests.forecast_days(nodes, t.beds, 1, ["department_id"])


UNIT_SPLITS = [(0, "equipment_age_days"), (2, "usage_hours"), (3, "maintenance_count")]
UNIT_VOTES = " + ".join(f"CASE WHEN {c} <= limit_{i} THEN low_{i} ELSE high_{i} END" for i, (_, c) in enumerate(UNIT_SPLITS))


@query("score_equipment_stumps", f"""WITH f AS (SELECT equipment_id, (SELECT MAX(installation_date) FROM equipment) - installation_date AS equipment_age_days,
      usage_hours, maintenance_count, CAST(failure_count > 0 AS INT) AS failure_risk FROM equipment), forest AS ({stumps_sql('f', 'failure_risk', UNIT_SPLITS)})
    SELECT f.equipment_id, ROUND(({UNIT_VOTES}) / {len(UNIT_SPLITS)}, 6) AS risk FROM f, forest""")
def _(t):
    rows = features.equipment_features(t.equipment)
    forest = forests.packed(forests.stumps(rows, "failure_risk", UNIT_SPLITS))
    x = F.array(*[F.col(c).cast("double") for c in models.EQUIPMENT_FEATURES[0]])
    # The numbers come in the order of the model's features: age, days to maintenance, hours, services.
    return rows.withColumns({"x": x, "forest": forest}).select("equipment_id", F.round(forests.estimate(F.col("forest"), F.col("x"), 1), 6).alias("risk"))


@query("score_equipment")
def _(t):
    return models.score_equipment(models.equipment_failure_model(t.equipment)[0], t.equipment, AS_OF)


@query("save_model")
def _(t):
    model, predictions = models.admission_demand_model(t.admissions)
    path = work_dir(t.spark, "model")
    models.save_model(model, path)
    row = features.next_month_row(features.monthly_series(t.admissions, "admission_date"))
    before, after = model.transform(row), models.load_model(path).transform(row)
    return before.select("month_start", F.col("prediction").alias("saved")).join(after.select("month_start", F.col("prediction").alias("loaded")), "month_start")


@query("actual_vs_predicted")
def _(t):
    return models.actual_vs_predicted(models.bed_demand_model(t.beds)[1])


@query("history_plus_forecast")
def _(t):
    series = features.monthly_series(t.admissions, "admission_date")
    history = series.select(F.date_format("month_start", "yyyy-MM").alias("label"), F.col("admissions").alias("value"))
    forecast = models.forecast_next_month(models.admission_demand_model(t.admissions)[0], t.admissions)
    return charts.history_plus_forecast(history, forecast.select(F.col("forecast_month").alias("label"), F.col("predicted_admissions").alias("value")), 12)


GATE = f"""found_f AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(gate_parts())})),
    wanted AS (SELECT dataset_id, model, feature FROM (SELECT DISTINCT dataset_id FROM cat), (VALUES {NEEDED}) AS needed(model, feature)),
    gate AS (SELECT w.dataset_id, w.model, COALESCE(string_agg(w.feature, ',' ORDER BY w.feature) FILTER (WHERE f.feature IS NULL), '') AS missing
      FROM wanted w LEFT JOIN found_f f ON w.dataset_id = f.dataset_id AND w.model = f.model AND w.feature = f.feature GROUP BY ALL)"""
SHOWN = ", ".join(f"('{m}', '{k}', {n})" for m, k, n in models.MODEL_MODULES)
GATED = ", ".join(f"'{m}'" for m in rules.MODEL_FEATURES)


@query("prediction_status", f"""WITH {NAMES}, {FLAGS}, {LISTED}, {EXPLODED}, {ROLES}, {GATE},
    shown AS (SELECT dataset_id, s.model, s.needed FROM found JOIN (VALUES {SHOWN}) AS s(module, model, needed) ON found.module = s.module),
    h AS (SELECT equipment_id AS dataset_id, maintenance_count * 4 AS observations, usage_hours AS value FROM equipment),
    j AS (SELECT shown.*, gate.missing, observations, CASE WHEN shown.model IN ('admission_forecast', 'bed_forecast', 'equipment_failure') AND shown.dataset_id % 5 <> 0 THEN value END AS value
      FROM shown LEFT JOIN gate ON shown.dataset_id = gate.dataset_id AND shown.model = gate.model LEFT JOIN h ON shown.dataset_id = h.dataset_id),
    r AS (SELECT *, CASE WHEN model IN ({GATED}) AND missing <> '' THEN concat('missing columns: ', missing) WHEN COALESCE(observations, 0) < needed THEN concat('needs observations: ', needed)
      WHEN value IS NULL THEN 'no trained model' END AS reason FROM j)
    SELECT dataset_id, model, CASE WHEN reason IS NULL THEN 'available' ELSE 'unavailable' END AS status, CASE WHEN reason IS NULL THEN value END AS value,
    CASE WHEN reason IS NULL THEN '1999-07' END AS period, reason FROM r""")
def _(t):
    kinds = F.explode(F.array(*[F.lit(k) for _, k, _ in models.MODEL_MODULES]))
    per_model = t.equipment.select(F.col("equipment_id").alias("dataset_id"), kinds.alias("model"), (F.col("maintenance_count") * 4).alias("observations"), F.col("usage_hours").alias("value"))
    trained = per_model.where("model IN ('admission_forecast', 'bed_forecast', 'equipment_failure') AND dataset_id % 5 <> 0")
    predictions = trained.select("dataset_id", "model", "value", F.lit("1999-07").alias("period"))
    return models.prediction_status(names(t), predictions, per_model.drop("value"))
