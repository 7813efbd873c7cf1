"""Forests as tables of nodes, applied by plain column expressions.

A trained forest, or one written by rules, is a table with one row per node:
``tree, node, feature, kinds, limits, low, high, value``. Node 0 is the root and
nodes of a tree are numbered without gaps. A leaf has ``low`` -1. A split without
kinds (-1) sends numbers up to its only limit to ``low``; one over categories
sends those listed in ``limits`` there. ``value`` is a leaf's estimate: one
number, or the share of each class.

A forest is one value per query, as large as the model: it suits forests of
bounded depth. Very deep forests over many rows are left to ``model.transform``.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions.scalars import scalar
from wardlens.operators.features import calendar_features, daily_totals
from wardlens.session import work_dir

FORECAST_DAYS, HISTORY_DAYS = 7, 30


def node_table(model, spark) -> DataFrame:
    """The nodes of a fitted forest of either kind, read from its saved form."""
    path = work_dir(spark, "forest")
    model.write().overwrite().save(path)
    classes = getattr(model, "numClasses", 0)
    stats = F.col("nodeData.impurityStats")
    total = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    shares = F.transform(stats, lambda s: F.when(total == 0, 0.0).otherwise(s / total))
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("node"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.col("nodeData.split.numCategories").alias("kinds"),
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("limits"),
        F.col("nodeData.leftChild").alias("low"),
        F.col("nodeData.rightChild").alias("high"),
        (shares if classes else F.array("nodeData.prediction")).alias("value"),
    )


def packed(nodes: DataFrame) -> Column:
    """The forest as one array of trees; a tree is an array of nodes in order. Null without nodes.

    A subquery: give it a column of its own before an expression over arrays uses it.
    """
    fields = ["feature", "kinds", "limits", "low", "high", "value"]
    in_order = F.sort_array(F.collect_list(F.struct("node", *fields)))
    trees = nodes.groupBy("tree").agg(in_order.alias("nodes"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("tree", "nodes"))), lambda t: t.getField("nodes"))
    return scalar(trees, F.when(F.count(F.lit(1)) > 0, ordered))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use).getItem(0)


def leaf_value(tree: Column, x: Column, deepest: int) -> Column:
    """The estimate of the leaf that the numbers ``x`` reach within ``deepest`` steps."""

    def step(at, _):
        node = tree[at]
        number, limits = x[node.getField("feature")], node.getField("limits")
        down = F.when(node.getField("kinds") < 0, number <= limits.getItem(0)).otherwise(F.array_contains(limits, number))
        return F.when(node.getField("low") < 0, at).when(down, node.getField("low")).otherwise(node.getField("high"))

    steps = F.sequence(F.lit(1), F.lit(max(deepest, 1)))
    return tree[F.aggregate(steps, F.lit(0), step)].getField("value")


def summed(forest: Column, x: Column, deepest: int, width: int = 1) -> Column:
    """Leaf values added up tree by tree, in the order of the trees."""
    zero = F.array(*[F.lit(0.0)] * width)
    return F.aggregate(forest, zero, lambda total, tree: F.zip_with(total, leaf_value(tree, x, deepest), lambda a, b: a + b))


def estimate(forest: Column, x: Column, deepest: int) -> Column:
    """The mean over all trees."""
    return summed(forest, x, deepest).getItem(0) / F.size(forest)


def likeliest(forest: Column, x: Column, deepest: int, classes: int = 2) -> Column:
    """The class with the greatest sum of shares, the first of equal ones."""
    return bound(summed(forest, x, deepest, classes), lambda votes: (F.array_position(votes, F.array_max(votes)) - 1).cast("double"))


def apply_compiled(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """What ``model.transform`` adds as ``prediction``, by expressions over the forest's nodes."""
    forest, spark = model.stages[-1], rows.sparkSession
    trees, deepest = packed(node_table(forest, spark)), max(t.depth for t in forest.trees)
    ready = PipelineModel(model.stages[:-1]).transform(rows).withColumns({"x_": vector_to_array("features"), "forest_": trees})
    classes = getattr(forest, "numClasses", 0)
    guess = likeliest(F.col("forest_"), F.col("x_"), deepest, classes) if classes else estimate(F.col("forest_"), F.col("x_"), deepest)
    return ready.withColumn("prediction", guess).drop("x_", "forest_")


def day_numbers(date: Column, n: Column, history: Column) -> Column:
    """The inputs of the daily model, in its order."""
    lags = [F.element_at(history, -k) for k in (1, 7, 30)]
    return F.array(*[c.cast("double") for c in (n, *calendar_features(date), *lags)])


def forecast_days(nodes: DataFrame, beds: DataFrame, deepest: int, keys: list[str] | None = None, days: int = FORECAST_DAYS) -> DataFrame:
    """Recursive daily forecast as one expression per group: each day's guess enters the history of the next.

    Groups with fewer than 31 recorded days are left out, and so is everything
    without a forest. The last thirty days are the only values gathered.
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
    state = state.withColumn("forest", packed(nodes)).where("forest IS NOT NULL")
    empty = F.array().cast("array<double>")

    def step(so_far, day):
        values = F.concat("history", so_far)
        x = day_numbers(F.date_add("last_date", day), F.col("n") + day - 1, values)
        guess = bound(x, lambda numbers: F.greatest(F.round(estimate(F.col("forest"), numbers, deepest), 2), F.lit(0.0)))
        return F.concat(so_far, F.array(guess))

    guesses = F.aggregate(F.sequence(F.lit(1), F.lit(days)), empty, step)
    rows = state.select(*keys, "last_date", F.posexplode(guesses).alias("day", "predicted_occupied_beds"))
    mean = F.round(F.avg("predicted_occupied_beds").over(Window.partitionBy(*keys)), 2)
    return rows.select(*keys, F.date_add("last_date", F.col("day") + 1).alias("date"), "predicted_occupied_beds").withColumn("average_predicted_occupied_beds", mean)


def stumps(rows: DataFrame, label: str, splits: list[tuple[int, str]]) -> DataFrame:
    """A forest of one split per entry ``(feature position, column)``, from averages alone.

    The limit is the whole part of the column's mean and a leaf is the mean label on
    its side (the mean of all where a side is empty). One pass finds the limits, one the leaves.
    """
    limits = rows.agg(*[F.floor(F.avg(c)).cast("double").alias(f"limit_{i}") for i, (_, c) in enumerate(splits)])
    placed = rows.select(label, *[c for c in dict.fromkeys(c for _, c in splits)], *[scalar(limits, F.max(f"limit_{i}")).alias(f"limit_{i}") for i in range(len(splits))])
    sides = []
    for i, (_, c) in enumerate(splits):
        low = F.col(c) <= F.col(f"limit_{i}")
        sides += [F.avg(F.when(low, F.col(label))).alias(f"low_{i}"), F.avg(F.when(~low, F.col(label))).alias(f"high_{i}"), F.max(f"limit_{i}").alias(f"limit_{i}")]
    leaves = placed.agg(F.avg(label).alias("all"), *sides).where("all IS NOT NULL")
    none = F.array().cast("array<double>")

    def node(tree, number, feature, limits_, low, high, value):
        kinds = F.lit(-1)
        return F.struct(
            F.lit(tree).alias("tree"), F.lit(number).alias("node"), F.lit(feature).alias("feature"), kinds.alias("kinds"), limits_.alias("limits"),
            F.lit(low).alias("low"), F.lit(high).alias("high"), F.array(value).alias("value"),
        )

    nodes = []
    for i, (feature, _) in enumerate(splits):
        nodes.append(node(i, 0, feature, F.array(f"limit_{i}"), 1, 2, F.col("all")))
        nodes += [node(i, k, -1, none, -1, -1, F.coalesce(F.col(f"{side}_{i}"), "all")) for k, side in ((1, "low"), (2, "high"))]
    return leaves.select(F.explode(F.array(*nodes)).alias("n")).select("n.*")
