"""Forests applied by expressions equal the fitted model on every row, and so does the recursive forecast."""

import pytest
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.param.shared import HasLabelCol, HasWeightCol
from pyspark.sql import functions as F

from wardlens.operators import features, forests, models
from wardlens.plans.catalogue import PLANS


@pytest.mark.parametrize("kind", ["regressor", "classifier"])
def test_expressions_equal_the_model(spark, kind):
    rows = spark.range(400).selectExpr(
        "id", "CAST(id % 37 AS DOUBLE) AS a", "CASE WHEN id % 11 > 0 THEN CAST(id * id % 101 AS DOUBLE) END AS b",
        "CASE WHEN id % 13 > 0 THEN concat('k', id % 5) END AS c", "CAST(id * 7 % 29 AS DOUBLE) AS y", "CAST(id * id % 7 > 2 AS INT) AS z", "CAST(1 + id % 3 AS DOUBLE) AS weight",
    )
    estimator = models.regressor("y", 7, 6) if kind == "regressor" else models.classifier("z", 9, 8)
    model = models.fit_forest(rows, (["a", "b"], ["c"]), estimator)
    asked = rows.unionByName(rows.limit(5).withColumns({"c": F.lit("never seen"), "a": F.lit(1e9)}))
    want = sorted((r.id, r.c, r.prediction) for r in model.transform(asked).fillna("", ["c"]).collect())
    got = sorted((r.id, r.c, r.prediction) for r in forests.apply_compiled(model, asked).fillna("", ["c"]).collect())
    assert got == want and len({r[2] for r in want}) > 1


@pytest.mark.parametrize("keys", [[], ["department_id"]])
def test_recursive_forecast_equals_the_model_step_by_step(tables, keys):
    rows = features.daily_lag_features(tables.beds, keys)
    model = models.fit_forest(rows, models.DAY_FEATURES, models.regressor("occupied_beds", 12, 6))
    want = sorted(map(tuple, models.forecast_beds(model, tables.beds, keys).collect()))
    nodes, deepest = forests.node_table(model.stages[-1], tables.spark), max(t.depth for t in model.stages[-1].trees)
    frame = forests.forecast_days(nodes, tables.beds, deepest, keys)
    assert sorted(map(tuple, frame.collect())) == want and want


def test_no_forest_and_no_rows(tables):
    none = tables.beds.where("false")
    nodes = forests.stumps(features.daily_lag_features(none), "occupied_beds", [(1, "dayofweek")])
    assert nodes.count() == 0
    assert forests.forecast_days(nodes, tables.beds, 1).count() == 0
    some = forests.stumps(features.daily_lag_features(tables.beds), "occupied_beds", [(1, "dayofweek")])
    assert some.count() == 3 and forests.forecast_days(some, none, 1).count() == 0


@pytest.mark.parametrize("name", ["forecast_beds_stumps", "forecast_beds_stumps_by_department", "score_equipment_stumps"])
def test_forests_join_no_rows(tables, name):
    plan = PLANS[name](tables)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "PythonUDF" not in plan


@pytest.mark.parametrize("kind", ["regressor", "classifier"])
def test_rows_keep_their_nodes_between_levels(spark, kind):
    """Else every task of every level is sent the whole forest; the trees are the same."""
    rows = spark.range(300).selectExpr("CAST(id % 37 AS DOUBLE) AS a", "concat('k', id % 5) AS c", "CAST(id * 7 % 29 AS DOUBLE) AS y", "CAST(id * id % 7 > 2 AS INT) AS z", "CAST(1 + id % 3 AS DOUBLE) AS weight")
    estimator = models.regressor("y", 5, 6) if kind == "regressor" else models.classifier("z", 5)
    assert estimator.getCacheNodeIds()
    kept = models.fit_forest(rows, (["a"], ["c"]), estimator).stages[-1]
    sent = models.fit_forest(rows, (["a"], ["c"]), estimator.copy().setCacheNodeIds(False)).stages[-1]
    assert [t.toDebugString.split("\n")[1:] for t in kept.trees] == [t.toDebugString.split("\n")[1:] for t in sent.trees]


def test_encoding_reads_the_tables_once(tables):
    """Fill values, codes and result read stored rows, not the joins behind them."""
    plan = PLANS["encode_features"](tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "Join" not in plan


class Counting(Estimator, HasLabelCol, HasWeightCol):
    """Keeps the number of partitions and of rows that it is fitted on."""

    def _fit(self, dataset):
        self.seen = dataset.rdd.getNumPartitions(), dataset.count()
        return PipelineModel([])


@pytest.mark.parametrize("scattered", [1, 90])
def test_forests_read_no_more_partitions_than_rows_fill(spark, monkeypatch, scattered):
    """Every task of a pass sends the statistics of a whole level, so a few rows must not be spread over many."""
    rows = spark.range(0, 1000, 1, scattered).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS y")
    for each, parts in ((50_000, 1), (400, 3), (1, spark.sparkContext.defaultParallelism)):
        monkeypatch.setattr(models, "ROWS_A_TASK", each)
        seen = Counting()._set(labelCol="y")
        models.fit_forest(rows, (["a"], []), seen)
        assert seen.seen == (parts, 1000)
    assert models.gathered(rows.where("false")).count() == 0


def test_both_parts_read_rows_stored_once(spark):
    """Facts are joined and split once, not for each part; every row with a stratum is in one part."""
    rows = spark.range(100).selectExpr("id", "id % 10 < 8 AS is_train").union(spark.range(1).selectExpr("id", "CAST(NULL AS BOOLEAN)"))
    train, test = models._train_and_test(rows)
    assert (train.count(), test.count()) == (80, 20)
    for part in (train, test):
        assert part.inputFiles() and "Range" not in part._jdf.queryExecution().executedPlan().toString()
