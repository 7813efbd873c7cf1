"""Forests grown by tasks: the rules of growth, rows kept in files, votes, saving, and what stays off the driver."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from wardlens.operators import growth, models
from wardlens.operators.growth import Axes, Grower, Rows, Rules


def grown(codes, stats, axes, rules, folder, tree=0):
    rows = Rows(str(folder), codes.shape[1], rules.width, np.uint16)
    for a in range(0, len(codes), 1_000):
        rows.add(codes[a : a + 1_000], stats[a : a + 1_000])
    return Grower(axes, rules, tree).grow(rows)


def followed(tree, codes, numbers):
    """The leaf's value of each row, one row at a time."""
    column, code, low, value = tree
    out = []
    for x in codes:
        at = 0
        while column[at] >= 0:
            c = column[at]
            at = low[at] + (x[c] > code[at] if c < numbers else x[c] == code[at])
        out.append(value[at])
    return np.array(out)


def some_rows(n=4_000):
    draw = np.random.default_rng(5)
    codes = np.stack([draw.integers(0, 8, n), draw.integers(0, 5, n), draw.integers(0, 6, n)], axis=1).astype(np.uint16)
    y = (codes[:, 0] > 3) ^ (codes[:, 2] == 2) ^ (draw.random(n) < 0.1)
    return codes, y, Axes([[float(i) for i in range(7)], [0.0, 1.0, 2.0, 3.0]], [6])


def test_a_split_is_the_best_of_all(tmp_path):
    """One level over all places equals a search by brute force."""
    codes, y, axes = some_rows()
    stats = np.stack([~y, y], axis=1).astype(float)
    rules = Rules(1, 1, 1, 2, axes.places, 1)
    column, code, low, value = grown(codes, stats, axes, rules, tmp_path)

    def gini(rows):
        share = rows.mean() if len(rows) else 0
        return len(rows) * 2 * share * (1 - share)

    tests = {(c, v): codes[:, c] > v for c, top in ((0, 7), (1, 4)) for v in range(top)} | {(2, v): codes[:, 2] == v for v in range(6)}
    best = min(tests, key=lambda t: gini(y[tests[t]]) + gini(y[~tests[t]]))
    assert (column[0], code[0], low[0], len(column)) == (*best, 1, 3)
    for leaf, rows in ((1, ~tests[best]), (2, tests[best])):
        assert np.allclose(value[leaf], [1 - y[rows].mean(), y[rows].mean()])


@pytest.mark.parametrize("classes", [2, 0])
def test_leaves_hold_the_means_of_their_rows_and_bounds_hold(tmp_path, classes):
    codes, y, axes = some_rows()
    number = y * 3.0 + codes[:, 1]
    stats = np.stack([~y, y], axis=1).astype(float) if classes else np.stack([np.ones(len(y)), number, number**2], axis=1)
    rules = Rules(1, 5, 7 if not classes else 1, classes, axes.places, 1)
    tree = grown(codes, stats, axes, rules, tmp_path)
    said = followed(tree, codes, 2)
    for leaf in np.unique(said, axis=0):
        mine = (said == leaf).all(1)
        assert np.isclose(leaf[-1], (y if classes else number)[mine].mean())
        assert classes or mine.sum() >= 7
    assert 3 < len(tree[0]) <= 2**6 - 1
    assert not classes or ((said[:, -1] > 0.5) == y).mean() > 0.85


def test_rows_in_files_give_the_tree_of_rows_in_memory(tmp_path, monkeypatch):
    """All places are looked at, so the order in which nodes are grown changes nothing."""
    codes, y, axes = some_rows()
    stats = np.stack([~y, y], axis=1).astype(float)
    rules = Rules(1, 30, 1, 2, axes.places, 1)
    want = followed(grown(codes, stats, axes, rules, tmp_path), codes, 2)
    monkeypatch.setattr(growth, "ROWS_AT_ONCE", 150)
    monkeypatch.setattr(growth, "PACK", 64)
    seen, wrote = [], Rows.parted
    monkeypatch.setattr(Rows, "parted", lambda self, high: seen.append(self.path) or wrote(self, high))
    tree = grown(codes, stats, axes, rules, tmp_path)
    assert np.allclose(followed(tree, codes, 2), want) and len(seen) > 5 and all(seen)
    assert not list(tmp_path.iterdir())


def test_leaves_that_say_the_same_are_joined():
    """Bottom up, with the shares of the node above them."""
    low = np.array([1, 3, 5, -1, -1, -1, 7, -1, -1], np.int32)
    value = np.array([[0.5, 0.5], [0.4, 0.6], [0.7, 0.3], [0.3, 0.7], [0.45, 0.55], [0.2, 0.8], [0.9, 0.1], [0.8, 0.2], [1.0, 0.0]])
    column, code, low, value = growth.pruned(np.where(low < 0, -1, 0).astype(np.int16), np.arange(9, dtype=np.int32), low, value)
    assert low.tolist() == [1, -1, 3, -1, -1] and column.tolist() == [0, -1, 0, -1, -1] and code.tolist() == [0, 1, 2, 5, 6]
    assert value[:, 1].tolist() == [0.5, 0.6, 0.3, 0.8, 0.1]


def test_places_are_drawn_without_repeats():
    marks = growth.chosen_places(np.random.default_rng(1), 5_000, 12, 4)
    assert (marks.sum(1) == 4).all() and np.abs(marks.mean(0) - 4 / 12).max() < 0.03
    assert growth.chosen_places(np.random.default_rng(1), 3, 2, 2).all()


def test_keys_hold_more_than_one_number_can():
    axes = Axes([[float(i) for i in range(31)]] * 14, [70_000, 3])
    codes = np.stack([np.random.default_rng(2).integers(0, s, 50) for s in axes.sizes], axis=1)
    keys = np.zeros((50, len(axes.keys)), np.int64)
    for k, group in enumerate(axes.keys):
        for c in group:
            keys[:, k] = keys[:, k] * axes.sizes[c] + codes[:, c]
    assert len(axes.keys) > 1 and (axes.codes(keys) == codes).all()


def rows_of(spark, n=3_000):
    return spark.range(n).selectExpr(
        "id", "CAST(id % 37 AS DOUBLE) AS a", "CASE WHEN id % 11 > 0 THEN CAST(pmod(xxhash64(id), 997) AS DOUBLE) END AS b", "CASE WHEN id % 13 > 0 THEN concat('k', id % 5) END AS c",
        "CAST(id % 37 > 17 AND id % 5 > 0 AS INT) AS z", "CAST(id % 37 * 2 + id % 5 AS DOUBLE) AS y", "CAST(1 + id % 3 AS DOUBLE) AS weight",
    )


FEATURES = (["a", "b"], ["c"])


def test_a_forest_learns_votes_and_is_saved(spark, tmp_path, monkeypatch):
    rows = rows_of(spark)
    model = models.grow_forest(rows, FEATURES, "z", "weight", trees=15, classes=2)
    asked = rows.unionByName(rows.where("id < 9").withColumns({"c": F.lit("never seen"), "a": F.lit(1e9), "b": F.lit(float("nan"))}))
    said = model.transform(asked)
    assert said.count() == 3_009 and "features" in said.columns
    assert said.where("c IS NULL OR c <> 'never seen'").selectExpr("avg(CAST(prediction = z AS INT))").first()[0] > 0.95
    want = sorted((r.id, r.c or "", r.prediction) for r in said.collect())
    models.save_model(model, str(tmp_path / "model"))
    # Groups of one tree and cells of many buckets change nothing.
    monkeypatch.setattr(growth, "GROUP_BYTES", 1)
    monkeypatch.setattr(growth, "CELLS_A_TASK", 500)
    monkeypatch.setattr(growth, "PACK", 100)
    loaded = models.load_model(str(tmp_path / "model"))
    assert isinstance(loaded, PipelineModel)
    assert sorted((r.id, r.c or "", r.prediction) for r in loaded.transform(asked).collect()) == want


def test_a_grown_forest_is_as_good_as_sparks(spark):
    rows = rows_of(spark)
    mine = models.grow_forest(rows, FEATURES, "y", trees=10, depth=6, leaf=3).transform(rows)
    theirs = models.fit_forest(rows, FEATURES, models.regressor("y", 10, 6, 3)).transform(rows)
    error = [f.selectExpr("avg(abs(prediction - y))").first()[0] for f in (mine, theirs)]
    assert error[0] < 1.15 * error[1] + 0.05


def test_counted_rows_are_drawn_as_often_as_single_ones(spark):
    """A bootstrap of a row counted n times takes it n times on average, and each tree draws its own."""
    task = growth.drawn(Axes([], [3]), Rules(400, 1, 1, 0, 3, 1), 1)
    cells = spark.createDataFrame([(0, 1.0, 1.0, 1), (1, 2.0, 1.0, 9)], "key0_ bigint, y_ double, w_ double, n_ bigint").coalesce(1)
    packs = cells.mapInArrow(task, "tree int, at bigint, n int, cells binary, stats binary").collect()
    taken = np.zeros((400, 2))
    for r in packs:
        taken[r.tree, np.frombuffer(r.cells, np.int64)] = np.frombuffer(r.stats, np.float64).reshape(3, r.n)[0]
    assert np.abs(taken.mean(0) - [1, 9]).max() < 0.5 and 0.7 < taken[:, 0].var() < 1.3 and 7 < taken[:, 1].var() < 11


def test_labels_must_be_there(spark):
    with pytest.raises(Exception, match="must not be null"):
        models.grow_forest(rows_of(spark).withColumn("y", F.expr("nullif(id, 5)")), FEATURES, "y", trees=2)
    with pytest.raises(ValueError, match="no rows"):
        models.grow_forest(rows_of(spark).where("false"), FEATURES, "y", trees=2)


def not_on_the_driver(monkeypatch):
    """Spark's forests, which live on the driver, must not be fitted."""
    monkeypatch.setattr(models, "fit_forest", lambda *a, **k: pytest.fail("the forest is grown on the driver"))


def units(spark, n=600):
    return spark.range(n).selectExpr(
        "id AS equipment_id", "CAST(id % 7 AS INT) AS department_id", "concat('t', id % 4) AS equipment_type", "date_add(DATE '1995-01-01', CAST(id % 900 AS INT)) AS installation_date",
        "CASE WHEN id % 10 > 0 THEN date_add(DATE '1998-01-01', CAST(id % 300 AS INT)) END AS next_maintenance_date", "CAST(id % 50 AS DOUBLE) AS usage_hours",
        "CAST(id % 9 AS INT) AS maintenance_count", "CAST(id % 50 > 30 AS INT) AS failure_count",
    )


def test_equipment_forest_stays_off_the_driver(spark, monkeypatch):
    """at 1 GB the forest filled the driver."""
    not_on_the_driver(monkeypatch)
    model, said = models.equipment_failure_model(units(spark), trees=20)
    assert isinstance(model.stages[-1], growth.GrownForest)
    rows = said.collect()
    assert len(rows) == 120 + 1 and np.mean([r.label == r.prediction for r in rows]) > 0.9


def test_scores_read_the_units_once_and_stay_off_the_driver(spark, monkeypatch):
    """F2: the forest filled the driver; cells and scores both read the units, so these are stored."""
    not_on_the_driver(monkeypatch)
    model, kept = models.equipment_failure_model(units(spark), trees=10)[0], []
    keep = models.stored
    monkeypatch.setattr(models, "stored", lambda frame, label: kept.append(label) or keep(frame, label))
    frame = models.score_equipment(model, units(spark), "1999-06-15")
    (row,) = frame.collect()
    assert kept == ["scored"] and "Range" not in frame._jdf.queryExecution().executedPlan().toString()
    assert row.records_scored == 540 and 0 < row.predicted_high_risk < 540
    assert models.score_equipment(model, units(spark), "1999-06-15", most=100).first().records_scored == 100


def test_no_show_forest_is_grown_by_tasks(spark, monkeypatch):
    """levels of a forest on the driver took too long."""
    not_on_the_driver(monkeypatch)
    visits = spark.range(2_000).selectExpr(
        "id AS appointment_id", "CAST(id % 7 AS INT) AS department_id", "concat('t', id % 3) AS appointment_type", "date_add(DATE '1995-01-01', CAST(id % 90 + id % 31 AS INT)) AS appointment_date",
        "date_add(DATE '1995-01-01', CAST(id % 90 AS INT)) AS booking_date", "CAST(id % 31 AS INT) AS wait_time_days", "CASE WHEN id % 31 > 20 THEN 'No-Show' WHEN id % 5 > 0 THEN 'Completed' END AS appointment_status",
    )
    model, said = models.no_show_model(visits, trees=20)
    rows = said.collect()
    assert isinstance(model.stages[-1], growth.GrownForest) and len(rows) in (400, 401) and np.mean([r.label == r.prediction for r in rows]) > 0.9


def test_los_forest_is_grown_by_tasks_and_facts_are_stored_once(spark, monkeypatch):
    """every level read all rows and every split pass joined the facts again."""
    not_on_the_driver(monkeypatch)
    kept, keep = [], models.stored
    monkeypatch.setattr(models, "stored", lambda frame, label: kept.append((label, frame)) or keep(frame, label))
    stays = spark.range(2_000).selectExpr(
        "concat('a', id) AS admission_id", "CAST(id % 7 AS INT) AS department_id", "concat('t', id % 3) AS admission_type", "CAST(nullif(id % 60, 8) AS INT) AS age", "nullif(concat('g', id % 2), 'g0') AS gender",
        "concat('b', id % 2) AS bed_type", "date_add(DATE '1995-01-01', CAST(id % 90 AS INT)) AS admission_date", "CAST(id % 7 * 3 + id % 3 AS INT) AS length_of_stay",
    )
    model, said = models.los_model(stays, trees=10)
    rows = said.collect()
    assert isinstance(model.stages[-1], growth.GrownForest) and len(rows) == 400 and np.mean([abs(r.label - r.prediction) for r in rows]) < 1
    assert [label for label, _ in kept] == ["admissions", "split"] and "Range" not in kept[1][1]._jdf.queryExecution().optimizedPlan().toString()
