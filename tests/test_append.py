"""Appends that are repeated, aborted or committed twice at once."""

import pytest
from pyspark.sql import functions as F

from wardlens.sources import io

SCHEMA = "id bigint, name string"


def ids(spark, path):
    return sorted(r.id for r in io.read_batches(spark, path, SCHEMA).collect())


def test_repeated_and_aborted_appends(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(4).select("id", F.lit("x").alias("name"), F.lit(1).alias("more"))
    assert ids(spark, path) == []
    assert io.append_batch(rows, ["id", "name"], path, "one") and not io.append_batch(rows, ["id", "name"], path, "one")
    assert ids(spark, path) == [0, 1, 2, 3]
    fails = rows.withColumn("name", F.when(F.col("id") < 3, "y").otherwise(F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost"):
        io.append_batch(fails, ["id", "name"], path, "two")
    assert ids(spark, path) == [0, 1, 2, 3]
    assert io.append_batch(rows.where("id = 3"), ["name", "id"], path, "two")
    assert io.append_batch(rows.where("false"), ["id", "name"], path, "empty")
    assert ids(spark, path) == [0, 1, 2, 3, 3]
    assert io.read_batches(spark, path, SCHEMA).columns == ["id", "name"]


def test_batch_committed_twice_at_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    rows = spark.range(2).withColumn("name", F.lit("x"))
    with monkeypatch.context() as both:
        both.setattr(io, "committed_batches", lambda *_: {})
        assert all(io.append_batch(rows, ["id", "name"], path, "one") for _ in range(2))
    assert ids(spark, path) == [0, 1]
