"""Repeated rows, and columns closed before their values are counted."""

from wardlens.operators import catalog, quality


def test_repeats_with_missing_fields(spark):
    rows = [(None, "a", 0.0), ("a", None, 0.0), (None, "a", -0.0), ("a", None, 1.0), (None, None, None), (None, None, None), (None, None, None)]
    frame = spark.createDataFrame(rows, "x string, y string, z double")
    assert quality.repeats_of(frame).collect()[0][0] == 3
    assert quality.repeats_of(frame.where("false")).collect()[0][0] == 0


def test_one_row_repeated_holds_most_of_the_table(spark):
    frame = spark.range(20_000).selectExpr("CASE WHEN id % 20 > 0 THEN 7 ELSE id END AS a", "'text' AS b")
    assert quality.repeats_of(frame).collect()[0][0] == 20_000 - frame.distinct().count()


def test_closed_columns_are_not_counted(spark):
    frame = spark.range(5_000).selectExpr("concat('u', id) AS code", "concat('k', id % 9) AS nine", "CASE WHEN id % 8 > 0 THEN concat('g', id % 8) END AS seven", "'one' AS one")
    texts = frame.columns
    got = frame.limit(1).select(catalog.open_columns(frame, texts, 8)).collect()[0][0]
    assert got[0] is False and got[2:] == [True, True]
    counts = catalog.column_frequencies(frame, texts, catalog.open_columns(frame, texts, 8))
    assert "code" not in {r.column_name for r in counts.select("column_name").distinct().collect()}
    chart = catalog.fallback_category_chart(frame).collect()
    assert {r.column_name for r in chart} == {"seven"} and sum(r.value for r in chart) == 5_000 and ("Unknown", 625) in {(r.label, r.value) for r in chart}
    assert catalog.fallback_category_chart(frame.where("false")).count() == 0
