import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) or (id, text, source) tuples, with extra columns named like results."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows]
        frame = spark.createDataFrame(full, SCHEMA)
        clashing = ("id", "keep_id", "kept", "component_id", "n_words", "key", "size", "score", "row", "h", "own", "pos")
        return frame.withColumns({c: F.lit(1) for c in clashing})

    return make


LONG = " ".join(f"word{i}" for i in range(20_000))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a"), (5, "a"), (None, "a"), (6, LONG), (7, LONG + " end"), (8, None)]
