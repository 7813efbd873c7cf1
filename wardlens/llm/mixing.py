"""Mixing sources to target weights by hash order, prefix sums and one cut per source.

Each document gets a hash-random key. The key's leading bits are ranges that
need no sampling to be even, so the order within a source is: range totals,
prefix sums over the totals, and a prefix sum inside each range. No source is
sorted in one piece; a source with a third of all rows spreads over all ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.session import stored

WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60
RANGE_BITS = 12


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def random_key(identifier: Column, seed: str) -> Column:
    """A 60-bit number that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.coalesce(identifier.cast("string"), F.lit("")), F.lit(f"/{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``no_source, source_key, source_size, target`` from ``no_source, source_key, source_size``.

    Sources in code point order, null last, take the weights in turn and split
    ``share`` of all words; no target passes ``most`` times its source, and the
    excess is shared again by weight. In the order of ceiling per weight the
    full sources come first, so the common level is found in one pass. One row
    per source: these are the only windows without a key.
    """
    order = Window.orderBy("no_source", "source_key")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = totals.withColumn("weight", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1)).withColumn(
        "ceiling", F.col("source_size") * F.lit(float(most))
    )
    by_level = Window.orderBy(F.col("ceiling") / F.col("weight"), "no_source", "source_key")
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    later = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("ceiling").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    return (
        weighed.withColumn("level", level)
        .withColumn("rank", F.row_number().over(by_level))
        .withColumn("first", F.min(F.when(F.col("level") * F.col("weight") <= F.col("ceiling"), F.col("rank"))).over(everything))
        .withColumn("common", F.max(F.when(F.col("rank") == F.col("first"), F.col("level"))).over(everything))
        .select(
            "no_source", "source_key", "source_size",
            F.when(F.col("common").isNull() | (F.col("rank") < F.col("first")), F.col("ceiling")).otherwise(F.least(F.col("common") * F.col("weight"), F.col("ceiling"))).alias("target"),
        )
    )


def _plan(
    docs: DataFrame, carried: list[Column], id_column: str, text_column: str, source_column: str, weights, share: float, most: float, seed: str
) -> DataFrame:
    def keyed(*more):
        key = random_key(F.col(id_column), seed)
        return docs.select(
            F.col(id_column).alias("id"), F.col(source_column).isNull().alias("no_source"), F.coalesce(F.col(source_column), F.lit("")).alias("source_key"),
            word_count(F.col(text_column)).alias("size"), key.alias("key"), F.shiftright(key, KEY_BITS - RANGE_BITS).alias("range"), *more,
        )

    sized = stored(keyed(), "mix-sizes")
    by_range = sized.groupBy("no_source", "source_key", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(by_range.groupBy("no_source", "source_key").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    upto = Window.partitionBy("no_source", "source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(
        by_range.withColumn("before", F.coalesce(F.sum("range_size").over(upto), F.lit(0)))
        .join(targets, ["no_source", "source_key"])
        .select("no_source", "source_key", "range", "before", "source_size", "target"),
        "mix-offsets",
    )
    inside = Window.partitionBy("no_source", "source_key", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0))), F.lit(0)).cast("long")
    rows = sized if not carried else keyed(*carried)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    # The document on the cut belongs to the mix when at least half of it lies before the cut.
    return (
        rows.join(offsets, ["no_source", "source_key", "range"])
        .withColumn("start", start)
        .withColumn("epochs", epochs)
        .withColumn("cut", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("copies", F.col("epochs") + F.when((F.col("size") > 0) & (2 * F.col("start") + F.col("size") <= 2 * F.col("cut")), 1).otherwise(0))
    )


def mix_report(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix",
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """Per document: ``id, size, source_size, target, taken`` and its ``copies``, ``start`` (words before it in its source) and ``key``.

    * A null text has size 0; a null source is a source, the last one; a null id has the key of an empty id.
    * Whole documents are taken, once per full epoch and once more before the cut, so a source misses its target by at
      most half a document. A document of size 0 is taken by full epochs only and adds no words.
    * Ties in the key are ordered by id, then size; repeated rows are separate rows of the mix. An empty table gives an
      empty result. Other columns are not read.
    """
    plan = _plan(docs, [], id_column, text_column, source_column, weights, share, most, seed)
    return plan.select(
        F.col("id").alias(id_column), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "start", "key"
    )


def mix_rows(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix",
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """The mix itself: every taken document with all its columns, once per copy. Cases as in :func:`mix_report`."""
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    plan = _plan(docs, [row], id_column, text_column, source_column, weights, share, most, seed)
    return plan.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
