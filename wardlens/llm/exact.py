"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

Everything is DataFrame work. Texts meet once, in an aggregation keyed by hash
*and* text: its map side folds a group of copies to one row per task before
anything is shuffled, and because the text is part of the key, rows with equal
hashes and different bytes can never share a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.session import stored

SPACES = r"[\x20\x09-\x0D]+"


def normal_text(text: Column) -> Column:
    """The text as compared: null counts as empty, every run of white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", content_hash=hash128) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    * Null and empty texts are one text. Very long texts are compared whole.
    * ``keep_id`` is the smallest id of the group; ``group_size`` counts rows, so repeated rows count each time,
      and each row that carries the kept id is marked ``kept``.
    * A row without an id counts in its group. Where no row of a group has an id, ``keep_id`` is null and its rows are kept.
    * Other columns of ``docs`` are not read, whatever their names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).alias("id"), normal_text(F.col(text_column)).alias("body")).withColumn("h", content_hash(F.col("body")))
    groups = stored(
        rows.groupBy("h", "body")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", "keep_id", "group_size", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256")),
        "exact-groups",
    )
    collided = groups.groupBy("h").count().where("count > 1").select("h")
    if collided.isEmpty():
        # Only ids and hashes travel; a hash held by a third of the rows is split by adaptive execution.
        members = rows.select("id", "h").join(groups, "h", "left")
    else:
        digest = F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256")
        members = rows.select("id", "h", digest).join(groups, ["h", "text_sha256"], "left")
    return members.select(
        F.col("id").alias(id_column), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row for each distinct text.

    Of rows that repeat both id and text one stays, with the other columns of any of them.
    Rows without ids follow the same rule, so one of several equal texts without ids stays.
    """
    kept = exact_groups(docs, id_column, text_column).where("kept").select(F.col(id_column).alias("kept_id"), F.unhex("text_sha256").alias("kept_digest")).distinct()
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    rows = docs.select(F.col(id_column).alias("id"), F.unhex(F.sha2(normal_text(F.col(text_column)).cast("binary"), 256)).alias("digest"), row)
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["id", "digest"]).select("row.*")
