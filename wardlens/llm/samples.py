"""Labelled rows for fitting, bounded by a documented parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_crc(identifier: Column) -> Column:
    return F.crc32(identifier.cast("string").cast("binary"))


def labelled_sample(labels: DataFrame, bound: int, id_column: str = "doc_id", where: Column | None = None) -> DataFrame:
    """At most ``bound`` label rows, one per id, picked by a hash of the id.

    The bound makes the result safe to broadcast: documents meet it in their
    scan, and no text is shuffled to find the labelled ones.
    """
    rows = labels.where(F.col(id_column).isNotNull())
    if where is not None:
        rows = rows.where(where)
    # Where an id has several labels, the greatest row counts.
    others = [c for c in rows.columns if c != id_column]
    one = rows.groupBy(id_column).agg(F.max(F.struct(*others)).alias("found")).select(id_column, "found.*")
    return one.orderBy(F.xxhash64(F.col(id_column).cast("string")), id_column).limit(bound)
