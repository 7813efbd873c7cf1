"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.session import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (or the node)."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).toDF("node", "other")
    least = stored(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least")), "large-star")
    return both.where("other > node").join(least, "node").select(F.col("other").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    least = stored(down.groupBy("node").agg(F.min("other").alias("least")), "small-star")
    moved = down.join(least, "node").where("other > least").select(F.col("other").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select(F.col("node").alias("a"), F.col("least").alias("b")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component_id`` for every node that has a link to another; the id is the smallest node reachable.

    Each round is two aggregations with map-side combining and two joins that adaptive execution may split, and is
    written to the shared folder. A star takes one round; a chain of n nodes about log n. Loops, repeats and null ends
    are dropped.
    """
    current = stored(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), "links")
    while True:
        after = stored(_small_star(_large_star(current).where("a > b").distinct()).where("a > b").distinct(), "stars")
        # Finished when each node has one link and no node that is linked to is linked further.
        inner = after.select("b").distinct().join(after.select(F.col("a").alias("b")), "b", "left_semi")
        if after.groupBy("a").count().where("count > 1").isEmpty() and inner.isEmpty():
            ends = after.select("b").distinct()
            return after.select(F.col("a").alias("node"), F.col("b").alias("component_id")).union(ends.select(F.col("b"), F.col("b")))
        current = after
