"""Exact vector search over a stored metric index.

Vectors lie in blocks around pivots: every vector goes to its nearest pivot, and the vectors of a pivot are cut, in order of
their angle to it, into blocks that store the least and greatest angle, the smallest id and the unit vectors. The angle
between unit vectors is a metric, so a query at angle t from a pivot is at least max(0, t - high, low - t) away from every
vector of a block. Queries meet their most promising blocks first; the running k-th score drops every block whose bound
cannot reach it, round by round, until none is left. The result is that of comparing all pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wardlens.session import ship_by_value, stored, work_dir

ship_by_value(__name__)

#: Vectors that choose the pivots, pivots at most, bytes of a block's vectors, steps of the angle that order a pivot's blocks.
SAMPLE, PIVOTS, BLOCK_BYTES, RINGS = 4_096, 256, 1_000_000, 128
#: Bytes of the blocks that meet a pack of queries in one task, hits it gathers before it keeps the best.
GROUP_BYTES, GATHERED = 16_000_000, 500_000
#: Queries of a pack, blocks a query meets in the first full round, growth of that number by round.
QUERY_ROWS, FIRST_BLOCKS, GROWTH = 2_000, 4, 4
#: Angles are taken wider by this much, more than their rounding, and scores by a unit of their sixth digit.
SLACK, DIGIT = 1e-6, 1.5e-6


def units(lists) -> np.ndarray:
    matrix = np.stack([np.asarray(v, "float64") for v in lists])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the one least like those before it."""
    chosen, best = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        i = int(np.argmin(best))
        if best[i] > 1 - 1e-9:
            break
        chosen.append(i)
        best = np.maximum(best, sample @ sample[i])
    return sample[chosen]


@dataclass
class VectorIndex:
    """A stored index: ``blocks`` (``block, pivot, low, high, least_id, n, ids, units``) and the pivots as unit rows."""

    blocks: DataFrame
    pivots: np.ndarray

    def summary(self) -> DataFrame:
        """One row per block without its vectors."""
        return self.blocks.select("block", "pivot", "low", "high", "least_id", "n")


def write_index(vectors: DataFrame, path: str, block_bytes: int = BLOCK_BYTES, pivots: int = PIVOTS, sample: int = SAMPLE) -> VectorIndex:
    """Index ``vec_id, embedding`` under ``path``; rows without an embedding are left out, zero vectors have pivot -1.

    Pivots are chosen among at most ``sample`` vectors, picked by a hash of their id; every vector is indexed. Rows are dealt
    by ranges of (pivot, angle, id) and cut into blocks where they arrive, so a direction shared by any part of the vectors
    is many blocks of bounded size.
    """
    rows = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding")
    picked = rows.orderBy(F.xxhash64(F.col("vec_id").cast("string")), "vec_id").limit(sample).select("embedding").collect()
    chosen = units([r.embedding for r in picked]) if picked else np.zeros((0, 1))
    chosen = chosen[np.abs(chosen).sum(axis=1) > 0]
    dims = chosen.shape[1]
    block_rows = max(block_bytes // (8 * dims), 1)
    total = rows.count()
    centres = farthest_first(chosen, max(1, min(pivots, math.ceil(total / block_rows)))) if len(chosen) else np.zeros((1, dims))
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    kind = rows.schema["vec_id"].dataType
    id_type = to_arrow_type(kind)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = units(batch.column(1).to_numpy(zero_copy_only=False))
            cosine = np.clip(matrix @ shared.value.T, -1, 1)
            nearest = np.argmax(cosine, axis=1)
            angle = np.arccos(cosine[np.arange(len(matrix)), nearest])
            zero = ~matrix.any(axis=1)
            nearest, angle = np.where(zero, -1, nearest), np.where(zero, 0.0, angle)
            packed = pa.array([row.tobytes() for row in matrix], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest.astype(np.int32)), pa.array(angle), packed], ["vec_id", "pivot", "angle", "unit"])

    def pack(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held, at = [], None

        def flush():
            nonlocal seq, held
            ids, angles, unit = zip(*held, strict=True)
            block, seq, held = part << 32 | seq, seq + 1, []
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()), pa.array([at], pa.int32()), pa.array([min(angles)]), pa.array([max(angles)]), pa.array([min(ids)], id_type),
                    pa.array([len(ids)], pa.int32()), pa.array([ids], pa.list_(id_type)), pa.array([b"".join(unit)], pa.binary()),
                ],
                ["block", "pivot", "low", "high", "least_id", "n", "ids", "units"],
            )

        for batch in batches:
            for vec_id, pivot, angle, unit in zip(*[c.to_pylist() for c in batch.columns[:4]], strict=True):
                if held and (pivot != at or len(held) >= block_rows):
                    yield flush()
                at = pivot
                held.append((vec_id, angle, unit))
        if held:
            yield flush()

    name = kind.simpleString()
    assigned = rows.mapInArrow(assign, f"vec_id {name}, pivot int, angle double, unit binary").withColumn("ring", F.floor(F.col("angle") * (RINGS / math.pi)))
    ordered = assigned.repartitionByRange("pivot", "ring", "vec_id").sortWithinPartitions("pivot", "ring", "vec_id").select("vec_id", "pivot", "angle", "unit")
    schema = f"block bigint, pivot int, low double, high double, least_id {name}, n int, ids array<{name}>, units binary"
    ordered.mapInArrow(pack, schema).write.parquet(f"{path}/blocks")
    spark = rows.sparkSession
    spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(centres)], "pivot int, unit array<double>").coalesce(1).write.parquet(f"{path}/pivots")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index written earlier. The pivots are few (at most as many as it was written with)."""
    rows = spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()
    return VectorIndex(spark.read.parquet(f"{path}/blocks"), np.array([r.unit for r in rows]))


def indexed_search(index: VectorIndex, queries: DataFrame, top: int = 5, query_rows: int = QUERY_ROWS) -> tuple[DataFrame, DataFrame]:
    """Cosine top ``top`` per query and the work done: ``(query_id, rank, vec_id, score)`` and ``(query_id, blocks_met, vectors_met)``.

    ``queries`` has ``query_id, embedding``. A zero vector scores 0 against everything; ties go to the smaller id. Only
    numbers of pairs pass the driver.
    """
    spark = queries.sparkSession
    asked = queries.where("embedding IS NOT NULL").select("query_id", "embedding").withColumn("q", F.monotonically_increasing_id())
    asked = stored(asked, "asked")
    vectors = index.blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    packs, groups = max(math.ceil(asked.count() / query_rows), 1), max(math.ceil(8 * vectors * index.pivots.shape[1] / GROUP_BYTES), 1)
    spans = index.summary().where("pivot >= 0").groupBy("pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()  # a row per pivot
    low, high = np.full(len(index.pivots), np.inf), np.full(len(index.pivots), -np.inf)
    for r in spans:
        low[r.pivot], high[r.pivot] = r.low, r.high
    shared = spark.sparkContext.broadcast((index.pivots, low, high))

    def pivots_left(batches):
        centres, least, most = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = units(batch.column(1).to_numpy(zero_copy_only=False))
            angle = np.arccos(np.clip(matrix @ centres.T, -1, 1))
            apart = np.maximum(np.maximum(angle - most - SLACK, least - angle - SLACK), 0)
            floor = batch.column(2).to_numpy(zero_copy_only=False)
            zero = ~matrix.any(axis=1)
            # Against a zero query every vector scores 0.
            best = np.where(zero[:, None], 0.0, np.cos(np.minimum(apart, np.pi)))
            keep = (best + DIGIT >= np.where(np.isnan(floor), -2.0, floor)[:, None]) & np.isfinite(least)[None, :]
            q, pivot = np.nonzero(keep)
            found = [batch.column(0).take(pa.array(q)), pa.array(pivot.astype(np.int32)), pa.array(angle[q, pivot]), pa.array(zero[q])]
            yield pa.RecordBatch.from_arrays(found, ["q", "pivot", "angle", "zero"])

    summary = index.summary()
    kind = index.blocks.schema["least_id"].dataType.simpleString()

    def open_pairs(floors: DataFrame | None, met: DataFrame | None) -> DataFrame:
        """(query, block) pairs that may still hold a better vector, with the greatest score they allow."""
        with_floor = asked.select("q", "embedding", F.lit(None).cast("double").alias("floor"), F.lit(None).cast(kind).alias("last_id"))
        if floors is not None:
            with_floor = asked.select("q", "embedding").join(floors, "q", "left")
        left = with_floor.select("q", "embedding", F.col("floor").cast("double").alias("floor")).mapInArrow(pivots_left, "q bigint, pivot int, angle double, zero boolean")
        apart = F.least(F.greatest(F.col("angle") - F.col("high") - SLACK, F.col("low") - F.col("angle") - SLACK, F.lit(0.0)), F.lit(math.pi))
        pairs = left.join(summary, "pivot").select("q", "block", "least_id", "n", F.when(F.col("zero"), 0.0).otherwise(F.cos(apart)).alias("most"))
        # Zero vectors score 0 and lie in blocks of their own; every query may meet them.
        every = asked.select("q", F.lit(-1).alias("pivot")).join(summary, "pivot").select("q", "block", "least_id", "n", F.lit(0.0).alias("most"))
        pairs = pairs.unionByName(every)
        if floors is not None:
            reach = F.round(F.col("most") + DIGIT, 6)
            closed = F.col("floor").isNotNull() & ((reach < F.col("floor")) | ((F.col("most") <= F.col("floor") + 1e-12) & (F.col("least_id") > F.col("last_id"))))
            pairs = pairs.join(floors, "q", "left").where(~closed).select("q", "block", "least_id", "n", "most")
        return pairs if met is None else pairs.join(met.select("q", "block"), ["q", "block"], "left_anti")

    hits = met = floors = None
    width = 1
    while True:
        best = Window.partitionBy("q").orderBy(F.desc("most"), "least_id", "block")
        pairs = open_pairs(floors, met).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= width)
        pairs = stored(pairs.select("q", "block", "n"), "pairs")
        if pairs.isEmpty():
            break
        found = stored(_meet(index, asked, pairs, top, packs, groups), "hits")
        hits, met = (found, pairs) if hits is None else (hits.unionByName(found), met.unionByName(pairs))
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        ranked = hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == top)
        floors = stored(ranked.select("q", F.col("score").alias("floor"), F.col("vec_id").alias("last_id")), "floors")
        width = FIRST_BLOCKS if width == 1 else width * GROWTH
    if hits is None:
        hits = stored(_meet(index, asked, asked.select("q", F.lit(0).cast("long").alias("block"), F.lit(0).alias("n")).where("false"), top, packs, groups), "hits")
        met = asked.select("q", F.lit(0).cast("long").alias("block"), F.lit(0).alias("n")).where("false")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.join(asked.select("q", "query_id"), "q").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    work = asked.select("q", "query_id").join(met, "q", "left").groupBy("query_id").agg(F.count("block").alias("blocks_met"), F.coalesce(F.sum("n"), F.lit(0)).alias("vectors_met"))
    return ranked.select("query_id", "rank", "vec_id", "score"), work


def _meet(index: VectorIndex, asked: DataFrame, pairs: DataFrame, top: int, packs: int, groups: int) -> DataFrame:
    """The best ``top`` vectors of each query in the blocks it meets: ``q, vec_id, score``, per group of blocks.

    Queries fall into packs and blocks into groups of bounded size by hash. A task holds what a pack and a group need of each
    other: a query travels once per group, a block once per pack, and only the best of a whole group go on.
    """
    pack, group = F.pmod(F.xxhash64("q"), F.lit(packs)).alias("pack"), F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group")
    lists = pairs.groupBy("q", group).agg(F.collect_list("block").alias("blocks"))
    left = lists.join(asked.select("q", "embedding"), "q").select("group", pack, "q", "embedding", "blocks")
    right = pairs.select("block", pack).distinct().join(index.blocks.select("block", "ids", "units"), "block").select(group, "pack", "block", "ids", "units")
    kind = index.blocks.schema["least_id"].dataType
    id_type = to_arrow_type(kind)
    names = ["q", "vec_id", "score"]

    def first(tables):
        """The best of each query so far."""
        table = pa.concat_tables(tables).sort_by([("q", "ascending"), ("score", "descending"), ("vec_id", "ascending")])
        q = table.column("q").to_numpy()
        starts = np.flatnonzero(np.concatenate((np.ones(min(len(q), 1), bool), q[1:] != q[:-1])))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        return table.filter(pa.array(place < top))

    def best(queries, blocks):
        found, size = [pa.table([pa.array([], t) for t in (pa.int64(), id_type, pa.float64())], names)], 0
        if not queries.num_rows or not blocks.num_rows:
            return found[0]
        queries = queries.combine_chunks()
        q, matrix = queries.column("q").to_numpy(), units(queries.column("embedding").to_numpy())
        wanted = queries.column("blocks").combine_chunks()
        flat = wanted.flatten().to_numpy()
        asking = np.repeat(np.arange(len(q)), pa.compute.list_value_length(wanted).to_numpy())
        order = np.argsort(flat, kind="stable")
        flat, asking = flat[order], asking[order]
        for block, ids, unit in zip(*[blocks.column(c) for c in ("block", "ids", "units")], strict=True):
            rows = asking[np.searchsorted(flat, block.as_py()) : np.searchsorted(flat, block.as_py(), "right")]
            ids = ids.values
            scores = np.round(matrix[rows] @ np.frombuffer(unit.as_py(), "float64").reshape(len(ids), -1).T, 6) + 0.0
            # Ids are not in order inside a block of several steps of the angle: order them, so that a stable sort breaks ties.
            by_id = pa.compute.sort_indices(ids).to_numpy()
            places = by_id[np.argsort(-scores[:, by_id], axis=1, kind="stable")[:, :top]]
            at = np.repeat(np.arange(len(rows)), places.shape[1])
            found.append(pa.table([pa.array(q[rows[at]]), ids.take(pa.array(places.ravel())).cast(id_type), pa.array(scores[at, places.ravel()])], names))
            size += len(at)
            if size >= GATHERED:
                found, size = [first(found)], 0
        return first(found)

    cells = left.groupBy("group", "pack").cogroup(right.groupBy("group", "pack"))
    return cells.applyInArrow(best, f"q bigint, vec_id {kind.simpleString()}, score double")


def search_all(queries: DataFrame, vectors: DataFrame, top: int = 5, **options) -> tuple[DataFrame, DataFrame]:
    """Index ``vectors`` in the shared folder and search it once."""
    index = write_index(vectors, work_dir(vectors.sparkSession, "vector-index"), **options)
    return indexed_search(index, queries, top)
