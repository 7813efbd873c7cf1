"""Near-dedup by min-max hashing: the least and the greatest value under each permutation, banded.

Keeping both ends gives two signature values for one evaluation. Bands propose,
full shingle sets decide. Documents with equal sets are one class and only the
smallest takes part, so copies cost nothing beyond an aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.components import components
from wardlens.llm.words import mixed, shingle_sets, text_slices
from wardlens.session import ship_by_value, stored

ship_by_value(__name__)


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of n permutations of the 32-bit numbers."""
    values = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return (values[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (values[n:] >> np.uint64(32)).astype(np.uint32)


def min_max(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Signatures of non-empty sets: a row of n minima and n maxima each, minimum and maximum of a permutation side by side."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), 2 * n), np.uint32)
    for k, (factor, offset) in enumerate(zip(*permutations(n), strict=True)):
        values = low * factor
        values += offset
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        out[:, 2 * k] = np.minimum.reduceat(values, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(values, starts)
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` values; the band's number is part of the key."""
    bands = signatures.shape[1] // rows
    cut = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), cut.shape[:2]).copy()
    for r in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, r])
    return key


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int, id_column: str, text_column: str) -> DataFrame:
    """``id, n_shingles, set_a, set_b`` (a 128-bit hash of the set) and ``keys``; null set and keys without words."""
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    hashes = bands * rows // 2

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = shingle_sets(part.column("text"), shingle)
                filled = [i for i, s in enumerate(sets) if len(s)]
                place = np.full(len(sets), -1)
                place[filled] = np.arange(len(filled))
                keys, digests = np.zeros((0, bands), np.uint64), np.zeros((0, 2), np.uint64)
                if filled:
                    some = [sets[i] for i in filled]
                    keys = band_keys(min_max(some, hashes), rows)
                    digests = np.array([(s.sum(), mixed(s * np.uint64(0x9E3779B97F4A7C15)).sum()) for s in some], np.uint64)
                none = place < 0
                column = lambda j: pa.array(np.where(none, 0, digests[place, j]).astype(np.int64) if filled else np.zeros(len(sets), np.int64), mask=none)  # noqa: B023, E731
                lists = pa.array([None if p < 0 else keys[p].view(np.int64) for p in place.tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(s) for s in sets], pa.int64()), column(0), column(1), lists], ["id", "n_shingles", "set_a", "set_b", "keys"]
                )

    return texts.mapInArrow(run, f"id {kind}, n_shingles bigint, set_a bigint, set_b bigint, keys array<bigint>")


#: 64 bits each: a sketch has one bit per signature value.
SKETCH_LONGS = 32


def most_different(percent: int) -> int:
    """Differing sketch bits of a pair at the bound, plus five standard deviations."""
    n, p = 64 * SKETCH_LONGS, (1 - percent / 100) / 2
    return int(n * p + 5 * (n * p * (1 - p)) ** 0.5) + 1


def sketches(texts: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """``id, keys, s0, s1, ...``: the band keys, and the lowest bit of each value of a longer min-max signature."""
    kind = texts.schema["id"].dataType.simpleString()
    names = [f"s{i}" for i in range(SKETCH_LONGS)]

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = [s if len(s) else np.zeros(1, np.uint64) for s in shingle_sets(part.column("text"), shingle)]
                packed = np.packbits((min_max(sets, 32 * SKETCH_LONGS) & np.uint32(1)).astype(bool), axis=1).view(np.int64)
                keys = band_keys(min_max(sets, bands * rows // 2), rows).view(np.int64)
                lists = pa.array(list(keys), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, *[pa.array(packed[:, i]) for i in range(SKETCH_LONGS)]], ["id", "keys", *names])

    return texts.mapInArrow(run, f"id {kind}, keys array<bigint>, " + ", ".join(f"{n} bigint" for n in names))


def similar_pairs(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets have 100 * intersection >= percent * union. ``texts`` has ``id, text`` of all of them."""
    kind = texts.schema["id"].dataType.simpleString()
    left, right = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text_a"):
                one = shingle_sets(part.column("text_a"), shingle)
                keep = []
                at = 0
                for other in text_slices(part.select(["text_b"]), "text_b"):
                    for s in shingle_sets(other.column("text_b"), shingle):
                        common = len(np.intersect1d(one[at], s, assume_unique=True))
                        keep.append(100 * common >= percent * (len(one[at]) + len(s) - common))
                        at += 1
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def near_groups(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per id: ``id, n_shingles, component_id, kept``.

    Words are lower-cased in A-Z; a document's set holds its distinct shingles, or all its words as one if it has fewer.
    Two documents are linked when their sets share at least ``percent`` of a hundred of their union; ``component_id``
    is the smallest id reachable. With 32 bands of 4 values a link at the bound is proposed with probability
    1 - 5e-8, one above it still more surely. A pair that is not yet connected may be passed over when 2048 sketch bits
    differ by more than five standard deviations from what they would at the bound (3e-7 of such pairs). Proposed links
    are confirmed on full sets taken from whole texts.

    * Null and empty texts, and texts of white space, have no set and link with nothing: they are their own component.
    * A row without an id takes no part and is returned with null ``component_id`` and ``kept`` true.
    * Rows that repeat an id count as one document, whose links are those of any of its texts; each row is returned.
    * Other columns are not read. An empty table gives an empty result.
    """
    known = stored(signatures(docs, shingle, bands, rows, id_column, text_column), "signatures")
    named = known.where("id IS NOT NULL AND set_a IS NOT NULL")
    classes = stored(
        named.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.any_value("keys").alias("keys"), F.first("n_shingles").alias("n")), "set-classes"
    )
    # Every band of every class, where the band has company.
    places = classes.select(F.explode("keys").alias("key"), "rep", "n")
    company = stored(places.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "bands")
    shared = stored(places.join(company, "key"), "shared-bands")
    # The hub of a band is its member with most company over all its bands: what copies were made from rather than one of them.
    weight = stored(shared.groupBy("rep").agg(F.sum("members").alias("weight")), "weights")
    hubs = stored(shared.join(weight, "rep").groupBy("key").agg(F.max_by("rep", F.struct("weight", "rep")).alias("hub")), "hubs")
    texts = stored(
        docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
        .join(weight.select(F.col("rep").alias("id")), "id", "left_semi"),
        "candidate-texts",
    )

    # First each member against its hubs: that joins almost all that belongs together.
    stars = shared.join(hubs, "key").where("rep <> hub").select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct()
    found = stored(similar_pairs(stars, texts, shingle, percent), "star-links")
    grouped = stored(components(found), "star-components").toDF("rep", "component")
    # Then, in bands that still hold several components, pairs across components, unless their sketches rule them out.
    placed = shared.join(grouped, "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    split = stored(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"), "split-bands")
    bits = [f"s{i}" for i in range(SKETCH_LONGS)]
    rest = stored(placed.join(split, "key", "left_semi").join(sketches(texts, shingle, bands, rows), F.col("rep") == F.col("id")).drop("id"), "split-places")
    one, two = (rest.select("key", F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "component", "keys", *bits)]) for x in "ab")
    differ = " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in bits)
    likely = f"a > b AND component_a <> component_b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) AND {differ} <= {most_different(percent)}"
    once = F.array_min(F.array_intersect("keys_a", "keys_b")) == one["key"]  # in one of the bands they share
    pair = one.join(two, (one["key"] == two["key"]) & F.expr(likely) & once).select("a", "b").distinct()
    links = found.union(stored(similar_pairs(pair, texts, shingle, percent), "cross-links"))
    # An id that occurs with several texts belongs to several classes: its classes are one document's.
    of_ids = named.select("id", "set_a", "set_b").join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"])
    repeated = named.groupBy("id").count().where("count > 1").select("id")
    bridges = of_ids.join(repeated, "id", "left_semi").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    final = stored(components(links.union(bridges)), "components").toDF("rep", "component")
    own = known.join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"], "left").join(final, "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return own.select(
        F.col("id").alias(id_column), "n_shingles", F.when(F.col("id").isNotNull(), component).alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"),
    )


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: those of the smallest id of each component.

    Rows without ids and texts without words stay. Where a kept id is repeated, all its rows stay.
    """
    kept = near_groups(docs, id_column=id_column, text_column=text_column, **parameters).where("kept").select(F.col(id_column).alias("kept_id")).distinct()
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    return docs.select(F.col(id_column).alias("id"), row).join(kept, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")
