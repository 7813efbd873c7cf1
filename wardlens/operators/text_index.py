"""Exact lexical search over a stored block-max inverted index.

Chunks lie in blocks of bounded size, in the order of their keys. A block row holds the postings of its words (chunk number
and count, by word) and the greatest count of each; those maxima are also stored by ranges of the word. The bounds of a
question's words add up to the best score that any chunk of a block can reach, so a question first meets its most promising
blocks, and then only those whose bound reaches the score it already has. Nothing is capped: the result is that of scoring
every chunk. A search is one plan over the stored tables and leaves none behind.

An index is a folder of segments and a manifest. A segment may be appended again under its name, which replaces it, and
segments can be merged into one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from wardlens.functions.scalars import scalar
from wardlens.functions.tokens import tokens
from wardlens.session import ship_by_value

ship_by_value(__name__)

#: Chunks and words of a block at most (a longer chunk is a block of its own), questions that meet a block in one row,
#: blocks that a question meets first.
BLOCK_CHUNKS, BLOCK_WORDS, QUESTION_ROWS, FIRST_BLOCKS = 1_024, 500_000, 500, 2
MATCH_WEIGHT, PHRASE_BONUS = 0.5, 2.0


@dataclass
class TextIndex:
    """An index folder: chunk keys, and readers of what its manifest lists."""

    spark: SparkSession
    path: str
    keys: list[str]

    def _manifest(self) -> DataFrame:
        return self.spark.read.schema("name string, folder string, version int").parquet(f"{self.path}/manifest")

    def version(self) -> int:
        return self._manifest().agg(F.max("version")).first()[0]

    def live(self) -> DataFrame:
        """``name, folder`` of the segments of the last version."""
        listed = self._manifest()
        return listed.where(F.col("version") == scalar(listed, F.max("version"))).select("name", "folder")

    def _read(self, kind: str) -> DataFrame:
        # Only folders named by the manifest are read; the planner prunes the others while it runs.
        return self.spark.read.parquet(f"{self.path}/{kind}").join(self.live().select("folder"), "folder", "left_semi")

    def blocks(self) -> DataFrame:
        return self._read("blocks")

    def bounds(self) -> DataFrame:
        return self._read("bounds")


def _partitions(frame: DataFrame) -> int:
    """The cluster's number of shuffle partitions, given by name where rows are few and heavy, so that they are not put together."""
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _pack(rows: DataFrame, keys: list[str], words, block_chunks: int) -> DataFrame:
    """Blocks from ``keys..., text`` and the words of the text: dealt by ranges of the keys, split into words and cut where they arrive."""
    ready = rows.select(F.struct(*keys).alias("id"), "text")
    ordered = ready.repartitionByRange(_partitions(rows), "id").sortWithinPartitions("id").select("id", words(F.col("text")))
    id_type = ready.schema["id"].dataType
    id_arrow = to_arrow_type(id_type)
    names = ["block", "least", "ids", "said", "tokens", "most", "starts", "places", "counts"]
    types = [pa.string(), id_arrow, pa.list_(id_arrow), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held, rows, words = [], 0, 0

        def flush():
            nonlocal seq, held, rows, words
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, listed = whole.column(0).combine_chunks(), whole.column(1).combine_chunks()
            n = len(ids)
            coded = listed.flatten().dictionary_encode()
            # Postings in the order of (word, chunk), with the count of each.
            entries = coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), pa.compute.list_value_length(listed).to_numpy())
            entries, counts = np.unique(entries, return_counts=True)
            starts = np.searchsorted(entries, np.arange(len(coded.dictionary) + 1) * n).astype(np.int32)
            most = np.maximum.reduceat(counts, starts[:-1]) if len(counts) else counts
            one = lambda array: pa.ListArray.from_arrays([0, len(array)], array)
            packed = [x.astype(np.int32).tobytes() for x in (starts, entries % max(n, 1), counts)]
            row = [
                pa.array([f"{part}-{seq}"]), ids.slice(0, 1), one(ids), one(pa.compute.binary_join(listed, " ")), one(coded.dictionary), one(pa.array(most.astype(np.int32))),
                *[pa.array([x], pa.binary()) for x in packed],
            ]
            seq, held, rows, words = seq + 1, [], 0, 0
            return pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(row, types, strict=True)], names)

        for batch in batches:
            sizes, at = pa.compute.list_value_length(batch.column(1)).to_numpy(), 0
            while at < batch.num_rows:
                fits = int(np.searchsorted(np.cumsum(sizes[at : at + block_chunks]), BLOCK_WORDS - words, side="right"))
                take = min(block_chunks - rows, max(fits, 0 if rows else 1), batch.num_rows - at)
                if take <= 0:
                    yield flush()
                    continue
                held.append(batch.slice(at, take))
                rows, words, at = rows + take, words + int(sizes[at : at + take].sum()), at + take
                if rows >= block_chunks:
                    yield flush()
        if held:
            yield flush()

    name = id_type.simpleString()
    schema = f"block string, least {name}, ids array<{name}>, said array<string>, tokens array<string>, most array<int>, starts binary, places binary, counts binary"
    return ordered.mapInArrow(run, schema)


def _write_segment(rows: DataFrame, path: str, keys: list[str], words, block_chunks: int) -> str:
    """Write blocks and bounds of one segment and return its folder; nothing reads it before a manifest names it."""
    spark, folder = rows.sparkSession, uuid.uuid4().hex
    _pack(rows, keys, words, block_chunks).withColumn("block", F.concat(F.lit(f"{folder}/"), "block")).write.parquet(f"{path}/blocks/folder={folder}")
    blocks = spark.read.parquet(f"{path}/blocks/folder={folder}")
    bounds = blocks.select("block", "least", F.inline(F.arrays_zip("tokens", "most")))
    bounds.withColumnRenamed("tokens", "token").repartitionByRange("token", "block").sortWithinPartitions("token").write.parquet(f"{path}/bounds/folder={folder}")
    return folder


def _words(text: Column) -> Column:
    return F.coalesce(tokens(text), F.array().cast("array<string>"))


def _joined(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def _named(spark: SparkSession, segment: str, folder: str) -> DataFrame:
    return spark.range(1).select(F.lit(segment).alias("name"), F.lit(folder).alias("folder"))


def _commit(spark: SparkSession, path: str, version: int, segments: DataFrame) -> None:
    segments.select("name", "folder").coalesce(1).write.parquet(f"{path}/manifest/version={version}")


def write_text_index(chunks: DataFrame, keys: list[str], path: str, text: str = "text", segment: str = "first", block_chunks: int = BLOCK_CHUNKS) -> TextIndex:
    """A new index of one segment. Null texts have no words; chunks are told apart by ``keys``."""
    spark = chunks.sparkSession
    folder = _write_segment(chunks.select(*keys, F.col(text).alias("text")), path, keys, _words, block_chunks)
    _commit(spark, path, 1, _named(spark, segment, folder))
    return TextIndex(spark, path, keys)


def append_segment(index: TextIndex, chunks: DataFrame, segment: str, text: str = "text", block_chunks: int = BLOCK_CHUNKS) -> None:
    """Add a segment, such as the chunks of one workspace; a segment of that name is replaced, so a replay changes nothing.

    One writer at a time. A write that is broken off leaves an unnamed folder and the index as it was.
    """
    spark, version = index.spark, index.version()
    folder = _write_segment(chunks.select(*index.keys, F.col(text).alias("text")), index.path, index.keys, _words, block_chunks)
    others = index.live().where(F.col("name") != segment)
    _commit(spark, index.path, version + 1, others.unionByName(_named(spark, segment, folder)))


def merge_segments(index: TextIndex, segment: str = "merged", block_chunks: int = BLOCK_CHUNKS) -> None:
    """Write all segments as one, from their stored words; later searches read it alone."""
    version = index.version()
    each = index.blocks().select(F.explode(F.arrays_zip("ids", "said")).alias("entry")).select("entry.ids.*", "entry.said")
    folder = _write_segment(each.select(*index.keys, F.col("said").alias("text")), index.path, index.keys, _joined, block_chunks)
    _commit(index.spark, index.path, version + 1, _named(index.spark, segment, folder))


def _meet(pairs: DataFrame, asked: DataFrame, blocks: DataFrame, question: str, top: int) -> DataFrame:
    """The best ``top`` chunks of each (question, block) pair: ``question, hit, score``. A row holds a block and a bounded list of questions."""
    wanted = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUESTION_ROWS).alias("lists"))
    salted = pairs.select(question, "block").join(wanted, "block").join(asked, question)
    item = F.struct(F.col(question).alias("q"), "terms", "phrase", "inner")
    lists = salted.groupBy("block", F.pmod(F.xxhash64(question), F.col("lists")).alias("list")).agg(F.collect_list(item).alias("asked"))
    both = lists.repartition(_partitions(pairs), "block").join(blocks.select("block", "ids", "said", "tokens", "starts", "places", "counts"), "block").select("asked", "ids", "said", "tokens", "starts", "places", "counts")
    q_kind, id_kind = asked.schema[question].dataType, blocks.schema["ids"].dataType.elementType
    schema = StructType().add("q", q_kind).add("hit", id_kind).add("score", "double")

    def scored(block, row):
        terms = row.field("terms")
        words = terms.values
        offsets = terms.offsets.to_numpy()
        found = pa.compute.fill_null(pa.compute.index_in(words.field("token"), value_set=block["tokens"]), -1).to_numpy()
        wanted_n = words.field("n").to_numpy(zero_copy_only=False)
        phrases, inner = row.field("phrase").to_pylist(), row.field("inner").to_pylist()
        starts, places, counts, said = block["starts"], block["places"], block["counts"], block["said"]
        for i in range(len(row)):
            t, n = found[offsets[i] : offsets[i + 1]], wanted_n[offsets[i] : offsets[i + 1]]
            t, n = t[t >= 0], n[t >= 0]
            sizes = starts[t + 1] - starts[t]
            entry = np.repeat(starts[t] - np.concatenate(([0], np.cumsum(sizes[:-1]))), sizes) + np.arange(sizes.sum())
            at = places[entry]
            total = np.bincount(at, np.minimum(counts[entry], np.repeat(n, sizes)) + MATCH_WEIGHT, len(said))
            matched = np.bincount(at, minlength=len(said))
            # All inner words of the phrase must be matched before any text is compared.
            for place in np.flatnonzero(matched >= max(inner[i], 1)).tolist():
                if phrases[i] in said[place]:
                    total[place] += PHRASE_BONUS
            some = np.flatnonzero(matched)
            kept = some[np.argsort(-total[some], kind="stable")[:top]]
            yield i, kept, total[kept]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                value = lambda name: batch.column(name)[i]  # noqa: B023, E731
                array = lambda name: np.frombuffer(value(name).as_py(), np.int32)  # noqa: B023, E731
                row, ids = value("asked").values, value("ids").values
                block = {"tokens": value("tokens").values, "said": value("said").as_py(), "starts": array("starts"), "places": array("places"), "counts": array("counts")}
                who, where, score = [], [], []
                for q, kept, totals in scored(block, row):
                    who += [q] * len(kept)
                    where += kept.tolist()
                    score += totals.tolist()
                if who:
                    hits = [row.field("q").take(pa.array(who)), ids.take(pa.array(where)), pa.array(score, pa.float64())]
                    yield pa.RecordBatch.from_arrays(hits, ["q", "hit", "score"])

    return both.mapInArrow(run, schema).withColumnRenamed("q", question)


def _first_hits(index: TextIndex, questions: DataFrame, question: str, question_text: str, top: int):
    """What a search begins with: questions, blocks, their order per question, the first hits and the scores they set."""
    asked, blocks = _asked(questions.select(question, tokens(question_text).alias("words")), question), index.blocks()
    promise = Window.partitionBy(question).orderBy(F.desc("reach"), "least", "block")
    first = _reach(asked, index.bounds(), question).withColumn("nth", F.row_number().over(promise))
    seeds = _meet(first.where(F.col("nth") <= FIRST_BLOCKS), asked, blocks, question, top)
    place = F.row_number().over(Window.partitionBy(question).orderBy(F.desc("score"), "hit"))
    floors = seeds.withColumn("place", place).where(F.col("place") == top).select(question, F.col("score").alias("floor"), F.col("hit").alias("last"))
    short = (F.col("reach") < F.col("floor")) | ((F.col("reach") == F.col("floor")) & (F.col("least") > F.col("last")))
    left = first.where(F.col("nth") > FIRST_BLOCKS).join(floors, question, "left").where(F.col("floor").isNull() | ~short)
    return asked, blocks, first, seeds, left


def search(index: TextIndex, questions: DataFrame, question: str, question_text: str = "text", top: int = 5) -> DataFrame:
    """The ``top`` chunks of every question: ``(question, rank, keys, score)``.

    Score = sum of min(word counts) + half the distinct words in common + 2 when the question's words, joined, occur in the
    chunk's words, joined. Only chunks sharing a word are scored; ties go to the smaller keys. Questions have distinct ids.
    """
    asked, blocks, _, seeds, left = _first_hits(index, questions, question, question_text, top)
    hits = seeds.unionByName(_meet(left, asked, blocks, question, top))
    rank = F.row_number().over(Window.partitionBy(question).orderBy(F.desc("score"), "hit"))
    ranked = hits.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select(question, "rank", "hit.*", F.round("score", 4).alias("score"))


def blocks_met(index: TextIndex, questions: DataFrame, question: str, question_text: str = "text", top: int = 5) -> DataFrame:
    """``question, met, blocks``: blocks that a search of the question reads, of all blocks of the index."""
    _, blocks, first, _, left = _first_hits(index, questions, question, question_text, top)
    read = first.where(F.col("nth") <= FIRST_BLOCKS).select(question).unionByName(left.select(question))
    return read.groupBy(question).agg(F.count(F.lit(1)).alias("met")).withColumn("blocks", scalar(blocks, F.count(F.lit(1))))


def _asked(listed: DataFrame, question: str) -> DataFrame:
    """``question, terms, phrase, inner``: distinct words with counts, all words joined, distinct words that are neither first nor last."""
    words = listed.where(F.size("words") > 0)
    counts = words.select(question, F.explode("words").alias("token")).groupBy(question, "token").agg(F.count(F.lit(1)).cast("int").alias("n"))
    terms = counts.groupBy(question).agg(F.collect_list(F.struct("token", "n")).alias("terms"))
    # The first and last word may match inside a longer word.
    inner = F.size(F.array_distinct(F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0)))))
    return words.select(question, F.array_join("words", " ").alias("phrase"), inner.alias("inner")).join(terms, question)


def _reach(asked: DataFrame, bounds: DataFrame, question: str) -> DataFrame:
    """``question, block, least, reach``: the best score that a chunk of the block can have."""
    terms = asked.select(question, "inner", F.explode("terms").alias("term")).select(question, "inner", "term.token", "term.n")
    summed = (
        terms.join(bounds.select("token", "block", "least", "most"), "token")
        .groupBy(question, "block")
        .agg(F.min("least").alias("least"), F.sum(F.least("n", "most") + MATCH_WEIGHT).alias("words"), F.count(F.lit(1)).alias("matched"), F.min("inner").alias("inner"))
    )
    bonus = F.when(F.col("matched") >= F.col("inner"), PHRASE_BONUS).otherwise(0.0)
    return summed.select(question, "block", "least", (F.col("words") + bonus).alias("reach"))
