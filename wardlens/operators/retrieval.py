"""Lexical and vector retrieval for batches of questions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from wardlens.functions.scalars import col, strip
from wardlens.functions.tokens import STOPWORDS, TOKEN, tokens  # noqa: F401
from wardlens.operators import text_index
from wardlens.operators.documents import clean_document_text
from wardlens.session import ship_by_value, stored, work_dir

ship_by_value(__name__)

# Result size, summary words, acceptance thresholds.
TOP = 5
SUMMARY_WORDS = ("summarize", "summarise", "summary", "overview", "overall")
ACCEPT, LEAD, CONFIDENCE_CAP = 0.62, 0.05, 0.86
EXCERPT, EXCERPTS = 700, 3
# Vectors and queries held by a task at a time, vectors that are worth a task, and rows a block may number beside a score of six digits.
BLOCK_BYTES, QUERY_BYTES, TASK_BYTES, PLACES = 32_000_000, 2_000_000, 1_000_000, 1 << 40


def tokenize(table: DataFrame, key: str, text: str = "text") -> DataFrame:
    listed = table.select(key, tokens(text).alias("words"))
    return listed.select(key, F.size("words").alias("token_count"), F.array_join("words", " ").alias("tokens"))


def lexical_search(
    questions: DataFrame, chunks: DataFrame, question: str, keys: list[str], question_text: str = "text", text: str = "text", top: int = TOP, path: str | None = None,
) -> DataFrame:
    """Index ``chunks`` at ``path`` (default: the shared folder) and search the index once; see ``text_index``."""
    index = text_index.write_text_index(chunks, keys, path or work_dir(chunks.sparkSession, "text-index"), text)
    return text_index.search(index, questions, question, question_text, top)


def _ranked(scored: DataFrame, question: str, keys: list[str], top: int) -> DataFrame:
    """Best ``top`` per question; tasks keep only their own best before the shuffle."""
    order = Window.partitionBy(question).orderBy(F.desc("score"), *keys)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(question, "rank", *keys, "score")


def select_documents(requests: DataFrame, documents: DataFrame, request: str = "request_id", name: str = "requested_name") -> DataFrame:
    """Documents a request names: equal names, or a request ending in ``_`` plus the name, letter case aside.

    Every ending after an underscore is listed, which makes the test an equality join.
    """
    base = F.lower(F.substring_index(F.col(name), "/", -1))
    parts = F.split(base, "_", -1)
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_"))
    wanted = requests.select(request, F.explode(F.array_distinct(endings)).alias("key_"))
    named = documents.withColumn("key_", F.lower("document_name"))
    return wanted.join(named, "key_").drop("key_")


def is_summary_question(question: str | Column) -> Column:
    words = F.regexp_extract_all(F.lower(col(question)), F.lit("[A-Za-z]+"), F.lit(0))
    return F.arrays_overlap(words, F.lit(list(SUMMARY_WORDS)))


def summary_sample(chunks: DataFrame, keep: int = TOP) -> DataFrame:
    """All chunks of a document with up to ``keep``, else that many evenly spaced ones.

    Reads ``chunk_id`` and ``chunk_count``, so no window is needed.
    """
    last = F.col("chunk_count") - 1
    places = F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda i: F.bround(i * last / F.lit(float(keep - 1))).cast("int"))
    return chunks.where((F.col("chunk_count") <= keep) | F.array_contains(places, F.col("chunk_id") - 1))


def _unit_rows(vectors) -> np.ndarray:
    matrix = np.stack(vectors).astype("float64")
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _blocks(rows, key: str, size: int = BLOCK_BYTES) -> Iterator[tuple[list, np.ndarray]]:
    """Keys and unit vectors of a streamed frame, in blocks of at most ``size`` bytes."""
    keys, vectors, held = [], [], 0
    for row in rows.toLocalIterator():
        keys.append(row[key])
        vectors.append(np.array(row["embedding"], dtype="float64"))
        held += vectors[-1].nbytes
        if held >= size:
            yield keys, _unit_rows(vectors)
            keys, vectors, held = [], [], 0
    if keys:
        yield keys, _unit_rows(vectors)


def _packed(rows: DataFrame, key: str, blocks: int, copies: int) -> DataFrame:
    """``block, members``: all rows in blocks of bounded size, each an array in the order of the key.

    Of rows equal in key and vector no more than ``copies`` can be in a result; the others are dropped before.
    """
    single = rows.groupBy(key, "embedding").agg(F.least(F.count(F.lit(1)), F.lit(copies)).cast("int").alias("n_"))
    each = single.select(F.struct(F.col(key).alias("key"), "embedding").alias("member"), F.pmod(F.xxhash64(key, "embedding"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(1), F.col("n_"))))
    return each.groupBy("block").agg(F.sort_array(F.collect_list("member")).alias("members"))


def vector_search(queries: DataFrame, vectors: DataFrame, top: int = TOP, block_bytes: int = QUERY_BYTES, vector_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Cosine top ``top``: ``(query_id, rank, vec_id, score)``; a zero vector scores 0. Ids may have any orderable type.

    Queries and vectors are packed into blocks of about ``block_bytes`` and at most about ``vector_bytes`` (as doubles),
    written to the shared folder, and every pair of blocks meets in one task. A task multiplies tiles of its two blocks
    and keeps one running best per query, so it returns at most ``top`` rows per query and never holds a score for every
    pair. The driver sees two sizes and no vector.
    """
    size = lambda rows: rows.agg(F.sum(F.size("embedding").cast("long") * 8)).first()[0] or 0
    asked, given = size(queries), size(vectors)
    query_blocks = max(1, -(-asked // block_bytes))
    # Few queries: more, smaller blocks of vectors, so that there are tasks enough.
    vector_blocks = max(1, -(-given // vector_bytes), -(-given // (TASK_BYTES * query_blocks)))
    kinds = StructType([queries.schema["query_id"], vectors.schema["vec_id"], StructField("score", DoubleType())])
    left = stored(_packed(queries.select("query_id", "embedding"), "query_id", query_blocks, top), "query-blocks")
    right = stored(_packed(vectors.select("vec_id", "embedding"), "vec_id", vector_blocks, top), "vector-blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.select(F.col("block").cast("int").alias("q"), every(vector_blocks).alias("v"), "members")
    right = right.select(every(query_blocks).alias("q"), F.col("block").cast("int").alias("v"), "members")
    scored = left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInArrow(_best_of(top, kinds), kinds)
    return _ranked(scored, "query_id", ["vec_id"], top)


def _members(block: pa.Table) -> tuple[pa.Array, np.ndarray]:
    rows = block.column("members").combine_chunks().flatten()
    return rows.field("key"), _unit_rows(rows.field("embedding").to_numpy(zero_copy_only=False))


def _best_of(top: int, kinds: StructType):
    query_type, vec_type = (to_arrow_type(f.dataType) for f in kinds.fields[:2])

    def best(asked: pa.Table, given: pa.Table) -> pa.Table:
        if not asked.num_rows or not given.num_rows:
            return pa.table([pa.array([], t) for t in (query_type, vec_type, pa.float64())], kinds.names)
        (keys, matrix), (ids, unit) = _members(asked), _members(given)
        # A score of six digits and the place, packed so that the largest number is the best pair; ids are in order, so the
        # place breaks ties as the id does.
        held = np.full((len(keys), top), np.iinfo(np.int64).min)
        for q in range(0, len(keys), 256):
            for at in range(0, len(ids), 1024):
                part = unit[at : at + 1024]
                place = PLACES - 1 - (at + np.arange(len(part)))
                packed = np.rint(np.round(matrix[q : q + 256] @ part.T, 6) * 1_000_000).astype(np.int64) * PLACES + place
                both = np.concatenate((held[q : q + 256], packed), axis=1)
                held[q : q + 256] = np.partition(both, both.shape[1] - top, axis=1)[:, -top:]
        q, _ = np.nonzero(held > np.iinfo(np.int64).min)
        score, place = np.divmod(held[held > np.iinfo(np.int64).min], PLACES)
        return pa.table([keys.take(pa.array(q)).cast(query_type), ids.take(pa.array(PLACES - 1 - place)).cast(vec_type), pa.array(score / 1_000_000)], kinds.names)

    return best


def prototype_classify(vectors: DataFrame, prototypes: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Label of the most similar prototype, accepted when close enough and clearly ahead.

    ``prototypes`` (label, embedding) may have labels of any orderable type, structs too; a label scores as its best
    example. They are streamed through the driver in blocks, each of them a broadcast. Each block names its two best labels
    per vector; a label that is among the two best of all is among the two best of the block that holds its best example.
    """
    spark = vectors.sparkSession
    label = prototypes.schema["label"]
    named = StructType([vectors.schema["vec_id"], StructField("label_no", LongType()), StructField("score", DoubleType())])
    rows, parts, labels = vectors.select("vec_id", "embedding"), [], []
    for keys, matrix in _blocks(prototypes.select("label", "embedding").orderBy("label"), "label", block_bytes):
        starts = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
        # A label may go on in the next block, under the same number.
        first = len(labels) - (1 if labels and labels[-1] == keys[0] else 0)
        labels[first:] = [keys[i] for i in starts]
        parts.append(rows.mapInArrow(_two_best(spark.sparkContext.broadcast((first, np.array(starts), matrix)), named), named))
    if not parts:
        scored = spark.createDataFrame([], named)
    else:
        scored = parts[0] if len(parts) == 1 else reduce(DataFrame.unionAll, parts).groupBy("vec_id", "label_no").agg(F.max("score").alias("score"))
    order = F.struct((-F.col("score")).alias("s"), "label_no")
    best = scored.groupBy("vec_id").agg(F.array_sort(F.collect_list(order)).alias("order")).select(  # at most two per block
        "vec_id", F.col("order")[0]["label_no"].alias("label_no"), (-F.col("order")[0]["s"]).alias("score"),
        F.coalesce(-F.get("order", F.lit(1))["s"], F.lit(-1.0)).alias("runner_up"),
    )
    names = spark.createDataFrame([(i, k) for i, k in enumerate(labels)], StructType([StructField("label_no", LongType()), StructField("best_label", label.dataType)]))
    lead = F.round(F.col("score") - F.col("runner_up"), 6)
    accepted = (F.col("score") >= ACCEPT) & ((lead >= LEAD) | (F.col("runner_up") == -1.0))
    return best.join(names, "label_no", "left").select(
        "vec_id",
        F.when(accepted, F.col("best_label")).alias("label"),
        "score",
        lead.alias("lead"),
        F.when(accepted, F.least(F.greatest("score", F.lit(ACCEPT)), F.lit(CONFIDENCE_CAP))).alias("confidence"),
    )


def _two_best(shared, named: StructType):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, starts, matrix = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                near = _unit_rows(part.column("embedding").to_numpy(zero_copy_only=False)) @ matrix.T
                scores = np.round(np.maximum.reduceat(near, starts, axis=1), 6)
                ranked = np.argsort(-scores, axis=1, kind="stable")[:, :2]
                row = np.repeat(np.arange(part.num_rows), ranked.shape[1])
                found = np.take_along_axis(scores, ranked, axis=1).ravel()
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(row)), pa.array(first + ranked.ravel()), pa.array(found)], named.names)

    return best


def _place(otherwise: str) -> Column:
    """Where a passage stands: page, table, paragraph or elsewhere."""
    page, section, table = F.col("page_number"), F.col("section"), F.col("table_number")
    return (
        F.when(page.isNotNull(), F.concat(F.lit("Page "), page))
        .when((section == "table") & table.isNotNull(), F.concat(F.lit("Table "), table))
        .when(section == "paragraph", "Paragraph")
        .otherwise(otherwise)
    )


def _joined(hits: DataFrame, question: str, line: Column, name: str) -> DataFrame:
    """Lines of one question in rank order; a question has at most its top hits."""
    listed = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.groupBy(question).agg(F.array_join(F.transform(listed, lambda h: h.getField("line")), "\n\n").alias(name))


def assemble_context(hits: DataFrame, question: str) -> DataFrame:
    """Context passages per question: numbered by source, and labelled by place.

    Hits carry ``rank, text, page_number, section, table_number``.
    """
    page = F.when(F.col("page_number").isNotNull(), F.concat(F.lit("Page "), F.col("page_number"))).otherwise("Document section")
    text = F.coalesce("text", F.lit(""))
    numbered = F.concat(F.lit("[SOURCE "), F.col("rank"), F.lit(" - "), page, F.lit("]\n"), text)
    stripped = strip(text)
    labelled = F.when(stripped != "", F.concat(_place("Document section"), F.lit(":\n"), stripped))
    return _joined(hits, question, numbered, "numbered_context").join(_joined(hits, question, labelled, "labelled_context"), question)


def extractive_answer(hits: DataFrame, question: str) -> DataFrame:
    """The first passages, cut to a readable length, in both answer layouts."""
    first = hits.where(F.col("rank") <= EXCERPTS)
    clean = clean_document_text(F.coalesce("text", F.lit("")))
    shown = F.when(F.length(clean) > EXCERPT, F.concat(F.rtrim(F.substring(clean, 1, EXCERPT)), F.lit("..."))).otherwise(clean)
    source = F.when(F.col("page_number").isNotNull(), F.concat(F.lit("Source "), F.col("rank"), F.lit(" (Page "), F.col("page_number"), F.lit(")"))).otherwise(
        F.concat(F.lit("Source "), F.col("rank"))
    )
    stripped = strip(F.coalesce("text", F.lit("")))
    labelled = F.when(stripped != "", F.concat(F.lit("["), _place("Document section"), F.lit("] "), F.substring(stripped, 1, EXCERPT)))
    return _joined(first, question, F.concat(source, F.lit(":\n"), shown), "sourced_answer").join(
        _joined(first, question, labelled, "labelled_answer"), question
    )


def source_list(hits: DataFrame, question: str) -> DataFrame:
    return hits.select(
        question,
        "rank",
        F.coalesce("document_name", F.lit("Hospital document")).alias("file_name"),
        F.lit("Uploaded document").alias("type"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "page_number",
    )
