"""The registered queries of this folder and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm import bpe, conversation_repair, exact, hnsw, minhash, mixing, prefix_trie, quality, samples, secrets, substrings, suffix_tree, token_counts, toxicity
from wardlens.sources.tables import RAW_SCHEMAS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


MIX_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/mix'), 1, 15))::BIGINT AS key
    FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS ceiling
    FROM totals),
ranked AS (
    SELECT *, row_number() OVER (ORDER BY ceiling / weight, source NULLS LAST) AS rank,
           (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
           / sum(weight) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed),
chosen AS (SELECT rank AS first, level AS common FROM ranked WHERE level * weight <= ceiling ORDER BY rank LIMIT 1),
targets AS (
    SELECT source, source_size, CASE WHEN common IS NULL OR rank < first THEN ceiling ELSE least(common * weight, ceiling) END AS target
    FROM ranked LEFT JOIN chosen ON true),
placed AS (
    SELECT s.doc_id, s.size, s.key, t.source_size, t.target,
           coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
           CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target / t.source_size)::BIGINT END AS epochs
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (
    SELECT *, epochs + CASE WHEN size > 0 AND 2 * start + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END AS copies FROM placed)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies, start, key FROM counted
"""


@query("op3_source_mix", MIX_SQL)
def op3_source_mix(spark, folder):
    return mixing.mix_report(table(spark, folder, "documents"))


EXACT_SQL = r"""
WITH bodies AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
grouped AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM bodies GROUP BY body)
SELECT b.doc_id, g.keep_id, g.group_size, b.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(b.body) AS text_sha256
FROM bodies b JOIN grouped g ON b.body = g.body
"""


@query("op7_exact_dedup", EXACT_SQL)
def op7_exact_dedup(spark, folder):
    return exact.exact_groups(table(spark, folder, "documents"))


@query("op5_bpe_round_trip")
def op5_bpe_round_trip(spark, folder):
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_secret_scan")
def op10_secret_scan(spark, folder):
    found = secrets.scan(table(spark, folder, "documents"))
    digest = F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest, "spans", "n_confirmed")


@query("op9_minhash_near_dedup")
def op9_minhash_near_dedup(spark, folder):
    return minhash.near_groups(table(spark, folder, "documents"), shingle=4, percent=80)


def toxicity_chain(spark, folder, docs):
    """The chain of the pipeline and of its own query: at most 20,000 labelled documents, all three categories."""
    return toxicity.fit_chain(docs, table(spark, folder, "labels"), toxicity.standard_categories(), sample=20_000)


@query("op8_toxicity_chain")
def op8_toxicity_chain(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity_chain(spark, folder, docs))


@query("op6_quality_rules")
def op6_quality_rules(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.coalesce(samples.id_crc(F.col("doc_id")) % 5 == 0, F.lit(False))
    intercept, rules = quality.fit_rules(docs, labels, F.col("quality"), where=~held_out, sample=20_000)
    scored = quality.score(docs, intercept, rules, threshold=0.3)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op1_vector_near_dedup")
def op1_vector_near_dedup(spark, folder):
    return hnsw.linked_vectors(table(spark, folder, "embeddings"), threshold=0.93)


@query("op2_substring_dedup")
def op2_substring_dedup(spark, folder):
    return substrings.remove_repeats(table(spark, folder, "documents"), window=50, digest=True)


@query("op4_suffix_tree_score")
def op4_suffix_tree_score(spark, folder):
    return suffix_tree.score(table(spark, folder, "documents"))


@query("op13_token_counts")
def op13_token_counts(spark, folder):
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@query("op11_conversation_repair")
def op11_conversation_repair(spark, folder):
    return conversation_repair.repair_report(conversation_repair.damage(table(spark, folder, "conversations")))


@query("op12_conversation_trie")
def op12_conversation_trie(spark, folder):
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))
