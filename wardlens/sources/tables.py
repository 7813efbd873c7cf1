"""Lazy access to the raw tables and the hospital tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardlens.session import spread
from wardlens.sources.fixtures import FIXTURES, inputs_of

# Declared schemas: no footer-inference job per scan, and a wrong file fails early.
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Inputs whose queries do heavy work per row (text, pattern rules).
TEXT_TABLES = ("documents", "conversations", "pages")
RULE_FIXTURES = ("upload_catalog", "question_log")


class Tables:
    """``tables.admissions`` etc. as unevaluated DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._build(name)
        return self._cache[name]

    def _build(self, name: str) -> DataFrame:
        if name in RAW_SCHEMAS:
            scan = self.spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")
            return spread(scan) if name in TEXT_TABLES else scan
        if name in FIXTURES:
            text = FIXTURES[name]
            inputs = {d: getattr(self, d) for d in inputs_of(text)}
            if name in RULE_FIXTURES:
                inputs = {d: spread(frame) if d in ("lineitem", "orders") else frame for d, frame in inputs.items()}
            return self.spark.sql(text, **inputs)
        raise AttributeError(name)
