"""The registered queries of the thirteen operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, conversation_trie, decontamination, hyperminhash, langid, license_scan, line_dedup, packing, spotsigs, token_counts, topk, vector_codes
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat_format.embedded(chat_format.tool_messages(table(spark, sf_dir, "conversations")))
    return chat_format.link_all(calls, results, chat_format.TOOLS)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 20 = 0"), 20)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(table(spark, sf_dir, "documents"))


def near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search side of ``op9_spot_signatures``: every document's class of equal fingerprints and its links at 0.75 or more."""
    return spotsigs.near_fingerprints(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.report(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_packing, op3_near_duplicates, op4_token_counts, op5_tool_calls, op6_bpe_round_trip, op7_exact_topk, op8_license_scan, op9_spot_signatures, op10_line_dedup, op11_prefix_trie, op12_vector_codes, op13_decontamination, near_fingerprints)}


def oracle_sql() -> dict[str, str]:
    return {"op5_tool_calls": chat_format.ORACLE_SQL, "op7_exact_topk": OP7_SQL, "op9_spot_signatures": spotsigs.oracle_sql(), "near_fingerprints": spotsigs.near_sql(), "op10_line_dedup": line_dedup.ORACLE_SQL, "op11_prefix_trie": conversation_trie.ORACLE_SQL, "op12_vector_codes": vector_codes.ORACLE_SQL, "op13_decontamination": decontamination.ORACLE_SQL}
