"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from unitloom.llm import chat_formatting, decontamination, embedding_dedup, license_scan, line_dedup, mixing, sharding, simhash_dedup, token_counts, toxicity
from unitloom.storage import read_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents")).drop("spans")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read_table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_formatting.formatted(read_table(spark, sf_dir, "conversations"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_token_counts, op2_license_scan, op3_embedding_dedup, op4_line_dedup, op5_toxicity, op6_decontamination, op7_sharding,
        op8_chat_formatting, op9_simhash_dedup, op10_mixing,
    )
    return {f.__name__: f for f in found}


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bi AS (
  SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0
), windows AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM bi),
sizes AS (SELECT DISTINCT k FROM windows),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k),
hits AS (
  SELECT di.doc_id, di.i, di.k, windows.item_id FROM di JOIN windows ON windows.k = di.k AND windows.g = array_to_string(list_slice(di.w, di.i, di.i + di.k - 1), ' ')
), covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id),
places AS (SELECT item_id, w, k, i AS j, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM bi),
lines AS (
  SELECT di.doc_id, p.item_id, p.w, di.k, di.i, di.i - p.j AS d, row_number() OVER (PARTITION BY di.doc_id, p.item_id, p.w, di.k, di.i - p.j ORDER BY di.i) AS r
  FROM di JOIN places p ON p.k = di.k AND p.g = array_to_string(list_slice(di.w, di.i, di.i + di.k - 1), ' ')
), runs AS (SELECT doc_id, k + count(*) - 1 AS n, min(i) - 1 AS a FROM lines GROUP BY doc_id, item_id, w, k, d, i - r),
longest AS (SELECT doc_id, max(n) AS n, min(a) FILTER (WHERE n = top) AS a FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS top FROM runs) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       CAST(coalesce(longest.n, 0) AS BIGINT) AS longest_match, CAST(coalesce(longest.a, -1) AS BIGINT) AS longest_at
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN longest USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": embedding_dedup.SQL, "op4_line_dedup": line_dedup.SQL, "op6_decontamination": OP6_SQL, "op8_chat_formatting": chat_formatting.SQL}
