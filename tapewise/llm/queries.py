"""Queries of the pipeline operators over their whole tables, and reference SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapewise.llm import (bitplanes, bpe, crf_quality, dart_minhash, harmonic, kmeans_tree, merkle, norm_buckets, ordinal_toxicity, pieces, pii,
                          turns, warc)
from tapewise.llm.common import table


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.planes_round_trip(spark, table(spark, sf_dir, "documents"))


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf_quality.score(docs, crf_quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(spark, table(spark, sf_dir, "pages"))


def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal_toxicity.grade(docs, ordinal_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.nearest(table(spark, sf_dir, "embeddings"))


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op8_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_buckets.top_products(table(spark, sf_dir, "embeddings"))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic.pack_documents(table(spark, sf_dir, "documents"))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_four_russians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damage(table(spark, sf_dir, "conversations")))


def op12_merkle_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_bit_planes, op2_line_crf, op3_warc_normaliser, op4_ordinal_toxicity, op5_kmeans_tree, op6_weak_supervision,
        op7_backtracking_bpe, op8_norm_buckets, op9_harmonic_packing, op10_dart_minhash,
        op11_four_russians, op12_merkle_descent, op13_chunk_table)
}
#: Exact integer products of all pairs of a query and another row; the order makes ties definite.
_PRODUCTS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 5
"""

ORACLE: dict[str, str] = {"op8_norm_buckets": _PRODUCTS}
