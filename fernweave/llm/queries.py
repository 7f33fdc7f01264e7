"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm import bpe, embedding_dedup, hamming, html, licenses, line_dedup, lm, minhash, packing, quality
from fernweave.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_multi_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.when(F.col("embedding").isNotNull(), hamming.sign_code(F.col("embedding"))).alias("code"))
    found = hamming.top_k(codes.where("id % 100 = 0").withColumnRenamed("id", "qid"), codes, 10)
    return found.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "distance")


def op3_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("__dropped_lines").cast("long").alias("dropped_lines"))


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("places")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_order_minhash, op2_multi_index_topk, op3_log_bilinear, op4_rank_bpe, op5_line_dedup, op6_pattern_packing, op7_template_extraction, op8_license_scan, op9_quality, op10_cross_polytope)
}
