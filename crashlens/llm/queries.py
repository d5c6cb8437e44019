"""Registered queries of the operators: each reads its whole table and returns the digest that its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (cross_polytope, fast_minhash, html_blocks, merkle_manifest, mixing, packing, quality_ledger, quotient_filter, substring_cover,
               target_resampling, toxicity_chain, unigram_count, warc)
from .store import new_folder


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(_table(spark, sf_dir, "pages"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ledger.quality(_table(spark, sf_dir, "documents"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_cover.substring_dedup(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_chain.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_count.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fast_minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=2)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(_table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return read.select(F.col("key").alias("page_id"), F.col("full_bytes").alias("payload_bytes"),
                       F.col("full_sha1").alias("payload_digest"), "record_type", F.col("refers_to_key").alias("refers_to"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotient_filter.exact_duplicates(_table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(_table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_main_text, op2_nearest, op3_mix, op4_quality, op5_substring, op6_toxicity, op7_token_counts, op8_pack, op9_near_dedup, op10_warc,
             op11_exact_dedup, op12_merkle, op13_resample]
    return {f.__name__: f for f in found}
