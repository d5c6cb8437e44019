"""From raw documents to packed training sequences.

``STAGES`` are functions (spark, docs, sf_dir) -> DataFrame; each takes the table that the stage
before it wrote. All but the last return the columns of ``documents``:

1. quality rules: documents that the current policy rejects go;
2. near-duplicates (shingles of 5 words, similarity 0.8 or more): of each group the document with
   the smallest doc_id stays, once; unlike texts under one doc_id are documents of their own;
   documents without an id cannot be told apart by it and stay;
3. repeated passages: words of 13-word windows that an earlier document holds go; a document that
   loses words becomes the rest, joined by one space, and one that loses all its words goes;
4. source mix: documents are left out, repeated, and at each source's limit cut, to target weights;
5. packing: pieces of at most 2048 tokens and their places in sequences (no text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashlens.llm import fast_minhash, mixing, packing, quality_ledger, substring_cover
from crashlens.llm.frames import fresh
from crashlens.llm.queries import tokenizer_path
from crashlens.llm.store import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    measured, ledger = quality_ledger.ledger(docs)
    return measured.filter(quality_ledger.passes(ledger)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = docs.filter("doc_id is not null")
    digest = F.xxhash64("text")
    several = materialise(known.groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high"))
                          .filter("low != high").select("doc_id"), "unlike-texts")
    key, place = fresh(docs.columns, "row_key"), fresh(docs.columns, "place")
    if several.isEmpty():
        rows = known.withColumn(key, F.col("doc_id").cast("bigint"))
        stay = fast_minhash.near_duplicates(rows.select(key, "text"), key=key, size=5).filter("kept").select(key).distinct()
    else:  # texts that share an id get keys of their own, so each is judged by itself
        mark = fresh(docs.columns, "several")
        rows = (known.join(several.withColumn(mark, F.lit(True)), "doc_id", "left")
                .withColumn(key, F.when(F.col(mark), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("bigint"))))
        found = fast_minhash.near_duplicates(rows.select(key, "text"), key=key, size=5).select(key, "component_id").distinct()
        stay = (found.join(rows.select(key, "doc_id").distinct(), key).groupBy("component_id")
                .agg(F.min(F.struct("doc_id", key)).alias("least")).select(F.col(f"least.{key}").alias(key)))
    one = (rows.join(stay, key, "left_semi")
           .withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy("text"))).filter(F.col(place) == 1))
    return one.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out, cover = substring_cover.remove_repeats(docs)
    lost = F.col(f"`{cover}`.n_removed")
    out = out.filter((lost == 0) | (lost < F.col(f"`{cover}`.n_words")))
    out = out.withColumn("text", F.when(lost == 0, F.col("text")).otherwise(F.col(f"`{cover}`.kept_text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(lost == 0, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mix", source_mix),
    ("packing", packed_sequences),
]

# tokenisation and packing have no SQL form; tests hold every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"corpus-{i}")
    return docs
