"""The corpus pipeline: language identification, near-duplicate removal, decontamination, redaction, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as
the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import common, decontaminate, hyperminhash, language_mixture, packing, pii_crf

#: Share that a document's main language needs; below, or without any letter, the document is rejected.
LEAST_SHARE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language, judged by trigrams of the labelled ones among them."""
    common.small_batches(spark)
    return language_mixture.known_language(docs, language_mixture.learn(docs), LEAST_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group linked at a Jaccard similarity of 0.8 or more on five-word
    shingles. Rows are told apart by their place, so repeated and null ids lose no text and keep no copy."""
    return hyperminhash.without_near_duplicates(docs, words=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item within its error budget."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked, lengths counted anew."""
    masked = pii_crf.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their ids, a digest of them, and their places in sequences;
    ``packing.sequences`` gives the padded rows."""
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(F.col("doc_key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", F.base64("ids").alias("ids_base64"))


STAGES = [
    ("language identification", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("personal data", mask_personal_data),
    ("packing", pack),
]

#: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    return docs
