"""Corpus pipeline over ``documents``: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage reads what its predecessor kept. The first four return the columns of ``documents``; the last returns the
token ids. Rows with a null id pass the stages that decide by id; the stages state their own rules for null and
empty texts, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoseal.llm import bpe, decontamination, line_dedup, quality, weighted_minhash
from chronoseal.llm.arrays import stored

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier trained on the labels of ``docs``."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more documents share; ``n_chars`` follows the text."""
    kept = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast("bigint"))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate class."""
    return weighted_minhash.keep_one(docs).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of any benchmark item."""
    return decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and the digest of the text decoded from them."""
    import public_tokenizers

    codec = bpe.build_codec(docs, public_tokenizers.path(TOKENIZER))
    kept = docs.select("doc_id", "lang", "source", "text")
    decoded = bpe.with_decoded(bpe.with_ids(kept, codec).drop("text"), codec)
    return decoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("bpe_encoding", encode),
]

#: The classifier and the sampled signatures have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again for the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
