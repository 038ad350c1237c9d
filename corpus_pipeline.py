"""A training corpus from ``documents``: filter, clean, de-duplicate, decontaminate, tokenise."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrade.llm import bpe, decontam, importance, line_dedup, ngram_join
from marketgrade.session import scratch_folder, ship_package

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample of good text leaves out go."""
    ship_package(spark)
    return importance.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; n_chars counts what is left."""
    ship_package(spark)
    kept = line_dedup.line_dedup(docs).select(docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles one stays."""
    ship_package(spark)
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    ship_package(spark)
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and the bytes that they decode to, counted."""
    ship_package(spark)
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    decoded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.octet_length("bytes").cast("long").alias("n_bytes"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", tokens),
]

#: The classifier's hashes and samples, the links and the merges are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        folder = scratch_folder(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
