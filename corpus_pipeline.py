"""The corpus pipeline: language, near copies, benchmark passages, secrets and tokens of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's docs. All but the last return the columns of ``documents``; the last describes the tokens of what is left.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import bpe, decontaminate, jaccard_join, language, secret_scan
from corpusflow.session import materialized, ship_package

#: Bytes of texts that are handed to a Python worker at a time.
BATCH_BYTES = 4_000_000
#: Words of a shingle and per cent of shared shingles that make two documents near copies.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def _prepare(spark: SparkSession) -> None:
    """The package on the workers, and batches for them that are bounded in bytes, however long the texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: null texts and texts without a letter go."""
    _prepare(spark)
    return language.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    _prepare(spark)
    return jaccard_join.keep_one(docs, NEAR_WIDTH, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    _prepare(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each secret replaced by the name of its kind."""
    _prepare(spark)
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens, a digest of the ids and one of the decoded text of every document."""
    _prepare(spark)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return bpe.round_trip(docs, f.read())


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontamination),
          ("secret scans", secrets), ("BPE encoding and decoding", tokens)]

#: SQL cannot express the first and the last stage; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each on a table of what the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
