"""The job from documents and questions to cited contexts in one plan."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.functions.vectors import embed
from corpusflow.session import materialized, read_spread, ship_package
from corpusflow.plans.retrieve import context_of_hits, document_chunks, embedded_queries, retrieve_rerank


def cited_answers(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``(qid, context, sources)`` for every passage of ``benchmark`` over all of ``documents``."""
    ship_package(spark)
    docs = read_spread(spark, f"{folder}/documents.parquet", "doc_id")
    questions = spark.read.parquet(f"{folder}/benchmark.parquet")
    index = materialized(embed(document_chunks(docs, recursive), "page_content"), "chunk-index")
    return context_of_hits(retrieve_rerank(index, embedded_queries(questions, "item_id", "text")))
