"""Whole jobs: from questions to ranked passages and cited answer contexts."""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusflow.functions.prompts import ANSWER_TEMPLATE, prompt_messages, render
from corpusflow.functions.text import citation_source, snippet
from corpusflow.functions.vectors import embed
from corpusflow.operators.chunking import chunk_fixed, chunk_recursive
from corpusflow.operators.search import OVERLAP, TOP_K, TOP_N, Scorer, explode_queries, rerank, search, unique_first
from corpusflow.session import free_shuffles, materialized, passing_tables

# Pairs of a query and a passage that are shuffled at once to be scored.
PAIR_ROWS = 4_000_000


def document_chunks(docs: DataFrame, recursive: bool = True, *, id_col: str = "doc_id", text_col: str = "text",
                    namespace_col: str = "source") -> DataFrame:
    """Chunks of a document table, ready for the index: each carries its document's metadata.

    A document without an id is named after its text, so its chunks have ids of their own as well.
    """
    meta = F.create_map(F.lit("source"), F.col(namespace_col))
    slim = docs.select(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text-"), F.md5(F.col(text_col)))).alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(namespace_col).alias("namespace"), meta.alias("metadata"))
    cut = chunk_recursive(slim) if recursive else chunk_fixed(slim)
    return cut.select("namespace", F.concat("doc_id", F.lit("#"), F.col("ord").cast("string")).alias("chunk_id"), "doc_id",
                      F.col("ord").cast("int").alias("ord"), F.col("chunk").alias("page_content"), "metadata")


def embedded_queries(questions: DataFrame, qid: str, text: str, embedder=None) -> DataFrame:
    """``(qid, query, qvec)``."""
    return embed(questions.select(F.col(qid).alias("qid"), F.col(text).alias("query")), "query", "qvec", embedder)


def retrieve_rerank(index: DataFrame, queries: DataFrame, top_k: int = TOP_K, top_n: int = TOP_N,
                    scorer: Scorer | None = OVERLAP) -> DataFrame:
    """Nearest ``top_k`` passages per query, reranked to ``top_n``; ``scorer=None`` skips the second step.

    The hits, a few numbers per query, are written out: the costly search runs once, and their
    known size decides whether the index is filtered in place or shuffled to meet them. Texts
    are prepared for the scorer once per passage, however many queries found it. What is prepared of a query goes to its
    ``top_k`` passages, ``PAIR_ROWS`` pairs or so at a time, and texts are fetched only for the ``top_n`` that are kept, which
    are written out in between.
    """
    spark = index.sparkSession
    with passing_tables(spark):  # the vectors go before texts are shuffled
        hits = materialized(search(index, queries, top_k), "hits", kept=True)
    found = hits.select("chunk_id").distinct()
    if scorer is None:
        passages = index.select("chunk_id", "page_content", "metadata").join(found, "chunk_id", "left_semi")
        return hits.join(passages, "chunk_id").join(queries.select("qid", "query"), "qid")
    # ids may repeat: with a hash of what belongs to them, they name one of the rows, or copies that are the same
    texts = index.select("chunk_id", "page_content", "metadata", _named("chunk_id", F.xxhash64("page_content", F.col("metadata").cast("string"))).alias("_text"))
    passages = (texts.select("chunk_id", "_text", "page_content").join(found, "chunk_id", "left_semi")
                .select("chunk_id", "_text", scorer.prepare(F.col("page_content")).alias("_passage")))
    questions = queries.select("qid", "query", _named("qid", F.xxhash64("query")).alias("_asked"))
    asked = questions.select("qid", "_asked", scorer.prepare(F.col("query")).alias("_query"))
    rounds = math.ceil(hits.count() / int(spark.conf.get("spark.corpusflow.pairRows", str(PAIR_ROWS)))) or 1
    parts = []
    for i in range(rounds):
        some = hits.where(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == i) if rounds > 1 else hits
        prepared = some.join(asked, "qid").join(passages, "chunk_id")
        parts.append(materialized(rerank(prepared, scorer, top_n, prepared=("_query", "_passage")), "best"))
        del prepared
        free_shuffles(spark)
    best = reduce(DataFrame.unionByName, parts)
    texts_asked = questions.select("_asked", "query").dropDuplicates(["_asked"])
    kept = (texts.select("_text", "page_content", "metadata").join(best.select("_text").distinct(), "_text", "left_semi")
            .groupBy("_text").agg(F.first(F.struct("page_content", "metadata")).alias("_kept")))
    return (best.join(texts_asked, "_asked").join(kept, "_text")
            .select(*[c for c in best.columns if c not in ("_asked", "_text")], "_kept.page_content", "_kept.metadata", "query"))


def _named(key: str, content: Column) -> Column:
    return F.concat(F.col(key).cast("string"), F.lit("/"), content.cast("string"))


def multi_search(index: DataFrame, questions: DataFrame, top_k: int = TOP_K, top_n: int = TOP_N,
                 scorer: Scorer | None = OVERLAP, embedder=None, *, question_id: str = "question_id", queries_col: str = "search_queries") -> DataFrame:
    """Each question's one to three queries are answered on their own, then fused.

    A passage found by several queries keeps its first place (query, then rank).
    """
    single = explode_queries(questions.select(question_id, queries_col), queries_col)
    single = single.withColumn("qid", F.concat(F.col("query_pos").cast("string"), F.lit(":"), F.col(question_id).cast("string")))
    queries = embedded_queries(single, "qid", "query", embedder)
    hits = retrieve_rerank(index, queries, top_k, top_n, scorer)
    place = F.split("qid", ":", 2)
    hits = (hits.withColumn("query_pos", place[0].cast("int"))
            .withColumn(question_id, place[1].cast(questions.schema[question_id].dataType)))
    return unique_first(hits, question_id, "chunk_id", ["query_pos", "rank"])


def context_of_hits(hits: DataFrame, qid: str = "qid", rank: str = "rank") -> DataFrame:
    """``(qid, context, sources)``: numbered passages and citations of a ranked list.

    A ranked list has at most (queries x top_n) rows, so one row per question holds it.
    """
    doc_id = (F.col(rank) - 1).cast("int")
    numbered = hits.select(
        qid, doc_id.alias("id"),
        F.concat(F.lit("<doc id='"), doc_id.cast("string"), F.lit("'>"), F.col("page_content"), F.lit("</doc>")).alias("doc"),
        citation_source(F.col("metadata")).alias("source"),
        snippet(F.col("page_content"), F.col("metadata")["title"]).alias("content"))
    return numbered.groupBy(qid).agg(
        F.expr("listagg(doc, '\\n') within group (order by id)").alias("context"),
        F.array_sort(F.collect_list(F.struct("id", "source", "content"))).alias("sources"))


def answer_context(questions: DataFrame, hits: DataFrame, system_prompt: str, *, qid: str = "qid", question: str = "question",
                   history: str = "history") -> DataFrame:
    """Questions with context, citations and prompt messages, up to the point of asking a model.

    A question without hits, for want of a source, passes through with an empty context.
    """
    full = questions.join(context_of_hits(hits, qid), qid, "left")
    full = (full.withColumn("context", F.coalesce("context", F.lit("")))
            .withColumn("sources", F.coalesce("sources", F.array().cast("array<struct<id:int,source:string,content:string>>"))))
    user = render(ANSWER_TEMPLATE, question=F.col(question), context=F.col("context"), chat_history=F.col(history))
    return full.withColumn("prompt", prompt_messages(F.lit(system_prompt), user))
