"""Ingest of configured sources: load by type, cut, index, label what worked."""
from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusflow.operators.chunking import chunk_recursive
from corpusflow.operators.index import build_index, list_indexes, register_labels, sources_to_refresh
from corpusflow.session import materialized, read_or_empty
from corpusflow.sources.documents import configured_sources, stamp_source, union_sources

_LABELS = "hash string, label string"

#: From the due sources of one type (hash, source_type, identifier_type, identifier, ord) to their documents
#: (hash, doc_id, page_content, metadata). A source that gives no document counts as failed.
Loader = Callable[[DataFrame], DataFrame]


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(hash, label)`` of the sources whose index is built."""
    return read_or_empty(spark, f"{path}/labels", _LABELS)


def refresh(spark: SparkSession, path: str, config: DataFrame, loaders: Mapping[str, Loader], force: bool = False,
            embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """One run over the configured sources: those without a label, or all of them with ``force``.

    Every source is a namespace of the index at ``path``. What its loader gives replaces what it had; the
    label is written after the index, so a source that fails, or a run that dies, leaves it due. Indexes of
    sources that are no longer configured are emptied. Returns ``(hash, label, added, updated, skipped,
    deleted)``, where the label is null if it was there already.
    """
    configured = materialized(configured_sources(config), "configured")
    known = read_labels(spark, path)
    due = materialized(sources_to_refresh(configured, known, force, known_types=list(loaders)), "due")
    docs = materialized(union_sources([load(due.where(F.col("source_type") == kind)).select("hash", "doc_id", "page_content", "metadata")
                                       for kind, load in loaders.items()]), "documents")
    cut = chunk_recursive(docs.select(F.col("hash").alias("namespace"), F.col("doc_id").cast("string").alias("doc_id"), F.col("page_content").alias("text"),
                                      stamp_source(F.col("metadata"), F.col("hash")).alias("metadata")))
    chunks = cut.select("namespace", F.concat("doc_id", F.lit("#"), F.col("ord").cast("string")).alias("chunk_id"), "doc_id", "ord",
                        F.col("chunk").alias("page_content"), "metadata")
    loaded = docs.select(F.col("hash").alias("namespace")).distinct()
    dropped = list_indexes(spark, path).join(configured.select(F.col("hash").alias("namespace")).distinct(), "namespace", "left_anti")
    counts = materialized(build_index(spark, path, chunks, namespaces=loaded.unionByName(dropped), embedder=embedder), "counts")
    label = F.concat("source_type", F.lit(": "), "identifier_type", F.lit("="), "identifier")
    done = due.join(loaded, F.col("hash") == F.col("namespace"), "left_semi").select("hash", label.alias("label")).dropDuplicates(["hash"])
    fresh = materialized(register_labels(known, done), "labels")
    fresh.write.mode("append").parquet(f"{path}/labels")
    return counts.withColumnRenamed("namespace", "hash").join(fresh, "hash", "left").select("hash", "label", "added", "updated", "skipped", "deleted")
