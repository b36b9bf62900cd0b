"""Whole ingest jobs: configured sources to an index with labels."""
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import graph as gr, index as ix
from corpusflow.plans.ingest import read_labels, refresh
from corpusflow.session import scratch_path

CONFIG = "source_type string, spaces array<string>, groups array<string>, projects array<string>, links array<string>"
PAGES = [("https://a.example", "<p>home</p><a href='/x'>x</a>"), ("https://a.example/x", "<p>page x</p>"), ("https://b.example", "<p>other</p>")]


def _loaders(spark, texts):
    pages = spark.createDataFrame(PAGES, "url string, html string")

    def spaces(due):
        stored = spark.createDataFrame(texts, "identifier string, doc_id string, page_content string")
        return due.join(stored, "identifier").select("hash", "doc_id", "page_content", F.create_map(F.lit("source"), "identifier").alias("metadata"))

    def web(due):
        seeds = due.select("hash", F.col("identifier").alias("seed"))
        docs = gr.crawl_documents(pages, gr.link_edges(pages), seeds)
        return docs.join(seeds, "seed").select("hash", F.col("url").alias("doc_id"), "page_content", "metadata")
    return {"confluence": spaces, "web": web}


def _held(spark, path):
    return sorted((r.page_content, r.metadata["source"] == r.namespace) for r in ix.read_index(spark, path).collect())


def test_refresh(spark):
    path = scratch_path(spark, "ingest")
    config = spark.createDataFrame([("confluence", ["s1", "gone"], None, None, None), ("web", None, None, None, ["https://a.example"])], CONFIG)
    texts = [("s1", "1", "one"), ("s1", "2", "two")]
    first = {r.label: (r.added, r.deleted) for r in refresh(spark, path, config, _loaders(spark, texts)).collect()}
    assert first == {"confluence: spaces=s1": (2, 0), "web: links=https://a.example": (2, 0)}
    assert _held(spark, path) == [("home\n\nx", True), ("one", True), ("page x", True), ("two", True)]
    # the source without documents stays due, the others have their label
    again = refresh(spark, path, config, _loaders(spark, [*texts, ("gone", "9", "found"), ("s1", "3", "not due")])).collect()
    assert [(r.label, r.added) for r in again] == [("confluence: spaces=gone", 1)]
    # by force everything is replaced, no label is written twice, and what is no longer configured goes
    less = spark.createDataFrame([("confluence", ["s1"], None, None, None)], CONFIG)
    forced = {(r.added, r.skipped, r.deleted) for r in refresh(spark, path, less, _loaders(spark, [("s1", "1", "one"), ("s1", "4", "four")]), force=True).collect()}
    assert forced == {(1, 1, 1), (0, 0, 2), (0, 0, 1)}
    assert _held(spark, path) == [("four", True), ("one", True)]
    assert read_labels(spark, path).count() == 3


def test_unknown_types_fail(spark):
    config = spark.createDataFrame([("gitlab", None, ["g"], None, None)], CONFIG)
    with pytest.raises(Exception, match="Unknown source type: gitlab"):
        refresh(spark, scratch_path(spark, "ingest"), config, _loaders(spark, [("s", "1", "x")]))
