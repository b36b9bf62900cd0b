"""The plans are the ones meant for large tables."""
from pyspark.sql import functions as F

from conftest import plan_text as plan
from corpusflow.functions.text import tokens
from corpusflow.operators import context as cx, search as se
from corpusflow.operators.chunking import chunk_fixed
from corpusflow.operators.ordering import top_rows
from corpusflow.plans.flagship import cited_answers

c = F.col


def test_top_rows_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((c("id") % 3).alias("k"), "id")
    text = plan(top_rows(df, ["k"], ["id"], 5))
    tree = text[:text.index("(1)")]
    assert tree.count("WindowGroupLimit") == 2 and tree.index("Exchange") < tree.rindex("WindowGroupLimit")


def test_search_has_no_cross_join(spark):
    df = spark.range(20).select(c("id").alias("chunk_id"), F.array(c("id").cast("float")).alias("embedding"))
    queries = df.select(c("chunk_id").alias("qid"), c("embedding").alias("qvec"))
    for bound in (0, 100):
        text = plan(se.search(df, queries, 3, broadcast_queries=bound))
        assert "Cartesian" not in text and "NestedLoop" not in text


def test_chunking_reads_only_its_columns_and_does_not_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = plan(chunk_fixed(docs).select("doc_id", "ord", "chunk"))
    assert "Exchange" not in text and "lang" not in text


def test_history_is_one_shuffle(spark):
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert plan(cx.chat_history(conv)).count("+- Exchange") == 1


def test_flagship(spark):
    rows = cited_answers(spark, "/root/testdata/sf0.001").collect()
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()
    assert len(rows) == asked
    assert all(r.context.startswith("<doc id='0'>") and 1 <= len(r.sources) <= 5 for r in rows)


def test_passages_that_occur_verbatim_are_found(spark):
    folder = "/root/testdata/sf0.001"
    asked = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    known = {i for i, t in asked.items() if any(t in d for d in texts)}
    contexts = {r.qid: r.context for r in cited_answers(spark, folder, recursive=False).collect()}
    words = {i: set(t.lower().split()) for i, t in asked.items()}
    found = sum(len(words[i] & set(contexts[i].lower().split())) >= 0.9 * len(words[i]) for i in known)
    assert not known or found >= 0.5 * len(known)
    assert spark.range(1).select(F.size(tokens(F.lit(" A\tb\n")))).first()[0] == 2


def test_citations_do_not_sort_texts(spark):
    docs = spark.createDataFrame([("a", 1, "One. Two.", {"source": "s"}), ("a", 0, "  Three", {"source": "t", "title": "T"})],
                                 "k string, pos int, page_content string, metadata map<string,string>")
    cited = cx.citations(docs, ["k"], ["pos"])
    assert [tuple(r) for r in cited.orderBy("id").collect()] == [("a", 0, "t", "T"), ("a", 1, "s", "One ...")]
    steps = plan(cited).split("\n\n")
    moved = [s for s in steps if any(f") {x}" in s for x in ("Exchange", "Sort", "Window"))]
    assert moved and not any("page_content#" in s for s in moved)
