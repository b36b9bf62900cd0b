"""Contexts, citations, history windows and compression of retrieved passages."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from corpusflow.functions.text import citation_source, snippet, tokens
from corpusflow.operators.ordering import group_limit, largest_group, number_rows, with_blocks
from corpusflow.operators.search import OVERLAP, TOP_K, Scorer

# Exchanges kept in a chat history and the speaker names in it.
HISTORY_EXCHANGES = 5
SPEAKERS = {"user": "Human", "assistant": "AI", "system": "System"}
# Token budget of a compressed context.
TARGET_TOKENS = 300
# Heading of each kind of source in a summary, in this order.
SOURCE_HEADINGS = [
    ("confluence", "spaces", "- Confluence spaces: "),
    ("gitlab", "groups", "- GitLab Groups: "),
    ("gitlab", "projects", "- GitLab repositories: "),
    ("web", "links", "- Relevant documentation and resources available at: "),
]


def with_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "id") -> DataFrame:
    """Add the 0-based place of each row in its list."""
    return number_rows(df, keys, order, name)


def format_context(docs: DataFrame, keys: Sequence[str], order: Sequence[str], text: str = "page_content") -> DataFrame:
    """``(keys, id, doc)``: documents in rank order, each in a numbered tag.

    A row per document, however many a list has; ``context_of_hits`` joins the few of a top-n list.
    """
    numbered = number_rows(docs.select(*keys, *order, text), keys, order, "id")
    tagged = F.concat(F.lit("<doc id='"), F.col("id").cast("string"), F.lit("'>"), F.col(text), F.lit("</doc>"))
    return numbered.select(*keys, "id", tagged.alias("doc"))


def citations(docs: DataFrame, keys: Sequence[str], order: Sequence[str], text: str = "page_content",
              meta: str = "metadata") -> DataFrame:
    """One row per cited document: ``(keys, id, source, content)``; ``id`` as in the context.

    Sources and snippets are cut out first, so that whole texts are not sorted along.
    """
    cut = docs.select(*keys, *order, citation_source(F.col(meta)).alias("_source"), snippet(F.col(text), F.col(meta)["title"]).alias("_content"))
    numbered = number_rows(cut, keys, order, "id")
    return numbered.select(*keys, "id", F.col("_source").alias("source"), F.col("_content").alias("content"))


def citation_arrays(cited: DataFrame, keys: Sequence[str], top_n: int = TOP_K) -> DataFrame:
    """The first ``top_n`` citations of each list packed as ``array<struct<id, source, content>>``."""
    return (cited.where(F.col("id") < top_n).groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("id", "source", "content"))).alias("sources")))


def summarise_sources(sources: DataFrame, *, type_col: str = "source_type", kind_col: str = "identifier_type",
                      identifier_col: str = "identifier", order: str = "ord", keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, section, ord, text)``: per kind of source a heading (``ord`` -1) and its identifiers in order."""
    place = heading = None
    for i, (source_type, kind, text) in enumerate(SOURCE_HEADINGS):
        match = (F.col(type_col) == source_type) & (F.col(kind_col) == kind)
        place = F.when(match, i) if place is None else place.when(match, i)
        heading = F.when(match, text) if heading is None else heading.when(match, text)
    known = sources.withColumn("section", place).withColumn("_heading", heading).where(F.col("section").isNotNull())
    names = number_rows(known.select(*keys, "section", order, identifier_col), [*keys, "section"], [order, identifier_col], "_n")
    heads = known.select(*keys, "section", F.lit(-1).cast("bigint").alias("ord"), F.col("_heading").alias("text")).distinct()
    return heads.unionByName(names.select(*keys, "section", F.col("_n").alias("ord"), F.col(identifier_col).alias("text")))


def summary_text(summary: DataFrame, keys: Sequence[str] = (), top_n: int = TOP_K) -> DataFrame:
    """``(keys, summary)``: the bullets of ``summarise_sources`` as text, ``top_n`` identifiers each."""
    bullets = (summary.where(F.col("ord") < top_n).groupBy(*keys, "section").agg(
        F.max_by("text", -F.col("ord")).alias("_heading"),
        F.expr("listagg(text, ', ') within group (order by ord) filter (where ord >= 0)").alias("_names"))
        .withColumn("_bullet", F.concat("_heading", "_names")))
    return bullets.groupBy(*keys).agg(F.expr("listagg(_bullet, '\\n  ') within group (order by section)").alias("summary"))


def chat_history(conv: DataFrame, k: int = HISTORY_EXCHANGES, *, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Add ``history``: the last ``k`` exchanges (2k messages) before each message, in order."""
    speaker = F.col(role_col)
    names = F.lit(None).cast("string")
    for role, name in SPEAKERS.items():
        names = F.when(speaker == role, name).otherwise(names)
    line = F.concat(F.coalesce(names, speaker), F.lit(": "), F.col(text_col))
    size = largest_group(conv, [conv_col])
    if size <= group_limit(conv):
        window = Window.partitionBy(conv_col).orderBy(turn_col).rowsBetween(-2 * k, -1)
        return conv.withColumn("history", F.array_join(F.collect_list(line).over(window), "\n"))
    numbered = number_rows(conv, [conv_col], [turn_col], "_n", size)
    window = Window.partitionBy(conv_col, "_block").orderBy("_n").rowsBetween(-2 * k, -1)
    return (with_blocks(numbered, "_n", before=2 * k)
            .withColumn("history", F.array_join(F.collect_list(line).over(window), "\n"))
            .where("_home").drop("_n", "_block", "_home"))


def compress_context(hits: DataFrame, budget: int = TARGET_TOKENS, scorer: Scorer = OVERLAP, *,
                     qid: str = "qid", query: str = "query", text: str = "page_content", rank: str = "rank") -> DataFrame:
    """Keep the passages (lines) of the hits that matter most to the query, within ``budget`` words.

    Passages are taken by score, then place; the running total of their words must stay within
    the budget. What is kept goes back to its document (``ref``) in the original order. The
    hits of a query are a top-k list, so the windows run over its few documents.
    """
    passages = hits.select(
        qid, scorer.prepare(F.col(query)).alias("_query"), (F.col(rank) - 1).alias("ref"),
        F.posexplode(F.split(F.col(text), "\n")).alias("pos", "passage"))
    passages = passages.where(F.size(tokens(F.col("passage"))) > 0).select(
        qid, "ref", "pos", "passage", F.size(tokens(F.col("passage"))).alias("words"),
        F.round(scorer.score(F.col("_query"), scorer.prepare(F.col("passage"))), 9).alias("score"))
    best = Window.partitionBy(qid).orderBy(F.col("score").desc(), "ref", "pos").rowsBetween(Window.unboundedPreceding, 0)
    kept = passages.withColumn("total", F.sum("words").over(best)).where(F.col("total") <= budget)
    return (kept.groupBy(qid, "ref")
            .agg(F.expr("listagg(passage, '\\n') within group (order by pos)").alias(text), F.sum("words").alias("words")))


def restore_metadata(passages: DataFrame, documents: DataFrame, *, qid: str = "qid", ref: str = "ref") -> DataFrame:
    """Give compressed passages the metadata of the document their tag names; none for -1."""
    return passages.join(documents, [qid, ref], "left")


def render_trace(steps: DataFrame, keys: Sequence[str], order: Sequence[str], *, tool: str = "tool",
                 tool_input: str = "tool_input", observation: str = "observation") -> DataFrame:
    """``(keys, ord, text)``: the tool calls of a run, one row each, numbered in order."""
    def tag(name, c):
        return F.concat(F.lit(f"<{name}>"), F.col(c).cast("string"), F.lit(f"</{name}>"))
    entry = F.concat(tag("tool", tool), tag("tool_input", tool_input), tag("observation", observation))
    rows = steps.select(*keys, *[o for o in order if o not in keys], entry.alias("_entry"))
    return number_rows(rows, keys, order, "_n").select(*keys, F.col("_n").alias("ord"), F.col("_entry").alias("text"))


def tool_list(tools: DataFrame, order: Sequence[str] = ("name",)) -> DataFrame:
    """``(ord, text)``: a line ``name: description`` per tool, numbered in order."""
    line = F.concat(F.col("name"), F.lit(": "), F.col("description"))
    rows = tools.select(*order, line.alias("_line"))
    return number_rows(rows, [], list(order), "_n").select(F.col("_n").alias("ord"), F.col("_line").alias("text"))


def last_result(tasks: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """The columns of the last task of each run."""
    return tasks.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_last")).select(*keys, "_last.*")
