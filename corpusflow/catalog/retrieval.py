"""Queries over search, fusion, reranking, contexts and histories."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusflow.catalog.base import SPLIT_CHUNKS, Tables, d2_sql, hits_sql, overlap_sql, query, strip_sql, tokens_sql, vectors_sql
from corpusflow.functions import text as tx
from corpusflow.functions.prompts import ANSWER_TEMPLATE
from corpusflow.functions.vectors import embed, relevance
from corpusflow.operators import context as cx, search as se, similarity as si
from corpusflow.plans import retrieve as rt
from corpusflow.plans.flagship import cited_answers
from corpusflow.session import materialized

c = F.col
SYSTEM = "Answer from the context and name your sources."
# Squared distance up to which vectors count as near in the join of representatives.
NEAR = 1.0


# --- vectors as they are given: every vector is a query against all of them ----------------

def _index(t: Tables) -> DataFrame:
    return t("embeddings").select(c("vec_id").alias("chunk_id"), "embedding", "label")


def _queries(t: Tables) -> DataFrame:
    return t("embeddings").select(c("vec_id").alias("qid"), c("embedding").alias("qvec"))


_VEC = "vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings)"
_HITS = f"{_VEC}, {hits_sql('hits', 'vec', 'vec', 20)}"


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("d2", F.round("d2", 6)).withColumn("rank", c("rank").cast("bigint"))


@query("q1_search", f"WITH {_HITS} SELECT qid, chunk_id, round(d2, 6) AS d2, rank FROM hits")
def _(t: Tables) -> DataFrame:
    return _rounded(se.search(_index(t), _queries(t)))


@query("j4_knn_blocks", f"WITH {_HITS} SELECT qid, chunk_id, round(d2, 6) AS d2, rank FROM hits")
def _(t: Tables) -> DataFrame:
    return _rounded(se.search(_index(t), _queries(t), broadcast_queries=0))


@query("j5_within_radius", f"""
WITH {_VEC} SELECT * FROM (SELECT q.id AS qid, x.id AS chunk_id, round({d2_sql('q.v', 'x.v')}, 6) AS d2
FROM vec q JOIN vec x ON q.id < x.id) WHERE d2 <= 1.3""")
def _(t: Tables) -> DataFrame:
    pairs = se.within_radius(_index(t), _queries(t), 1.3000005).where("qid < chunk_id")
    return pairs.withColumn("d2", F.round("d2", 6)).where("d2 <= 1.3")


@query("j5_similarity_join", f"""
WITH {_VEC}, reps AS (SELECT min(id) AS id, v FROM vec GROUP BY v)
SELECT * FROM (SELECT q.id AS qid, x.id AS chunk_id, round({d2_sql('q.v', 'x.v')}, 6) AS d2 FROM reps q JOIN reps x ON q.id < x.id) WHERE d2 <= 1.0
UNION ALL SELECT vec.id, reps.id, 0.0 FROM vec JOIN reps USING (v) WHERE vec.id <> reps.id""")
def _(t: Tables) -> DataFrame:
    """All vectors against all: pairs of representatives of equal vectors, and each copy with its representative."""
    pairs, members, _ = si.similarity_join(_index(t), _queries(t), NEAR + 5e-7)
    copies = members.where("member <> representative").select(c("member").alias("qid"), c("representative").alias("chunk_id"), F.lit(0.0).alias("d2"))
    near = pairs.where("qid < id").select("qid", c("id").alias("chunk_id"), F.round("d2", 6).alias("d2")).where(F.col("d2") <= NEAR)
    return near.unionByName(copies)


@query("q2_relevance", f"WITH {_HITS} SELECT qid, chunk_id, round(1 - d2 / sqrt(2), 6) AS relevance FROM hits")
def _(t: Tables) -> DataFrame:
    return se.search(_index(t), _queries(t)).select("qid", "chunk_id", F.round(relevance(c("d2")), 6).alias("relevance"))


@query("f4_threshold", f"""
WITH {_VEC}, {hits_sql('hits', 'vec', 'vec', 3)} SELECT qid, chunk_id, rank FROM hits WHERE 1 - d2 / sqrt(2) >= 0.12""")
def _(t: Tables) -> DataFrame:
    return _rounded(se.threshold(se.search(_index(t), _queries(t), 3), 0.12)).select("qid", "chunk_id", "rank")


@query("w2_top_k", f"""
WITH {_VEC}, far AS (SELECT label, vec_id, {d2_sql("v.v", "(SELECT v FROM vec ORDER BY id LIMIT 1)")} AS d2 FROM embeddings JOIN vec v ON v.id = vec_id)
SELECT label, vec_id, rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(d2, 9), vec_id) AS rank FROM far) WHERE rank <= 20""")
def _(t: Tables) -> DataFrame:
    """Of every label, the vectors nearest to the first vector of all."""
    from corpusflow.operators.ordering import top_rows
    first = t("embeddings").select(F.min_by("embedding", "vec_id")).first()[0]
    aim = F.array(*[F.lit(float(x)) for x in first])
    d2 = F.aggregate(F.zip_with(c("embedding"), aim, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)
    return top_rows(t("embeddings").withColumn("d2", F.round(d2, 9)), ["label"], ["d2", "vec_id"], 20).select(
        "label", "vec_id", c("rank").cast("bigint").alias("rank"))


def _questions_of_three(t: Tables) -> DataFrame:
    """Neighbouring vectors as the one to three search queries of a question."""
    return t("embeddings").select(
        F.floor(c("vec_id") / 3).alias("question_id"), F.pmod("vec_id", F.lit(3)).alias("query_pos"),
        c("vec_id").alias("qid"), c("embedding").alias("qvec"))


_FUSED = f"""{_HITS},
flat AS (SELECT CAST(floor(qid / 3) AS BIGINT) AS question_id, qid % 3 AS query_pos, chunk_id, rank FROM hits),
firsts AS (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY query_pos, rank) AS r FROM flat),
fused AS (SELECT question_id, query_pos, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY query_pos, rank) AS rank FROM firsts WHERE r = 1)"""


def _fused(t: Tables) -> DataFrame:
    questions = _questions_of_three(t)
    hits = se.search(_index(t), questions).join(questions.select("qid", "question_id", "query_pos"), "qid")
    return se.unique_first(hits, "question_id", "chunk_id", ["query_pos", "rank"])


@query("w3_unique_first", f"WITH {_FUSED} SELECT question_id, query_pos, chunk_id, rank FROM fused")
def _(t: Tables) -> DataFrame:
    return _fused(t).select("question_id", "query_pos", "chunk_id", c("rank").cast("bigint").alias("rank"))


@query("u1_distinct_union", f"WITH {_FUSED} SELECT question_id, count(*) AS documents, min(chunk_id) AS first_id, max(chunk_id) AS last_id FROM fused GROUP BY question_id")
def _(t: Tables) -> DataFrame:
    return _fused(t).groupBy("question_id").agg(F.count("*").alias("documents"), F.min("chunk_id").alias("first_id"),
                                                F.max("chunk_id").alias("last_id"))


def _two_indexes(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Vectors of the lower labels, and all vectors, each with positions in id order."""
    def placed(df):
        ids = cx.with_ordinal(df.select(c("vec_id").alias("doc_id")), [], ["doc_id"], "pos")
        return df.select(c("vec_id").alias("doc_id"), "embedding").join(ids, "doc_id")
    return placed(t("embeddings").where("label < 5")), placed(t("embeddings"))


_MERGED = """a AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings WHERE label < 5),
b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings),
merged AS (SELECT doc_id, pos FROM a UNION ALL SELECT doc_id, pos + (SELECT coalesce(max(pos), -1) + 1 FROM a) FROM b)"""


@query("w7_merge_positions", f"WITH {_MERGED} SELECT doc_id, pos FROM merged")
def _(t: Tables) -> DataFrame:
    return se.merge_positions(*_two_indexes(t)).select("doc_id", "pos")


@query("u2_merge_indexes", f"""
WITH {_MERGED} SELECT 'vector' AS kind, doc_id, pos FROM merged UNION ALL SELECT 'document', doc_id, min(pos) FROM merged GROUP BY doc_id""")
def _(t: Tables) -> DataFrame:
    vectors, documents = se.merge_indexes(*_two_indexes(t))
    return (vectors.select(F.lit("vector").alias("kind"), "doc_id", "pos")
            .unionByName(documents.select(F.lit("document").alias("kind"), "doc_id", "pos")))


_MERGED_VEC = f"""{_VEC}, {_MERGED}, mv AS (SELECT pos AS id, v, doc_id FROM merged JOIN vec ON vec.id = doc_id), {hits_sql('mhits', 'vec', 'mv', 20)},
found AS (SELECT m.qid, mv.doc_id, min(m.rank) AS place FROM mhits m JOIN mv ON mv.id = m.chunk_id GROUP BY m.qid, mv.doc_id)"""


@query("u2_search_merged", f"WITH {_MERGED_VEC} SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM found")
def _(t: Tables) -> DataFrame:
    vectors, _ = se.merge_indexes(*_two_indexes(t))
    hits = se.search_merged(materialized(vectors, "merged"), _queries(t))
    return hits.select("qid", "doc_id", c("rank").cast("bigint").alias("rank"))


@query("u2_search_deduped", f"WITH {_HITS} SELECT qid, chunk_id AS doc_id, rank FROM hits")
def _(t: Tables) -> DataFrame:
    vectors, _ = se.merge_indexes(*_two_indexes(t))
    hits = se.search_merged(materialized(vectors, "merged"), _queries(t), dedupe_first=True)
    return hits.select("qid", "doc_id", c("rank").cast("bigint").alias("rank"))


# --- text: benchmark passages as questions over all document chunks -------------------------

def _chunk_index(t: Tables) -> DataFrame:
    """Chunks and vectors, worked out once per query into a table."""
    return materialized(embed(rt.document_chunks(t.spread("documents", "doc_id")), "page_content"), "chunk-index")


def _bench_queries(t: Tables) -> DataFrame:
    return rt.embedded_queries(t("benchmark"), "item_id", "text")


_TEXT_HITS = f"""{SPLIT_CHUNKS}, {vectors_sql('cv', 'chunks', 'chunk_id', 'page_content')},
{vectors_sql('qv', 'benchmark', 'item_id', 'text')}, {hits_sql('hits', 'qv', 'cv', 20)},
q AS (SELECT item_id AS qid, text AS query, list_distinct({tokens_sql('text')}) AS qw FROM benchmark),
p AS (SELECT chunk_id, doc_id, namespace, page_content, list_distinct({tokens_sql('page_content')}) AS pw FROM chunks),
pairs AS (SELECT h.qid, h.chunk_id, h.rank, q.query, p.doc_id, p.namespace, p.page_content, {overlap_sql('q.qw', 'p.pw')} AS score
          FROM hits h JOIN q USING (qid) JOIN p USING (chunk_id)),
best AS (SELECT * EXCLUDE (rank, r), r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, rank) AS r FROM pairs) WHERE r <= 5)"""


@query("q5_retrieve_rerank", f"WITH RECURSIVE {_TEXT_HITS} SELECT qid, chunk_id, rank, round(score, 6) AS score FROM best")
def _(t: Tables) -> DataFrame:
    best = rt.retrieve_rerank(_chunk_index(t), _bench_queries(t))
    return best.select("qid", "chunk_id", c("rank").cast("bigint").alias("rank"), F.round("relevance_score", 6).alias("score"))


@query("q5_retrieve_only", f"WITH RECURSIVE {_TEXT_HITS} SELECT qid, chunk_id, rank, round(d2, 6) AS d2 FROM hits")
def _(t: Tables) -> DataFrame:
    return _rounded(rt.retrieve_rerank(_chunk_index(t), _bench_queries(t), scorer=None).select("qid", "chunk_id", "rank", "d2"))


@query("r1_rerank_overlap", f"""
WITH p AS (SELECT conv_id, turn, list_distinct({tokens_sql('text')}) AS pw FROM conversations),
q AS (SELECT conv_id, pw AS qw FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM p) WHERE r = 1)
SELECT conv_id, turn, rank, round(score, 6) AS score FROM (
  SELECT conv_id, turn, score, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 9) DESC, turn) AS rank
  FROM (SELECT conv_id, turn, {overlap_sql('q.qw', 'p.pw')} AS score FROM p JOIN q USING (conv_id))) WHERE rank <= 5""")
def _(t: Tables) -> DataFrame:
    """The first message of a conversation asks; all its messages are ranked against it."""
    messages = t("conversations")
    asked = messages.groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    hits = messages.select("conv_id", "turn", c("turn").alias("rank"), c("text").alias("passage")).join(asked, "conv_id")
    return se.rerank(hits, qid="conv_id").select("conv_id", "turn", c("rank").cast("bigint").alias("rank"),
                                                 F.round("relevance_score", 6).alias("score"))


@query("r1_rerank_bm25", f"""
WITH RECURSIVE {_TEXT_HITS}, words AS (SELECT chunk_id, unnest(pw) AS w FROM p), df AS (SELECT w, count(*) AS df FROM words GROUP BY w),
len AS (SELECT chunk_id, len({tokens_sql('page_content')}) AS l, {tokens_sql('page_content')} AS ws FROM chunks),
stats AS (SELECT count(*) AS n, avg(l) AS m FROM len),
terms AS (SELECT qid, chunk_id, l, w, len(list_filter(ws, lambda x: x = w)) AS tf
          FROM (SELECT h.qid, h.chunk_id, len.l, len.ws, unnest(q.qw) AS w FROM hits h JOIN q USING (qid) JOIN len USING (chunk_id))),
total AS (SELECT qid, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))) AS score
          FROM terms JOIN df USING (w), stats WHERE tf > 0 GROUP BY qid, chunk_id)
SELECT h.qid, h.chunk_id, round(coalesce(score, 0), 6) AS score FROM hits h LEFT JOIN total USING (qid, chunk_id)""")
def _(t: Tables) -> DataFrame:
    index, queries = _chunk_index(t), _bench_queries(t)
    pairs = materialized(rt.retrieve_rerank(index, queries, scorer=None).select("qid", "chunk_id", "query"), "pairs")
    scores = se.bm25_scores(pairs, index.select("chunk_id", c("page_content").alias("passage")))
    return scores.select("qid", "chunk_id", F.round("score", 6).alias("score"))


@query("j6_attach_scores", f"""
WITH RECURSIVE {_TEXT_HITS} SELECT qid, rank - 1 AS idx, chunk_id, round(score, 6) AS relevance_score FROM pairs""")
def _(t: Tables) -> DataFrame:
    hits = materialized(rt.retrieve_rerank(_chunk_index(t), _bench_queries(t), scorer=None), "hits")
    hits = hits.withColumn("idx", (c("rank") - 1).cast("bigint"))
    answer = hits.select("qid", "idx", F.round(se.set_cosine(se.word_set(c("query")), se.word_set(c("page_content"))), 6).alias("relevance_score"))
    return se.attach_scores(hits.select("qid", "idx", "chunk_id"), answer, ["qid", "idx"])


_COMPRESSED = f"""{_TEXT_HITS},
lines AS (SELECT qid, query, rank - 1 AS ref, unnest(range(0, len(string_split(page_content, chr(10))))) AS pos, unnest(string_split(page_content, chr(10))) AS passage FROM best),
scored AS (SELECT l.*, len({tokens_sql('passage')}) AS words, round({overlap_sql('q.qw', f"list_distinct({tokens_sql('passage')})")}, 9) AS score
           FROM lines l JOIN q USING (qid)),
kept AS (SELECT *, sum(words) OVER (PARTITION BY qid ORDER BY score DESC, ref, pos ROWS UNBOUNDED PRECEDING) AS total FROM scored WHERE words > 0),
compressed AS (SELECT qid, ref, string_agg(passage, chr(10) ORDER BY pos) AS page_content, CAST(sum(words) AS BIGINT) AS words FROM kept WHERE total <= 300 GROUP BY qid, ref)"""


def _compressed(t: Tables) -> tuple[DataFrame, DataFrame]:
    best = materialized(rt.retrieve_rerank(_chunk_index(t), _bench_queries(t)), "best")
    kept = cx.compress_context(best)
    return best, kept.withColumn("ref", c("ref").cast("bigint"))


@query("t6_compress_context", f"WITH RECURSIVE {_COMPRESSED} SELECT qid, ref, page_content, words FROM compressed")
def _(t: Tables) -> DataFrame:
    return _compressed(t)[1]


@query("j7_restore_metadata", f"""
WITH RECURSIVE {_COMPRESSED} SELECT c.qid, c.ref, b.namespace AS source, b.chunk_id FROM compressed c LEFT JOIN best b ON b.qid = c.qid AND b.rank = c.ref + 1
UNION ALL SELECT item_id, -1, NULL, NULL FROM benchmark""")
def _(t: Tables) -> DataFrame:
    best, kept = _compressed(t)
    untagged = t("benchmark").select(c("item_id").alias("qid"), F.lit(-1).cast("bigint").alias("ref"))
    documents = best.select("qid", (c("rank") - 1).cast("bigint").alias("ref"), c("metadata")["source"].alias("source"), "chunk_id")
    return cx.restore_metadata(kept.select("qid", "ref").unionByName(untagged), documents)


@query("t6_tagged_compression", f"""
WITH RECURSIVE {_COMPRESSED} SELECT c.qid, c.ref, {strip_sql('c.page_content')} AS page_content, b.namespace AS source
FROM compressed c JOIN best b ON b.qid = c.qid AND b.rank = c.ref + 1""")
def _(t: Tables) -> DataFrame:
    """As one job: compress, tag each passage with its place, join them, cut them apart, read the tags, give the metadata back."""
    best, kept = _compressed(t)
    # a list has at most top_n passages
    joined = kept.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "ref", tx.wrap_refs(c("page_content"), c("ref")).alias("text")))), lambda x: x["text"]), "").alias("context"))
    text, ref = tx.extract_ref(c("passage"), compat=False)
    passages = joined.select("qid", F.explode(F.split("context", "\n\n")).alias("passage")).select("qid", text.alias("page_content"), ref.alias("ref"))
    documents = best.select("qid", (c("rank") - 1).cast("bigint").alias("ref"), c("metadata")["source"].alias("source"))
    return cx.restore_metadata(passages.where(c("page_content").isNotNull()), documents).select("qid", "ref", "page_content", "source")


@query("q4_multi_search", f"""
WITH RECURSIVE questions AS (SELECT conv_id || '-' || turn AS question_id, [text, role || ' ' || text, text || ' ' || text] AS qs FROM conversations),
sq AS (SELECT question_id || ':' || pos AS qid, question_id, pos AS query_pos, query FROM (SELECT question_id, unnest(range(0, len(qs))) AS pos, unnest(qs) AS query FROM questions)),
{SPLIT_CHUNKS}, {vectors_sql('cv', 'chunks', 'chunk_id', 'page_content')}, {vectors_sql('qv', 'sq', 'qid', 'query')}, {hits_sql('hits', 'qv', 'cv', 20)},
q AS (SELECT qid, question_id, query_pos, list_distinct({tokens_sql('query')}) AS qw FROM sq),
p AS (SELECT chunk_id, list_distinct({tokens_sql('page_content')}) AS pw FROM chunks),
best AS (SELECT * FROM (SELECT qid, question_id, query_pos, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round({overlap_sql('qw', 'pw')}, 9) DESC, rank) AS rank
   FROM hits JOIN q USING (qid) JOIN p USING (chunk_id)) WHERE rank <= 5),
firsts AS (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY query_pos, rank) AS r FROM best)
SELECT question_id, query_pos, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY query_pos, rank) AS rank FROM firsts WHERE r = 1""")
def _(t: Tables) -> DataFrame:
    """Every message asks with three wordings of itself, which mostly find the same passages."""
    questions = t("conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("question_id"),
        F.array(c("text"), F.concat_ws(" ", "role", "text"), F.concat_ws(" ", "text", "text")).alias("search_queries"))
    fused = rt.multi_search(_chunk_index(t), questions)
    return fused.select("question_id", c("query_pos").cast("bigint").alias("query_pos"), "chunk_id", c("rank").cast("bigint").alias("rank"))


# --- contexts, citations, history -----------------------------------------------------------

_NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS id FROM documents)"


@query("a1_format_context", f"""
WITH {_NUMBERED} SELECT source, id, '<doc id=''' || id || '''>' || text || '</doc>' AS doc FROM numbered""")
def _(t: Tables) -> DataFrame:
    return cx.format_context(t("documents"), ["source"], ["doc_id"], "text")


def _cited(t: Tables) -> DataFrame:
    docs = t("documents").withColumn("metadata", F.create_map(F.lit("source"), "source"))
    return cx.citations(docs, ["lang"], ["doc_id"], "text")


@query("a2_citations", r"""
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS id, source,
  string_split(regexp_replace(text, '\A[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+\z', '', 'g'), '.')[1] || ' ...' AS content FROM documents""")
def _(t: Tables) -> DataFrame:
    return _cited(t)


@query("a2_citation_arrays", """
SELECT lang, count(*) AS sources, string_agg(id || ':' || source, ',' ORDER BY id) AS listed
FROM (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS id FROM documents) WHERE id < 20 GROUP BY lang""")
def _(t: Tables) -> DataFrame:
    """The lists as arrays, as long as a search gives them."""
    packed = cx.citation_arrays(_cited(t), ["lang"])
    listed = F.transform("sources", lambda s: F.concat(s["id"].cast("string"), F.lit(":"), s["source"]))
    return packed.select("lang", F.size("sources").cast("bigint").alias("sources"), F.array_join(listed, ",").alias("listed"))


_KINDS = {"de": 0, "en": 1, "es": 2, "fr": 3}
_PLACE = f"CASE lang {' '.join(f"WHEN '{lang}' THEN {i}" for lang, i in _KINDS.items())} END"


@query("a3_summarise_sources", f"""
WITH s AS (SELECT DISTINCT lang, source FROM documents)
SELECT {_PLACE} AS section, -1 AS ord, CASE lang {' '.join(f"WHEN '{lang}' THEN '{cx.SOURCE_HEADINGS[i][2]}'" for lang, i in _KINDS.items())} END AS text
FROM (SELECT DISTINCT lang FROM s)
UNION ALL SELECT {_PLACE}, row_number() OVER (PARTITION BY lang ORDER BY source) - 1, source FROM s""")
def _(t: Tables) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for lang, i in _KINDS.items() for x in (lang, " ".join(cx.SOURCE_HEADINGS[i][:2]))])
    kind = F.split(kinds[c("lang")], " ")
    configured = t("documents").select(kind[0].alias("source_type"), kind[1].alias("identifier_type"),
                                       c("source").alias("identifier"), c("source").alias("ord")).distinct()
    return cx.summarise_sources(configured)


@query("w1_chat_history", """
SELECT conv_id, turn, coalesce((SELECT string_agg(CASE p.role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'AI' ELSE 'System' END || ': ' || p.text, chr(10) ORDER BY p.turn)
  FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn
  AND (SELECT count(*) FROM conversations m WHERE m.conv_id = c.conv_id AND m.turn >= p.turn AND m.turn < c.turn) <= 10), '') AS history
FROM conversations c""")
def _(t: Tables) -> DataFrame:
    return cx.chat_history(t("conversations")).select("conv_id", "turn", "history")


@query("w8_with_ordinal", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS id FROM documents")
def _(t: Tables) -> DataFrame:
    from corpusflow.operators.ordering import number_rows
    return number_rows(t("documents").select("doc_id", "source", "n_chars"), ["source"], [c("n_chars").desc(), c("doc_id")], "id").drop("n_chars")


@query("a11_last_result", "SELECT conv_id, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def _(t: Tables) -> DataFrame:
    return cx.last_result(t("conversations"), ["conv_id"], "turn", ["role", "text"])


@query("a12_render_trace", """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord,
  '<tool>' || event_type || '</tool><tool_input>' || props || '</tool_input><observation>' || event_id || '</observation>' AS text FROM events""")
def _(t: Tables) -> DataFrame:
    return cx.render_trace(t("events"), ["user_id"], ["ts", "event_id"], tool="event_type", tool_input="props", observation="event_id")


@query("a12_tool_list", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ord, p_name || ' ' || p_partkey || ': ' || p_brand AS text FROM part")
def _(t: Tables) -> DataFrame:
    tools = t("part").select("p_partkey", F.concat("p_name", F.lit(" "), c("p_partkey").cast("string")).alias("name"), c("p_brand").alias("description"))
    return cx.tool_list(tools, ["p_partkey"])


# --- whole answers ----------------------------------------------------------------------------

_HISTORY = """hist AS (SELECT conv_id, turn, coalesce((SELECT string_agg(CASE p.role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'AI' ELSE 'System' END || ': ' || p.text, chr(10) ORDER BY p.turn)
  FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn
  AND (SELECT count(*) FROM conversations m WHERE m.conv_id = c.conv_id AND m.turn >= p.turn AND m.turn < c.turn) <= 10), '') AS history FROM conversations c)"""

_TEMPLATE_SQL = "'" + ANSWER_TEMPLATE.replace("'", "''").replace("{question}", "' || question || '").replace(
    "{context}", "' || context || '").replace("{chat_history}", "' || history || '") + "'"


def _messages(t: Tables) -> DataFrame:
    """Every message as a question, with the history before it."""
    key = F.concat(c("conv_id").cast("string"), F.lit("-"), c("turn").cast("string"))
    return cx.chat_history(t("conversations")).select(key.alias("qid"), c("text").alias("question"), "role", "history")


@query("q6_answer_context", f"""
WITH RECURSIVE {_HISTORY}, asked AS (SELECT conv_id || '-' || turn AS qid, text AS question, history FROM conversations JOIN hist USING (conv_id, turn)),
{SPLIT_CHUNKS}, {vectors_sql('cv', 'chunks', 'chunk_id', 'page_content')}, {vectors_sql('qv', 'asked', 'qid', 'question')}, {hits_sql('hits', 'qv', 'cv', 20)},
q AS (SELECT qid, list_distinct({tokens_sql('question')}) AS qw FROM asked),
p AS (SELECT chunk_id, namespace, page_content, list_distinct({tokens_sql('page_content')}) AS pw FROM chunks),
best AS (SELECT * FROM (SELECT qid, namespace, page_content, row_number() OVER (PARTITION BY qid ORDER BY round({overlap_sql('qw', 'pw')}, 9) DESC, rank) - 1 AS id
   FROM hits JOIN q USING (qid) JOIN p USING (chunk_id)) WHERE id < 5),
cited_rows AS (SELECT qid, string_agg('<doc id=''' || id || '''>' || page_content || '</doc>', chr(10) ORDER BY id) AS context,
   string_agg(id || ':' || namespace, ',' ORDER BY id) AS cited FROM best GROUP BY qid),
full_rows AS (SELECT qid, question, history, coalesce(context, '') AS context, coalesce(cited, '') AS cited FROM asked LEFT JOIN cited_rows USING (qid))
SELECT qid, context, cited, '[{{"role":"system","content":"{SYSTEM}"}},{{"role":"user","content":[{{"type":"text","text":' || CAST(to_json({_TEMPLATE_SQL}) AS VARCHAR) || '}}]}}]' AS prompt
FROM full_rows""")
def _(t: Tables) -> DataFrame:
    questions = _messages(t)
    queries = rt.embedded_queries(questions, "qid", "question")
    hits = rt.retrieve_rerank(_chunk_index(t), queries)
    full = rt.answer_context(questions, hits, SYSTEM)
    cited = F.array_join(F.transform("sources", lambda s: F.concat(s["id"].cast("string"), F.lit(":"), s["source"])), ",")
    return full.select("qid", "context", cited.alias("cited"), "prompt")


@query("q5_cited_answers", f"""
WITH RECURSIVE {_TEXT_HITS} SELECT qid, string_agg('<doc id=''' || (rank - 1) || '''>' || page_content || '</doc>', chr(10) ORDER BY rank) AS context,
  string_agg((rank - 1) || ':' || namespace || ':' || string_split(page_content, '.')[1] || ' ...', chr(10) ORDER BY rank) AS cited FROM best GROUP BY qid""")
def _(t: Tables) -> DataFrame:
    """The flagship job: documents and questions to cited contexts."""
    cited = F.transform("sources", lambda s: F.concat_ws(":", s["id"].cast("string"), s["source"], s["content"]))
    return cited_answers(t.spark, t.folder).select("qid", "context", F.array_join(cited, "\n").alias("cited"))


@query("q7_no_source_routing", f"""
WITH {_HISTORY}, asked AS (SELECT conv_id || '-' || turn AS qid, role, text AS question, history FROM conversations JOIN hist USING (conv_id, turn)),
full_rows AS (SELECT qid, question, history, CASE WHEN role = 'assistant' THEN '<doc id=''0''>' || role || '</doc>' ELSE '' END AS context FROM asked)
SELECT qid, context, '[{{"role":"system","content":"{SYSTEM}"}},{{"role":"user","content":[{{"type":"text","text":' || CAST(to_json({_TEMPLATE_SQL}) AS VARCHAR) || '}}]}}]' AS prompt
FROM full_rows""")
def _(t: Tables) -> DataFrame:
    questions = _messages(t)
    # only some questions chose a source; theirs is a one-passage list
    hits = questions.where("role = 'assistant'").select(
        "qid", F.lit(1).alias("rank"), c("role").alias("page_content"), F.create_map(F.lit("source"), c("role")).alias("metadata"))
    return rt.answer_context(questions, hits, SYSTEM).select("qid", "context", "prompt")
