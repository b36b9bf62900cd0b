"""Queries over sources, sinks and the registry."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusflow.catalog.base import SPLIT_CHUNKS, Tables, elements_sql, page_text_sql, query, vectors_sql
from corpusflow.functions import text as tx
from corpusflow.functions.urls import clean_url
from corpusflow.functions.vectors import embed
from corpusflow.operators import index as ix
from corpusflow.operators.graph import link_edges
from corpusflow.plans.retrieve import document_chunks
from corpusflow.session import scratch_path
from corpusflow.sources import documents as sd, files as sf, web as sw

_SOURCE_HASH = "'text-' || md5(lower(source)) || '.source'"


@query("s1_text_source", f"""
SELECT doc_id, {_SOURCE_HASH} AS source, text AS page_content, lang AS meta_lang, CAST(n_chars AS VARCHAR) AS meta_n_chars,
       {_SOURCE_HASH} AS meta_source FROM documents""")
def _(t: Tables) -> DataFrame:
    namespace = tx.source_hash(F.lit("text"), F.col("source"))
    docs = sd.text_source(t("documents"), "text", ["lang", "n_chars", "source"], namespace)
    meta = F.col("metadata")
    return docs.select("doc_id", "source", "page_content", meta["lang"].alias("meta_lang"),
                       meta["n_chars"].alias("meta_n_chars"), meta["source"].alias("meta_source"))


@query("s2_scan_files", "SELECT doc_id, text FROM documents")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "files")
    t("documents").select("doc_id", "text").write.option("maxRecordsPerFile", 1_000).json(path)
    files = sf.scan_files(t.spark, path)
    lines = files.select(F.explode(F.split(F.regexp_replace("page_content", r"\n\z", ""), "\n")).alias("line"))
    # a writer may leave an empty file behind, which is an empty document
    return lines.where("line <> ''").select(F.from_json("line", "doc_id long, text string").alias("d")).select("d.doc_id", "d.text")


_UPLOADS = "source || '/' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.PDF' WHEN 'es' THEN '.md' ELSE '.json' END"


@query("s3_filter_uploads", f"""
SELECT source, path, length FROM (
  SELECT source, path, length, row_number() OVER (PARTITION BY source ORDER BY path) AS r
  FROM (SELECT source, {_UPLOADS} AS path, n_chars AS length FROM documents)
  WHERE path NOT LIKE '%.md' AND length <= 10485760) WHERE r <= 5""")
def _(t: Tables) -> DataFrame:
    ext = F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "fr", ".PDF").when(F.col("lang") == "es", ".md").otherwise(".json")
    files = t("documents").select("source", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"),
                                  F.col("n_chars").alias("length"))
    return sf.filter_uploads(files, keys=["source"])


@query("s4_scan_repo", """
SELECT source, lang, '.txt' AS file_type, 'main' AS branch, 'https://git.example/corpus.git' AS url,
       unnest(string_split(text, chr(10))) AS line FROM documents""")
def _(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "repo")
    t("documents").select("source", "lang", "text").write.partitionBy("source", "lang").text(root)
    files = sf.scan_repo(t.spark, root, "https://git.example/corpus.git", "main", ["_SUCCESS", "*.crc"])
    meta = F.col("metadata")
    return files.select(
        F.regexp_extract(meta["source"], "source=([^/]*)/", 1).alias("source"),
        F.regexp_extract(meta["source"], "lang=([^/]*)/", 1).alias("lang"), meta["file_type"].alias("file_type"),
        meta["branch"].alias("branch"), meta["url"].alias("url"),
        F.explode(F.split(F.regexp_replace("page_content", r"\n\z", ""), "\n")).alias("line"))


_IGNORE = ["# generated", "src1/", "*.log", "fr/", "!src3/fr/", "/src2/de/**", "doc?.txt"]


@query("s5_drop_ignored", r"""
SELECT path FROM (SELECT source || '/' || lang || '/doc' || doc_id || '.txt' AS path FROM documents)
WHERE regexp_matches(path, '(^|/)src3/fr/') AND NOT regexp_matches(path, '(^|/)doc[^/]\.txt$')
   OR NOT (regexp_matches(path, '(^|/)src1/') OR regexp_matches(path, '(^|/)fr/') OR regexp_matches(path, '^src2/de/')
           OR regexp_matches(path, '(^|/)doc[^/]\.txt$'))""")
def _(t: Tables) -> DataFrame:
    files = t("documents").select(F.concat_ws("/", "source", "lang", F.concat(F.lit("doc"), "doc_id", F.lit(".txt"))).alias("path"))
    return sf.drop_ignored(files, _IGNORE)


@query("s5_rules_by_repo", r"""
WITH files AS (SELECT source AS repo, lang || '/doc' || doc_id || '.txt' AS path FROM documents),
hits AS (SELECT repo, path, regexp_matches(path, '^' || (SELECT 'es') || '/') AS es, regexp_matches(path, '(^|/)doc[^/]\.txt$') AS short,
  list_contains((SELECT list(DISTINCT lang) FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1 AND d.source = files.repo), split_part(path, '/', 1)) AS toxic,
  repo IN (SELECT DISTINCT source FROM documents WHERE lang = 'fr') AS has_fr FROM files)
SELECT repo, path FROM hits WHERE NOT coalesce(CASE WHEN has_fr AND es THEN false WHEN has_fr AND short THEN true WHEN toxic THEN true ELSE false END, false)""")
def _(t: Tables) -> DataFrame:
    """Every repository has rules of its own: the folders of its toxic languages go and, if it has French, short names but for Spanish ones."""
    docs = t("documents")
    files = docs.select(F.col("source").alias("repo"), F.concat(F.col("lang"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    toxic = docs.join(t("labels").where("toxic = 1"), "doc_id").select(F.col("source").alias("repo"), F.lit(0).alias("ord"), F.concat(F.lit("/"), "lang", F.lit("/")).alias("rule"))
    french = docs.where("lang = 'fr'").select(F.col("source").alias("repo")).distinct()
    more = [french.select("repo", F.lit(i).alias("ord"), F.lit(rule).alias("rule")) for i, rule in ((1, "# generated"), (2, "doc?.txt"), (3, "!/es/"))]
    rules = toxic.distinct()
    for part in more:
        rules = rules.unionByName(part)
    return sf.drop_ignored_by_repo(files, rules)


@query("s6_failed_pages", r"""
WITH links AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>', '', 'g'), '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages),
linked AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^([^/]*//[^/?#]*)', 1) || href, '#.*', '') AS url FROM links
  WHERE NOT regexp_matches(href, '^(mailto:|javascript:|#)') AND NOT regexp_matches(href, '\.(png|svg|jpg|jpeg|gif)$')),
stored AS (SELECT DISTINCT regexp_replace(url, '#.*', '') AS url FROM pages)
SELECT url AS source, CASE WHEN s.url IS NULL THEN 'LookupError: no page is stored' END AS error, s.url IS NOT NULL AS is_document
FROM (SELECT url FROM linked UNION SELECT url FROM stored) a LEFT JOIN stored s USING (url)""")
def _(t: Tables) -> DataFrame:
    """All pages that are stored or linked to, read in one pass: those that are not stored are reported."""
    pages = t("pages")
    stored = pages.groupBy(clean_url(F.col("url")).alias("url")).agg(F.min("html").alias("html"))
    linked = link_edges(pages).select(F.col("dst").alias("url")).unionByName(stored.select("url")).distinct()
    docs, errors = sw.load_pages(linked.join(stored, "url", "left"))
    return docs.select("source", F.lit(None).cast("string").alias("error"), F.lit(True).alias("is_document")).unionByName(
        errors.withColumn("is_document", F.lit(False)))


@query("s6_pages_to_documents", f"WITH {elements_sql(False)} SELECT url AS source, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS page_content FROM elements GROUP BY page_id, url")
def _(t: Tables) -> DataFrame:
    return sw.pages_to_documents(t.spread("pages", "page_id")).select("source", "page_content")


@query("s6_page_elements", f"WITH {elements_sql(False)} SELECT url AS source, ord, text AS page_content, category FROM elements")
def _(t: Tables) -> DataFrame:
    docs = sw.pages_to_documents(t.spread("pages", "page_id"), mode="elements")
    return docs.select("source", F.col("ord").cast("bigint").alias("ord"), "page_content", F.col("metadata")["category"].alias("category"))


@query("s7_wiki_documents", f"WITH {page_text_sql()} SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS space, text AS page_content FROM texts")
def _(t: Tables) -> DataFrame:
    pages = t.spread("pages", "page_id").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("space"), "html")
    return sw.wiki_documents(pages).select("page_id", "space", "page_content")


@query("s7_wiki_space", f"""
WITH {page_text_sql()}, largest AS (SELECT regexp_extract(url, '//([^/]+)', 1) AS space FROM pages GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT page_id, text AS page_content FROM texts WHERE regexp_extract(url, '//([^/]+)', 1) = (SELECT space FROM largest) AND NOT contains(url, '?')""")
def _(t: Tables) -> DataFrame:
    """The pages of one space, the largest, without its attachments (addresses with parameters)."""
    pages = t.spread("pages", "page_id").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("space"), "html", F.col("url").contains("?").alias("attached"))
    largest = t("pages").groupBy(F.regexp_extract("url", "//([^/]+)", 1).alias("space")).count().orderBy(F.desc("count"), "space").first()
    return sw.wiki_documents(pages, largest.space if largest else "", attachment_col="attached").select("page_id", "page_content")


@query("s8_scan_issues", """
SELECT o_orderkey, c_mktsegment AS assignee, strftime(o_orderdate, '%Y-%m-%d') AS created
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AND c_mktsegment = 'BUILDING'""")
def _(t: Tables) -> DataFrame:
    issues = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("o_orderpriority").alias("project"), F.col("o_orderstatus").alias("status"),
        F.col("c_mktsegment").alias("assignee"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"))
    return sd.scan_issues(issues, "1-URGENT", "O", "BUILDING").select("o_orderkey", "assignee", "created")


@query("s9_union_sources", """
SELECT doc_id AS id, source, text FROM documents
UNION ALL SELECT page_id, url, html FROM pages UNION ALL SELECT item_id, 'benchmark', text FROM benchmark""")
def _(t: Tables) -> DataFrame:
    return sd.union_sources([
        t("documents").select(F.col("doc_id").alias("id"), "source", "text"),
        t("pages").select(F.col("page_id").alias("id"), F.col("url").alias("source"), F.col("html").alias("text")),
        t("benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("source"), "text")])


@query("s10_require_rows", "SELECT doc_id, source FROM documents")
def _(t: Tables) -> DataFrame:
    return sd.require_rows(t("documents").select("doc_id", "source"), "no document found")


@query("s11_ingest_counts", "SELECT source, count(*) AS documents FROM documents GROUP BY source")
def _(t: Tables) -> DataFrame:
    return sd.ingest_counts(t("documents"))


@query("s11_counts_on_write", "SELECT source, count(*) AS documents FROM documents GROUP BY source")
def _(t: Tables) -> DataFrame:
    """Counted while the documents are written, for the sources that are configured."""
    docs = t("documents")
    configured = [r.source for r in docs.select("source").distinct().collect()]
    counts = sd.write_documents(docs, scratch_path(t.spark, "ingested"), configured, message="no document found")
    return t.spark.createDataFrame(list(counts.items()), "source string, documents bigint")


@query("u4_audit_rows", """
WITH b AS (SELECT lang, source, n_chars FROM documents WHERE lang <> 'es'), a AS (SELECT lang, source, n_chars FROM documents WHERE lang <> 'de' UNION ALL SELECT lang, source, n_chars FROM documents WHERE lang = 'fr')
SELECT 'gone' AS change, lang, source, n_chars, count(*) AS copies FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL
UNION ALL SELECT 'new', lang, source, n_chars, count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    """Two states of a table, some of whose rows differ only in how often they are there."""
    rows = t("documents").select("lang", "source", "n_chars")
    return ix.audit_rows(rows.where("lang <> 'es'"), rows.where("lang <> 'de'").unionByName(rows.where("lang = 'fr'")))


# --- stored index ------------------------------------------------------------------------

def _stored_index(t: Tables) -> str:
    """All documents, cut and embedded, as a stored index."""
    path = scratch_path(t.spark, "index")
    ix.write_index(embed(ix.fingerprint(document_chunks(t.spread("documents", "doc_id"))), "page_content"), path)
    return path


@query("k1_write_index", f"""
WITH RECURSIVE {SPLIT_CHUNKS}, {vectors_sql('vec', 'chunks', 'chunk_id', 'page_content')}
SELECT namespace, chunk_id, ord, page_content, len(list_filter(CAST(v AS DOUBLE[]), lambda x: x > 0)) AS used FROM chunks JOIN vec ON id = chunk_id""")
def _(t: Tables) -> DataFrame:
    return ix.read_index(t.spark, _stored_index(t)).select(
        "namespace", "chunk_id", F.col("ord").cast("bigint").alias("ord"), "page_content",
        F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("used"))


@query("k2_read_index", f"""
WITH RECURSIVE {SPLIT_CHUNKS} SELECT namespace, count(*) AS chunks, CAST(sum(length(page_content)) AS BIGINT) AS chars, 64 AS dimension FROM chunks GROUP BY namespace
UNION ALL SELECT 'missing', 0, 0, NULL""")
def _(t: Tables) -> DataFrame:
    path = _stored_index(t)
    totals = (F.count("*").alias("chunks"), F.coalesce(F.sum(F.length("page_content")), F.lit(0)).alias("chars"), F.max(F.size("embedding")).alias("dimension"))
    absent = ix.read_index(t.spark, path, "missing").agg(*totals).select(F.lit("missing").alias("namespace"), "chunks", "chars", "dimension")
    return ix.read_index(t.spark, path).groupBy("namespace").agg(*totals).unionByName(absent)


@query("k3_list_indexes", f"WITH RECURSIVE {SPLIT_CHUNKS} SELECT DISTINCT namespace FROM chunks")
def _(t: Tables) -> DataFrame:
    return ix.list_indexes(t.spark, _stored_index(t))


@query("k4_build_ephemeral", f"""
WITH RECURSIVE {SPLIT_CHUNKS}, {vectors_sql('vec', 'chunks', 'chunk_id', 'page_content')}
SELECT id AS chunk_id, len(l) AS dimension, len(list_filter(l, lambda x: x > 0)) AS used, round(list_max(l), 6) AS top
FROM (SELECT id, CAST(v AS DOUBLE[]) AS l FROM vec)""")
def _(t: Tables) -> DataFrame:
    index = ix.build_ephemeral(document_chunks(t.spread("documents", "doc_id")))
    return index.select("chunk_id", F.size("embedding").cast("bigint").alias("dimension"),
                        F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("used"),
                        F.round(F.array_max("embedding").cast("double"), 6).alias("top"))


def _registry(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All sources; those with a label already; those with an index."""
    docs = t("documents")
    hash_ = tx.source_hash(F.lit("web"), F.col("source"))
    all_sources = docs.select(hash_.alias("hash"), F.lit("web").alias("source_type"), F.lit("links").alias("identifier_type"),
                              F.col("source").alias("identifier")).distinct()
    labelled = (docs.join(t("labels").where("toxic = 1"), "doc_id")
                .select(hash_.alias("hash"), F.concat(F.lit("Label of "), "source").alias("label")).distinct())
    indexed = docs.where("lang = 'es'").select(hash_.alias("namespace")).distinct()
    return all_sources, labelled, indexed


_REGISTRY = """all_sources AS (SELECT DISTINCT 'web-' || md5(lower(source)) || '.source' AS hash, source FROM documents),
labelled AS (SELECT DISTINCT 'web-' || md5(lower(source)) || '.source' AS hash, 'Label of ' || source AS label
             FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
indexed AS (SELECT DISTINCT 'web-' || md5(lower(source)) || '.source' AS namespace FROM documents WHERE lang = 'es')"""


@query("k5_register_labels", f"""
WITH {_REGISTRY} SELECT hash, 'New label of ' || source AS label FROM all_sources WHERE hash NOT IN (SELECT hash FROM labelled)""")
def _(t: Tables) -> DataFrame:
    every, labelled, _ = _registry(t)
    return ix.register_labels(labelled, every.select("hash", F.concat(F.lit("New label of "), "identifier").alias("label")))


@query("k6_available_labels", f"WITH {_REGISTRY} SELECT hash, label FROM labelled WHERE hash IN (SELECT namespace FROM indexed)")
def _(t: Tables) -> DataFrame:
    _, labelled, indexed = _registry(t)
    return ix.available_labels(labelled, indexed)


@query("j1_sources_to_refresh", f"""
WITH {_REGISTRY} SELECT hash, 'web' AS source_type, 'links' AS identifier_type, source AS identifier
FROM all_sources WHERE hash NOT IN (SELECT hash FROM labelled)""")
def _(t: Tables) -> DataFrame:
    every, labelled, _ = _registry(t)
    return ix.sources_to_refresh(every, labelled, known_types=sd.SOURCE_TYPES).select("hash", "source_type", "identifier_type", "identifier")


@query("j1_force_refresh", f"""
WITH {_REGISTRY} SELECT hash, source AS identifier FROM all_sources""")
def _(t: Tables) -> DataFrame:
    every, labelled, _ = _registry(t)
    return ix.sources_to_refresh(every, labelled, force=True).select("hash", "identifier")


@query("f3_select_source", f"""
WITH RECURSIVE {SPLIT_CHUNKS} SELECT choice, count(chunk_id) AS chunks FROM
 (SELECT 'all' AS choice, chunk_id FROM chunks UNION ALL SELECT 'src3', chunk_id FROM chunks WHERE namespace = 'src3')
GROUP BY choice UNION ALL SELECT 'none', 0""")
def _(t: Tables) -> DataFrame:
    index = ix.read_index(t.spark, _stored_index(t))
    parts = [ix.select_source(index, choice).agg(F.count("*").alias("chunks")).select(F.lit(choice).alias("choice"), "chunks")
             for choice in ("all", "none", "src3")]
    return sd.union_sources(parts)


@query("f6_resolve_label", f"""
WITH {_REGISTRY}, requests AS (SELECT DISTINCT 'Label of ' || source AS label FROM documents)
SELECT r.label, coalesce(min(l.hash), 'none') AS hash FROM requests r LEFT JOIN labelled l ON l.label = r.label GROUP BY r.label""")
def _(t: Tables) -> DataFrame:
    _, labelled, _ = _registry(t)
    return ix.resolve_label(t("documents").select(F.concat(F.lit("Label of "), "source").alias("label")).distinct(), labelled)
