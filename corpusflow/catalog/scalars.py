"""Queries over column functions and text transforms."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusflow.catalog.base import CHUNKS, CHUNKS_RECURSIVE, Tables, page_text_sql, query, strip_sql, vectors_sql
from corpusflow.functions import changes as ch, prompts as pr, text as tx, urls as ur, vectors as ve
from corpusflow.operators.chunking import chunk_fixed, chunk_recursive
from corpusflow.sources import web as sw

c = F.col


@query("p1_source_hash", "SELECT doc_id, 'web-' || md5(lower(source || lang)) || '.source' AS hash FROM documents")
def _(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", tx.source_hash(F.lit("web"), F.concat("source", "lang")).alias("hash"))


@query("p2_memory_namespace", "SELECT c_custkey, 'short_term-' || md5(lower(c_name)) AS namespace FROM customer")
def _(t: Tables) -> DataFrame:
    return t("customer").select("c_custkey", tx.memory_namespace(F.concat(F.lit("\t "), "c_name", F.lit(" \n")), F.lit(" Short_Term ")).alias("namespace"))


@query("p3_normalize_url", r"""
SELECT page_id, regexp_replace(url, '/\z', '') AS plain, regexp_replace(url || '/', '/\z', '') AS slashed FROM pages""")
def _(t: Tables) -> DataFrame:
    return t("pages").select("page_id", ur.normalize_url(c("url")).alias("plain"), ur.normalize_url(F.concat("url", F.lit("/"))).alias("slashed"))


@query("p4_base_path", r"""
SELECT page_id, CASE WHEN contains(regexp_extract(path, '([^/]*)\z', 1), '.') THEN regexp_replace(site || regexp_replace(path, '/[^/]*\z', ''), '/\z', '')
       ELSE regexp_replace(url, '/\z', '') END AS base,
       site || regexp_replace(path, '/\z', '') AS file_base
FROM (SELECT page_id, url, regexp_extract(url, '^([^/]*//[^/?#]*)', 1) AS site, regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def _(t: Tables) -> DataFrame:
    bare = F.regexp_extract("url", "^[^?#]*", 0)
    return t("pages").select("page_id", ur.base_path(c("url")).alias("base"),
                             ur.base_path(F.concat(F.regexp_replace(bare, r"/\z", ""), F.lit("/index.html?a=1#b"))).alias("file_base"))


@query("p5_clean_url", "SELECT page_id, regexp_replace(url, '#.*', '') AS clean FROM pages")
def _(t: Tables) -> DataFrame:
    return t("pages").select("page_id", ur.clean_url(c("url")).alias("clean"))


_HREFS = r"""links AS (
  SELECT page_id, url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>', '', 'g'),
                              '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages),
hrefs AS (SELECT page_id, url, replace(href, '&amp;', '&') AS href FROM links)"""


@query("p6_resolve_url", rf"""
WITH {_HREFS} SELECT page_id, href, regexp_extract(url, '^([^/]*//[^/?#]*)', 1) || href AS link FROM hrefs""")
def _(t: Tables) -> DataFrame:
    return sw.page_links(t("pages")).select("page_id", "href", ur.resolve_url(c("url"), c("href")).alias("link"))


@query("p7_quote_seed", """
SELECT page_id, replace(replace(url_encode(url), '%2F', '/'), '%3A', ':') AS quoted FROM pages""")
def _(t: Tables) -> DataFrame:
    return t("pages").select("page_id", ur.quote_seed(c("url")).alias("quoted"))


@query("p8_with_https", "SELECT page_id, CASE WHEN url LIKE 'https://%' THEN url ELSE 'https://' || url END AS url FROM pages")
def _(t: Tables) -> DataFrame:
    return t("pages").select("page_id", ur.with_https(c("url")).alias("url"))


def _with_meta(t: Tables) -> DataFrame:
    """Documents with git metadata for some languages: full, without branch, none."""
    url = F.when(c("lang") == "en", F.concat(F.lit("https://git.example/"), "source", F.lit(".git"))) \
        .when(c("lang") == "fr", F.concat(F.lit("https://git.example/"), "source", F.lit(".gitx"))) \
        .when(c("lang") == "de", F.lit("https://web.example/page"))
    meta = F.create_map(F.lit("url"), url, F.lit("branch"), F.when(c("n_chars") > 500, "main"), F.lit("source"), c("source"),
                        F.lit("title"), F.when(c("lang") == "es", F.lit("")).when(c("lang") == "de", F.concat(F.lit("Title "), "source")))
    return t("documents").withColumn("metadata", meta)


_META = """meta AS (SELECT *, CASE lang WHEN 'en' THEN 'https://git.example/' || source || '.git'
   WHEN 'fr' THEN 'https://git.example/' || source || '.gitx' WHEN 'de' THEN 'https://web.example/page' END AS url,
   CASE WHEN n_chars > 500 THEN 'main' END AS branch,
   CASE lang WHEN 'es' THEN '' WHEN 'de' THEN 'Title ' || source END AS title FROM documents)"""
_GIT = r"coalesce(regexp_replace(url, '\.git$', '') || '/-/blob/' || branch || '/' || source, source)"
_CITED = f"CASE WHEN contains(url, '.git') THEN {_GIT} ELSE source END"
_SNIPPET = f"coalesce(nullif(title, ''), string_split({strip_sql('text')}, '.')[1] || ' ...')"


@query("p9_git_source", f"WITH {_META} SELECT doc_id, {_GIT} AS link FROM meta")
def _(t: Tables) -> DataFrame:
    return _with_meta(t).select("doc_id", tx.git_source(c("metadata")).alias("link"))


@query("p10_citation_source", f"WITH {_META} SELECT doc_id, {_CITED} AS link FROM meta")
def _(t: Tables) -> DataFrame:
    return _with_meta(t).select("doc_id", tx.citation_source(c("metadata")).alias("link"))


@query("p11_snippet", f"WITH {_META} SELECT doc_id, {_SNIPPET} AS snippet FROM meta")
def _(t: Tables) -> DataFrame:
    return _with_meta(t).select("doc_id", tx.snippet(c("text"), c("metadata")["title"]).alias("snippet"))


@query("p12_strip_ansi", "SELECT doc_id, text FROM documents")
def _(t: Tables) -> DataFrame:
    esc = "\x1b"
    coloured = F.concat(F.lit(f"{esc}[1;31m"), F.replace("text", F.lit(" "), F.lit(f"{esc}[0K {esc}[?25h")), F.lit(f"{esc}[0m"))
    return t("documents").select("doc_id", ch.strip_ansi(coloured).alias("text"))


_DIFF = r"'+' || replace(replace(text, '. ', '.' || chr(10) || '-'), ', ', ',' || chr(10) || '++')"


@query("p13_diff_counts", rf"""
SELECT doc_id, len(regexp_extract_all(d, '(?m)^\+[^+]')) AS added, len(regexp_extract_all(d, '(?m)^-(?:[^-]|$)')) AS removed
FROM (SELECT doc_id, {_DIFF} AS d FROM documents)""")
def _(t: Tables) -> DataFrame:
    added, removed = ch.diff_counts(_diff(c("text")))
    return t("documents").select("doc_id", added.alias("added"), removed.alias("removed"))


def _diff(text):
    text = F.replace(F.replace(text, F.lit(". "), F.lit(".\n-")), F.lit(", "), F.lit(",\n++"))
    return F.concat(F.lit("+"), text)


@query("p14_change_type", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'New File' WHEN o_orderpriority = '1-URGENT' THEN 'Renamed File'
       WHEN o_orderstatus = 'F' THEN 'Deleted File' ELSE 'Modified' END AS change FROM orders""")
def _(t: Tables) -> DataFrame:
    change = ch.change_type(c("o_orderstatus") == "O", c("o_orderpriority") == "1-URGENT", c("o_orderstatus") == "F")
    return t("orders").select("o_orderkey", change.alias("change"))


@query("p15_wrap_refs", r"""
SELECT doc_id, chr(10) || chr(10) || '<#ref' || doc_id || '#> ' || replace(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10), chr(10))
  || ' <#ref' || doc_id || '#>' || chr(10) || chr(10) AS wrapped FROM documents""")
def _(t: Tables) -> DataFrame:
    paragraphs = F.replace("text", F.lit(". "), F.lit(".\n\n"))
    return t("documents").select("doc_id", tx.wrap_refs(paragraphs, c("doc_id")).alias("wrapped"))


_REF_TEXT = """CASE lang WHEN 'en' THEN chr(10) || '<#ref' || doc_id || '#> ' || text || ' <#ref' || doc_id || '#>' || chr(10)
  WHEN 'fr' THEN text || ' ref' || doc_id || '#' WHEN 'de' THEN '2023 ' || text WHEN 'es' THEN repeat(' ', CAST(n_chars % 2 AS INT)) || text END"""


@query("p16_extract_ref", rf"""
WITH src AS (SELECT doc_id, {strip_sql(_REF_TEXT)} AS s FROM documents),
tags AS (SELECT *, regexp_matches(s, '\A(?:<#)?(?:ref)?(\d+)(?:#>?)?') AS a, regexp_matches(s, '(?:<#)?(?:ref)?(\d+)(?:#>?)?\z') AS b FROM src)
SELECT doc_id, CASE WHEN a THEN {strip_sql("regexp_replace(s, '\\A(?:<#)?(?:ref)?(\\d+)(?:#>?)?', '')")}
   WHEN b THEN {strip_sql("regexp_replace(s, '(?:<#)?(?:ref)?(\\d+)(?:#>?)?\\z', '')")} ELSE s END AS clean,
 CASE WHEN a THEN TRY_CAST(regexp_extract(s, '\A(?:<#)?(?:ref)?(\d+)(?:#>?)?', 1) AS BIGINT)
   WHEN b THEN TRY_CAST(regexp_extract(s, '(?:<#)?(?:ref)?(\d+)(?:#>?)?\z', 1) AS BIGINT) ELSE -1 END AS ref FROM tags""")
def _(t: Tables) -> DataFrame:
    key = c("doc_id").cast("string")
    marked = (F.when(c("lang") == "en", F.concat(F.lit("\n<#ref"), key, F.lit("#> "), "text", F.lit(" <#ref"), key, F.lit("#>\n")))
              .when(c("lang") == "fr", F.concat("text", F.lit(" ref"), key, F.lit("#")))
              .when(c("lang") == "de", F.concat(F.lit("2023 "), "text"))
              .otherwise(F.concat(F.repeat(F.lit(" "), (c("n_chars") % 2).cast("int")), "text")))
    clean, ref = tx.extract_ref(marked)
    return t("documents").select("doc_id", clean.alias("clean"), ref.alias("ref"))


@query("p17_parse_queries", "SELECT item_id, pos, CASE pos WHEN 0 THEN text ELSE 'about ' || item_id END AS query FROM benchmark, range(2) r(pos)")
def _(t: Tables) -> DataFrame:
    literal = F.concat(F.lit(" "), F.to_json(F.array(c("text"), F.concat(F.lit("about "), c("item_id").cast("string")))), F.lit("\n"))
    lists = t("benchmark").select("item_id", tx.parse_queries(literal).alias("q"))
    return lists.select("item_id", F.posexplode("q").alias("pos", "query")).withColumn("pos", c("pos").cast("bigint"))


_SOURCE_OF_ITEM = "CASE WHEN length(text) > 200 THEN ' Web: ' || item_id || ' ' END"


@query("p18_with_source_suffix", f"""
SELECT item_id, {strip_sql(f"text || ' %' || coalesce(trim({_SOURCE_OF_ITEM}), 'none') || '%'")} AS message FROM benchmark""")
def _(t: Tables) -> DataFrame:
    return t("benchmark").select("item_id", tx.with_source_suffix(c("text"), _source_of_item()).alias("message"))


def _source_of_item():
    return F.when(F.length("text") > 200, F.concat(F.lit(" Web: "), c("item_id").cast("string"), F.lit(" ")))


@query("p19_parse_source_suffix", f"""
SELECT item_id, CASE WHEN length(text) > 400 THEN text ELSE {strip_sql('text')} END AS message,
  CASE WHEN length(text) > 400 THEN 'none' ELSE coalesce(trim({_SOURCE_OF_ITEM}), 'none') END AS label FROM benchmark""")
def _(t: Tables) -> DataFrame:
    typed = F.when(F.length("text") > 400, c("text")).otherwise(tx.with_source_suffix(c("text"), _source_of_item()))
    message, label = tx.parse_source_suffix(typed)
    return t("benchmark").select("item_id", message.alias("message"), label.alias("label"))


@query("p20_day_part", """
SELECT event_id, CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'Good morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'Good afternoon'
  WHEN hour(ts) BETWEEN 17 AND 20 THEN 'Good evening' ELSE 'Hello' END AS greeting FROM events""")
def _(t: Tables) -> DataFrame:
    return t("events").select("event_id", tx.day_part(c("ts")).alias("greeting"))


@query("p21_file_parts", r"""
SELECT page_id, regexp_extract(path, '([^/]*)\z', 1) AS name, 'page.tar.gz' AS file_name, '.gz' AS file_type, '' AS hidden_type
FROM (SELECT page_id, regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def _(t: Tables) -> DataFrame:
    path = F.regexp_extract("url", r"^[^/]*//[^/?#]*([^?#]*)", 1)
    folder = F.concat(path, F.lit("/"))
    name, ext = tx.file_parts(F.concat(folder, F.lit("page.tar.gz")))
    return t("pages").select("page_id", tx.file_parts(path)[0].alias("name"), name.alias("file_name"), ext.alias("file_type"),
                             tx.file_parts(F.concat(folder, F.lit(".profile")))[1].alias("hidden_type"))


@query("p22_field_or_none", "SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'None') AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def _(t: Tables) -> DataFrame:
    return t("documents").join(t("labels"), "doc_id", "left").select("doc_id", tx.field_or_none(c("quality")).alias("quality"))


@query("p23_data_uri", "SELECT doc_id, 'data:image/png;base64,' || to_base64(encode(text)) AS uri FROM documents")
def _(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", pr.data_uri(c("text").cast("binary"), F.lit("image/png")).alias("uri"))


@query("p24_image_parts", """
SELECT doc_id, CASE WHEN lang = 'en' THEN NULL WHEN lang = 'fr' THEN 'image/png' ELSE 'image/png,image/jpeg' END AS mimes FROM documents""")
def _(t: Tables) -> DataFrame:
    def file(mime):
        return F.struct(F.lit(mime).alias("mime"), c("source").alias("path"))
    files = F.when(c("lang") == "en", F.array(file("text/plain"))).when(c("lang") == "fr", F.array(file("image/png"), file("text/image"))) \
        .otherwise(F.array(file("image/png"), file("application/pdf"), file("image/jpeg")))
    return t("documents").select("doc_id", F.array_join(pr.image_parts(files)["mime"], ",").alias("mimes"))


@query("p25_render", """
SELECT conv_id, turn, 'Q: ' || text || chr(10) || 'by {role} ' || role || chr(10) || coalesce(CASE WHEN turn > 0 THEN 'turn {question}' END, '') AS prompt
FROM conversations""")
def _(t: Tables) -> DataFrame:
    return t("conversations").select("conv_id", "turn", pr.render(
        "Q: {question}\n{by} {role}\n{context}", question=c("text"), by=F.lit("by {role}"), role=c("role"),
        context=F.when(c("turn") > 0, F.lit("turn {question}"))).alias("prompt"))


@query("p26_prompt_messages", """
SELECT conv_id, turn, '[{"role":"system","content":"Answer, please."},{"role":"user","content":[{"type":"text","text":' || CAST(to_json(text) AS VARCHAR) || '}'
  || CASE WHEN role = 'user' THEN ',{"type":"image_url","image_url":{"url":"data:image/png;base64,' || to_base64(encode(role)) || '"}}' ELSE '' END
  || ']}]' AS messages FROM conversations""")
def _(t: Tables) -> DataFrame:
    picture = F.when(c("role") == "user", F.array(pr.data_uri(c("role").cast("binary"), F.lit("image/png"))))
    return t("conversations").select("conv_id", "turn", pr.prompt_messages(F.lit("Answer, please."), c("text"), picture).alias("messages"))


@query("p27_report_json", """
SELECT o_orderkey, '{"id":' || o_orderkey || ',"info":{"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '","label":null},"parts":["'
  || o_orderstatus || '","' || o_orderpriority || '"]}' AS report FROM orders""")
def _(t: Tables) -> DataFrame:
    info = F.struct(c("o_orderstatus").alias("status"), c("o_orderpriority").alias("priority"), F.lit(None).cast("string").alias("label"))
    return t("orders").select("o_orderkey", pr.to_report_json(
        id=c("o_orderkey"), info=info, parts=F.array("o_orderstatus", "o_orderpriority")).alias("report"))


@query("p28_json_field", """
SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN user_id % 3 > 0 THEN event_type END AS deep, 'false' AS flag FROM events""")
def _(t: Tables) -> DataFrame:
    """The payload stands beside an author, who is missing in every third event."""
    author = F.when(c("user_id") % 3 > 0, F.struct(c("event_type").alias("username")))
    payload = F.to_json(F.struct(c("props").alias("raw"), author.alias("author")))
    return t("events").withColumn("payload", payload).select(
        "event_id", pr.json_field(c("props"), "k").alias("k"), pr.json_field(c("payload"), "author.username").alias("deep"),
                              pr.json_field(c("payload"), "new_file", F.lit("false")).alias("flag"))


# --- text transforms ---------------------------------------------------------------------

@query("t1_markup_to_text", f"WITH {page_text_sql()} SELECT page_id, text FROM texts")
def _(t: Tables) -> DataFrame:
    return sw.markup_to_text(t.spread("pages", "page_id"), "html").select("page_id", "text")


@query("t2_chunk_recursive", f"WITH RECURSIVE {CHUNKS_RECURSIVE} SELECT doc_id, ord, page_content AS chunk FROM rec_chunks")
def _(t: Tables) -> DataFrame:
    return chunk_recursive(t.spread("documents", "doc_id").select("doc_id", "text")).withColumn("ord", c("ord").cast("bigint"))


@query("t3_chunk_fixed", f"WITH {CHUNKS} SELECT doc_id, ord, page_content AS chunk FROM chunks")
def _(t: Tables) -> DataFrame:
    return chunk_fixed(t("documents").select("doc_id", "text")).select("doc_id", c("ord").cast("bigint").alias("ord"), "chunk")


@query("t4_embed", f"""
WITH {vectors_sql('vec', 'documents', 'doc_id', 'text')}
SELECT doc_id, dim, round(CAST(w AS DOUBLE), 6) AS weight FROM (SELECT id AS doc_id, unnest(range(64)) AS dim, unnest(CAST(v AS DOUBLE[])) AS w FROM vec)""")
def _(t: Tables) -> DataFrame:
    vectors = ve.embed(t.spread("documents", "doc_id").select("doc_id", "text"), "text")
    return vectors.select("doc_id", F.posexplode("embedding").alias("dim", "weight")).select(
        "doc_id", c("dim").cast("bigint").alias("dim"), F.round(c("weight").cast("double"), 6).alias("weight"))


@query("t5_check_dim", "SELECT vec_id, len(embedding) AS dimension FROM embeddings WHERE len(embedding) <> 32")
def _(t: Tables) -> DataFrame:
    return ve.check_dim(t("embeddings"), 32).select("vec_id", F.size("embedding").cast("bigint").alias("dimension"))


# --- links -------------------------------------------------------------------------------

@query("g3_page_links", f"WITH {_HREFS} SELECT page_id, url, href FROM hrefs")
def _(t: Tables) -> DataFrame:
    return sw.page_links(t("pages")).select("page_id", "url", "href")


_MORE_LINKS = """more AS (SELECT page_id, url, href FROM hrefs UNION ALL SELECT page_id, url, href || '.png' FROM hrefs
  UNION ALL SELECT page_id, url, 'mailto:' || href FROM hrefs UNION ALL SELECT page_id, url, '#' || href FROM hrefs)"""


@query("f1_keep_link", rf"""
WITH {_HREFS}, {_MORE_LINKS} SELECT page_id, href FROM more
WHERE NOT regexp_matches(href, '^(mailto:|javascript:|#)') AND NOT regexp_matches(href, '\.(png|svg|jpg|jpeg|gif)$')""")
def _(t: Tables) -> DataFrame:
    links = sw.page_links(t("pages")).select("page_id", "href")
    more = (links.unionAll(links.withColumn("href", F.concat("href", F.lit(".png"))))
            .unionAll(links.withColumn("href", F.concat(F.lit("mailto:"), "href")))
            .unionAll(links.withColumn("href", F.concat(F.lit("#"), "href"))))
    return more.where(ur.keep_link(c("href")))


@query("f2_under_base", rf"""
WITH {_HREFS} SELECT page_id, link FROM (SELECT page_id, regexp_extract(url, '^([^/]*//[^/?#]*)', 1) AS site, href,
   regexp_extract(url, '^([^/]*//[^/?#]*)', 1) || href AS link FROM hrefs) WHERE starts_with(link, site || '/t')""")
def _(t: Tables) -> DataFrame:
    links = sw.page_links(t("pages")).select("page_id", "url", ur.resolve_url(c("url"), c("href")).alias("link"))
    site = F.concat(F.regexp_extract("url", "^([^/]*//[^/?#]*)", 1), F.lit("/t"))
    return links.where(ur.under_base(c("link"), site)).select("page_id", "link")


@query("t2_chunk_text_sql", f"WITH RECURSIVE {CHUNKS_RECURSIVE} SELECT doc_id, ord, page_content AS chunk FROM rec_chunks")
def _(t: Tables) -> DataFrame:
    from corpusflow.functions.sql import register
    register(t.spark)
    return t.spark.sql("SELECT doc_id, CAST(ord AS BIGINT) AS ord, chunk FROM {docs} LATERAL VIEW posexplode(chunk_text(text, 1500, 300)) c AS ord, chunk",
                       docs=t("documents"))


@query("t2_chunk_rows_sql", f"WITH RECURSIVE {CHUNKS_RECURSIVE} SELECT CAST(doc_id AS VARCHAR) AS id, ord, page_content AS chunk FROM rec_chunks")
def _(t: Tables) -> DataFrame:
    """The same as a table function, a batch of rows at a time."""
    from corpusflow.functions.sql import register
    register(t.spark)
    return t.spark.sql("SELECT id, CAST(ord AS BIGINT) AS ord, chunk FROM chunk_rows(TABLE(SELECT doc_id, text FROM {docs}))", docs=t("documents"))
