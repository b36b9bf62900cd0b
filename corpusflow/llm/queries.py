"""The registered queries of this subpackage and their SQL."""
from __future__ import annotations

import public_tokenizers

import corpus_pipeline
from corpusflow.catalog.base import query
from corpusflow.llm import alignment, bpe, decontaminate, jaccard_join, language, main_text, quality, secret_scan, shards, suffix_dedup, token_count, url_filter, whitening


@query("op1_secret_scans")
def op1_secret_scans(table):
    return secret_scan.scan_secrets(table("documents")).drop("found")


@query("op2_quality_rules")
def op2_quality_rules(table):
    return quality.judge_quality(table("documents"), quality.train_quality(table("documents"), table("labels")))


@query("op3_url_filters", f"""
WITH parts AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM parts),
fits AS (SELECT s.page_id, r.verdict, r.host || r.path AS rule, row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.host || r.path) DESC) AS nr
  FROM split s JOIN {url_filter.rules_sql()} ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, '{url_filter.DEFAULT}') AS verdict
FROM split s LEFT JOIN fits f ON f.page_id = s.page_id AND f.nr = 1""")
def op3_url_filters(table):
    judged = url_filter.judge_urls(table("pages").select("page_id", "url"), url_filter.rules_table(table.spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op4_token_counts")
def op4_token_counts(table):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return token_count.count_tokens(table("documents"), f.read())


@query("op5_html_extraction")
def op5_html_extraction(table):
    return main_text.extract_main_text(table("pages"))


@query("op6_language_id")
def op6_language_id(table):
    return language.identify(table("documents")).drop("bits_per_byte")


@query("op7_benchmark_decontamination", r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
  SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
widths AS (SELECT DISTINCT n FROM windows),
runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words JOIN widths ON len(w) >= n)),
hits AS (SELECT r.doc_id, r.i, r.n, w.item FROM runs r JOIN windows w ON w.n = r.n AND w.win = r.win),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.names, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)""")
def op7_benchmark_decontamination(table):
    return decontaminate.contamination(table("documents"), table("benchmark")).drop("spans")


@query("op8_bpe_round_trip")
def op8_bpe_round_trip(table):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return bpe.round_trip(table("documents"), f.read())




@query("op9_jaccard_join", """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= 85 * (p.n + q.n - common)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.y FROM reach r JOIN ends b ON b.x = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) USING (doc_id)""")
def op9_jaccard_join(table):
    return jaccard_join.jaccard_components(table("documents"))


@query("op10_suffix_dedup", """
WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS (SELECT doc_id, i, md5(hex(b[i:i + 199])) AS s FROM (SELECT doc_id, b, unnest(range(1, n - 198)) AS i FROM bytes WHERE n >= 200)),
twice AS (SELECT s FROM strings GROUP BY s HAVING count(*) > 1),
starts AS (SELECT doc_id, i FROM strings SEMI JOIN twice USING (s)),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM starts),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked) GROUP BY doc_id, k),
gaps AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans,
  list_prepend(1, list(z ORDER BY a)) AS froms, list(a ORDER BY a) AS tos FROM runs GROUP BY doc_id)
SELECT b.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN froms IS NULL THEN sha256(b.b) ELSE sha256(unhex(array_to_string(list_transform(list_zip(froms, list_append(tos, n + 1)), lambda x: hex(b.b[x[1]:x[2] - 1])), ''))) END AS kept_sha256
FROM bytes b LEFT JOIN gaps USING (doc_id)""")
def op10_suffix_dedup(table):
    return suffix_dedup.remove_repeats(table("documents"))


@query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(table):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return alignment.align_tokens(table("documents"), a.read(), b.read())[0]


@query("op12_embedding_whitening")
def op12_embedding_whitening(table):
    return whitening.whiten(table("embeddings"))


@query("op13_sharding")
def op13_sharding(table):
    return shards.shard_documents(table("documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(table):
    return corpus_pipeline.run(table.spark, table.folder)
