"""Registered queries and the SQL that states the same result."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusflow.session import read_spread, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(table) -> DataFrame``; ``table(name)`` reads one of the given tables."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Tables(spark, sf_dir))
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


class Tables:
    """Reads the tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """The same for costly work per row."""
        return read_spread(self.spark, f"{self.folder}/{name}.parquet", key)


# --- SQL building blocks -----------------------------------------------------------------

def strip_sql(x: str) -> str:
    space = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
    return f"regexp_replace({x}, '\\A{space}+|{space}+\\z', '', 'g')"


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[ \\t\\r\\n]+'), lambda w: w <> '')"


CHUNKS = """chunks AS (
  SELECT source AS namespace, doc_id || '#' || ord AS chunk_id, doc_id, ord, substr(text, ord * 1200 + 1, 1500) AS page_content
  FROM (SELECT *, unnest(range(0, CAST(ceil(greatest(length(text) - 300, 1) / 1200.0) AS BIGINT))) AS ord
        FROM documents WHERE length(text) > 0))"""


# The splitting rules over prefix sums. A run is a stretch of pieces that are packed together: neighbouring short lines, or the
# words of a long line (of a text without line ends); the stored texts have no blank lines. From its first piece a chunk takes as
# many as fit; the next one starts at the first piece from where the rest fits into the overlap and leaves room for the piece to come.
CHUNKS_RECURSIVE = f"""line_pieces AS (SELECT doc_id, pos, CASE WHEN pos > 0 THEN chr(10) ELSE '' END || s AS piece, contains(text, chr(10)) AS has_lines
  FROM (SELECT doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS s FROM documents)),
placed AS (SELECT *, length(piece) >= 1500 OR NOT has_lines AS long,
  sum(CASE WHEN length(piece) >= 1500 OR NOT has_lines THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM line_pieces WHERE piece <> ''),
run_pieces AS (SELECT doc_id, k, 1 AS side, pos, piece FROM placed WHERE NOT long
  UNION ALL SELECT doc_id, k, 0, wpos, word FROM (SELECT doc_id, k, unnest(range(0, len(ws))) AS wpos, unnest(list_transform(ws, lambda w, i: CASE WHEN i > 1 THEN sep || w ELSE w END)) AS word
    FROM (SELECT doc_id, k, sep, string_split(piece, sep) AS ws FROM (SELECT *, CASE WHEN contains(piece, ' ') THEN ' ' ELSE '' END AS sep FROM placed WHERE long))) WHERE word <> ''),
sums AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, k, side ORDER BY pos) AS p FROM run_pieces),
runs AS (SELECT doc_id, k, side, string_agg(piece, '' ORDER BY pos) AS txt, list(CAST(p AS BIGINT) ORDER BY pos) AS p FROM sums GROUP BY doc_id, k, side),
packed(doc_id, k, side, step, base, last) AS (
  SELECT doc_id, k, side, 0, CAST(0 AS BIGINT), len(list_filter(p, lambda x: x <= 1500)) FROM runs
  UNION ALL SELECT doc_id, k, side, step + 1, base, len(list_filter(p, lambda x: x <= base + 1500)) FROM (
    SELECT r.doc_id, r.k, r.side, c.step, r.p, CASE WHEN room >= r.p[c.last] THEN 0 ELSE list_min(list_filter(r.p, lambda x: x >= r.p[c.last] - room)) END AS base
    FROM (SELECT w.*, least(300, 1500 - (q.p[w.last + 1] - q.p[w.last])) AS room FROM packed w JOIN runs q USING (doc_id, k, side) WHERE w.last < len(q.p)) c
    JOIN runs r USING (doc_id, k, side))),
rec_texts AS (SELECT c.doc_id, c.k, c.side, c.step, {strip_sql("substr(r.txt, c.base + 1, r.p[c.last] - c.base)")} AS chunk FROM packed c JOIN runs r USING (doc_id, k, side)),
rec_chunks AS (SELECT d.source AS namespace, concat(doc_id, '#', ord) AS chunk_id, doc_id, ord, chunk AS page_content FROM (
  SELECT doc_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY k, side, step) - 1 AS ord FROM rec_texts WHERE chunk <> '') JOIN documents d USING (doc_id))"""


SPLIT_CHUNKS = f"{CHUNKS_RECURSIVE}, chunks AS (SELECT * FROM rec_chunks)"


def vectors_sql(name: str, relation: str, key: str, text: str) -> str:
    """CTEs ending in ``name(id, v)``: word hashing into 64 buckets, unit length, as floats."""
    return f"""{name}_src AS (SELECT {key} AS id, {text} AS t FROM {relation}),
{name}_cnt AS (SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS b, count(*) AS c
  FROM (SELECT id, unnest(string_split_regex(lower(t), '[ \\t\\r\\n]+')) AS w FROM {name}_src) WHERE w <> '' GROUP BY ALL),
{name}_len AS (SELECT id, sqrt(sum(c * c)) AS n FROM {name}_cnt GROUP BY id),
{name} AS (SELECT s.id, CAST(list(CAST(coalesce(c / n, 0) AS FLOAT) ORDER BY g.b) AS DOUBLE[64]) AS v
  FROM {name}_src s CROSS JOIN (SELECT unnest(range(64)) AS b) g
  LEFT JOIN {name}_cnt c ON c.id = s.id AND c.b = g.b LEFT JOIN {name}_len l ON l.id = s.id GROUP BY s.id)"""


def d2_sql(a: str, b: str) -> str:
    return f"pow(array_distance({a}, {b}), 2)"


def hits_sql(name: str, queries: str, index: str, k: int) -> str:
    """CTEs ending in ``name(qid, chunk_id, d2, rank)`` from two ``(id, v)`` relations."""
    return f"""{name} AS (SELECT * FROM (
  SELECT qid, chunk_id, d2, row_number() OVER (PARTITION BY qid ORDER BY round(d2, 9), chunk_id) AS rank
  FROM (SELECT q.id AS qid, x.id AS chunk_id, {d2_sql('q.v', 'x.v')} AS d2 FROM {queries} q CROSS JOIN {index} x))
  WHERE rank <= {k})"""


def overlap_sql(a: str, b: str) -> str:
    """Cosine of two lists of distinct words."""
    return (f"CASE WHEN len({a}) * len({b}) > 0 THEN len(list_intersect({a}, {b})) / sqrt(CAST(len({a}) * len({b}) AS DOUBLE)) "
            "ELSE 0.0 END")


def elements_sql(marks: bool) -> str:
    """CTEs ending in ``elements(page_id, url, ord, category, text)`` for the kinds of tags stored pages have.

    ``marks`` writes headings, list items and links in plain-text notation.
    """
    link = r"regexp_replace(x, '(?is)<a\s+href=\"([^\"]*)\"[^>]*>(.*?)</a>', '[\2](\1)', 'g')" if marks else "x"
    text = ("CASE category WHEN 'Title' THEN '# ' WHEN 'ListItem' THEN '  * ' ELSE '' END || t" if marks else "t")
    return rf"""visible AS (SELECT page_id, url, regexp_replace(html, '(?is)<head.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->|<!doctype[^>]*>', '', 'g') AS x FROM pages),
marked AS (SELECT page_id, url, regexp_replace(regexp_replace({link}, '(?i)<h1>', chr(1) || 'H', 'g'), '(?i)<li>', chr(1) || 'L', 'g') AS x FROM visible),
cut AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(x, '(?i)</?(p|div|article|nav|footer|ul|li|h1|body)(\s[^>]*)?>', chr(1) || 'N', 'g'),
  '(?i)<br>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM marked),
plain AS (SELECT page_id, url, replace(replace(replace(regexp_replace(x, '&amp;?', '&', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"') AS x FROM cut),
pieces AS (SELECT page_id, url, unnest(range(0, len(string_split(x, chr(1))))) AS pos, unnest(string_split(x, chr(1))) AS piece FROM plain),
trimmed AS (SELECT page_id, url, pos, CASE piece[1] WHEN 'H' THEN 'Title' WHEN 'L' THEN 'ListItem' ELSE 'NarrativeText' END AS category,
  trim(regexp_replace(CASE WHEN pos = 0 THEN piece ELSE piece[2:] END, '[ \t\r\n\f]+', ' ', 'g')) AS t FROM pieces),
elements AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS ord, category, {text} AS text FROM trimmed WHERE t <> '')"""


def page_text_sql() -> str:
    """CTEs ending in ``texts(page_id, url, text)``: pages as plain text with marks."""
    return rf"""{elements_sql(True)},
joined AS (SELECT *, CASE WHEN ord = 0 THEN '' WHEN category = 'ListItem' AND lag(category) OVER (PARTITION BY page_id ORDER BY ord) = 'ListItem' THEN chr(10)
  ELSE chr(10) || chr(10) END AS gap FROM elements),
texts AS (SELECT page_id, url, replace(string_agg(gap || text, '' ORDER BY ord), '\', '') AS text FROM joined GROUP BY page_id, url)"""
