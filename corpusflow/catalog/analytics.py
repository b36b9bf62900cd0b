"""Queries over logs, changes, issues, checks and graphs."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusflow.catalog.base import SPLIT_CHUNKS, Tables, elements_sql, query
from corpusflow.operators import changes as ch, checks as ck, graph as gr, issues as iss, logs as lg
from corpusflow.operators.index import build_index, read_index
from corpusflow.operators.ordering import number_rows
from corpusflow.plans.retrieve import document_chunks
from corpusflow.session import materialized, scratch_path
from corpusflow.streaming.job_rollup import stream_job_summary
from corpusflow.streaming.polling import read_table_stream

c = F.col


# --- logs: one user's events are one job's lines ---------------------------------------------

def _lines(t: Tables) -> DataFrame:
    """Numbered once into a table that everything about the logs is worked out from."""
    events = t("events").select(c("user_id").alias("job"), "ts", "event_id", "event_type")
    line = F.concat("event_type", F.lit(" "), c("event_id").cast("string"))
    return materialized(number_rows(events, ["job"], ["ts", "event_id"], "n").select("job", "n", line.alias("line"), "ts"), "lines")


def _jobs(lines: DataFrame) -> DataFrame:
    """A job failed when its first line is an error; its day is its pipeline."""
    status = F.when(c("line").startswith("error "), "failed").otherwise("success")
    return lines.where("n = 0").select("job", status.alias("status"), F.date_format("ts", "yyyy-MM-dd").alias("pipeline"))


_LINES = """lines AS (SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n,
  event_type || ' ' || event_id AS line, event_type, ts FROM events),
jobs AS (SELECT job, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, strftime(ts, '%Y-%m-%d') AS pipeline FROM lines WHERE n = 0)"""
_WINDOWS = """picks(job, line_no) AS (
  SELECT job, min(n) FROM lines WHERE event_type = 'error' GROUP BY job
  UNION ALL SELECT p.job, (SELECT min(l.n) FROM lines l WHERE l.job = p.job AND l.event_type = 'error' AND l.n >= p.line_no + 5) AS nxt
  FROM picks p WHERE EXISTS (SELECT 1 FROM lines l WHERE l.job = p.job AND l.event_type = 'error' AND l.n >= p.line_no + 5)),
windows AS (SELECT p.job, p.line_no, string_agg(l.line, chr(10) ORDER BY l.n) AS context FROM picks p JOIN lines l ON l.job = p.job AND l.n BETWEEN p.line_no - 5 AND p.line_no + 4 GROUP BY p.job, p.line_no)"""
_TAILS = "tails AS (SELECT job, string_agg(line, chr(10) ORDER BY n) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY n DESC) AS b FROM lines) WHERE b <= 30 GROUP BY job)"


@query("w4_log_section", f"""
WITH {_LINES}, marked AS (SELECT *, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' END AS mark FROM lines),
state AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY job ORDER BY n ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT job, n, line FROM state WHERE s = 'start' AND mark IS NULL""")
def _(t: Tables) -> DataFrame:
    mark = F.when(c("line").startswith("signup "), "start").when(c("line").startswith("purchase "), "end")
    return lg.log_section(_lines(t).drop("ts"), mark)


@query("w5_log_tail", f"WITH {_LINES}, {_TAILS} SELECT job, tail FROM tails JOIN jobs USING (job) WHERE status = 'failed'")
def _(t: Tables) -> DataFrame:
    lines = _lines(t)
    failed = _jobs(lines).where("status = 'failed'").select("job")
    return lg.log_tail(lines.join(failed, "job", "left_semi"))


@query("w6_log_context", f"WITH RECURSIVE {_LINES}, {_WINDOWS} SELECT job, line_no, context FROM windows")
def _(t: Tables) -> DataFrame:
    return lg.log_context(_lines(t), c("line").startswith("error "))


_LOG_SQL = """raw AS (SELECT doc_id AS job, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n,
  unnest(string_split(text, chr(10))) AS line FROM documents),
lines AS (SELECT job, n, replace(line, 'on', 'WARN') AS line FROM raw)"""


def _log_lines(t: Tables) -> DataFrame:
    """Whole logs as text: every document is a log whose script section is its text, in colour, with warnings in it."""
    esc = "\x1b[0K"
    log = F.concat(F.lit(f"{esc}section_start:12:step_script\n"), F.replace("text", F.lit("on"), F.lit("\x1b[33mWARN\x1b[0m")),
                   F.lit(f"\nsection_end:15:step_script{esc}\nUploading WARN on\n"))
    lines = lg.job_lines(t("documents").select(c("doc_id").alias("job"), log.alias("log")))
    return lg.log_section(lines, lg.section_marks(c("line")))


@query("w4_log_text", f"WITH {_LOG_SQL} SELECT job, n, line FROM lines")
def _(t: Tables) -> DataFrame:
    """From the text of a log to the lines of its script section."""
    return _log_lines(t)


@query("w6_log_text_warnings", f"""
WITH RECURSIVE {_LOG_SQL}, picks(job, line_no) AS (
  SELECT job, min(n) FROM lines WHERE contains(line, 'WARN') GROUP BY job
  UNION ALL SELECT p.job, (SELECT min(l.n) FROM lines l WHERE l.job = p.job AND contains(l.line, 'WARN') AND l.n >= p.line_no + 5) AS nxt
  FROM picks p WHERE EXISTS (SELECT 1 FROM lines l WHERE l.job = p.job AND contains(l.line, 'WARN') AND l.n >= p.line_no + 5))
SELECT p.job, p.line_no, string_agg(l.line, chr(10) ORDER BY l.n) AS context FROM picks p JOIN lines l ON l.job = p.job AND l.n BETWEEN p.line_no - 5 AND p.line_no + 4
GROUP BY p.job, p.line_no""")
def _(t: Tables) -> DataFrame:
    """From the text of a log to its warnings in context."""
    return lg.log_context(materialized(_log_lines(t), "log"), lg.warning_line(c("line")))


_SUMMARY = f"""{_LINES}, {_WINDOWS}, {_TAILS},
warned AS (SELECT job, count(*) AS k, string_agg(context, '|' ORDER BY line_no) FILTER (WHERE r <= 5) AS sample
  FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY line_no) AS r FROM windows) GROUP BY job),
summary AS (SELECT j.job, j.pipeline, j.status, CASE WHEN status = 'failed' THEN 0 ELSE coalesce(k, 0) END AS warnings_count,
  CAST(CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS BIGINT) AS errors_count, CASE WHEN status <> 'failed' THEN sample END AS warnings_sample,
  CASE WHEN status = 'failed' THEN tail END AS errors_sample FROM jobs j LEFT JOIN warned USING (job) LEFT JOIN tails USING (job))"""


def _summary(t: Tables) -> DataFrame:
    lines = _lines(t)
    return materialized(lg.job_summary(_jobs(lines), lines.drop("ts"), c("line").startswith("error ")), "summary")


@query("a4_job_summary", f"WITH RECURSIVE {_SUMMARY} SELECT job, status, warnings_count, errors_count, warnings_sample, errors_sample FROM summary")
def _(t: Tables) -> DataFrame:
    return _summary(t).select("job", "status", "warnings_count", "errors_count",
                              F.array_join("warnings_sample", "|").alias("warnings_sample"), F.array_join("errors_sample", "|").alias("errors_sample"))


@query("st5_stream_job_summary", f"WITH RECURSIVE {_SUMMARY} SELECT job, status, warnings_count, errors_count, warnings_sample, errors_sample FROM summary")
def _(t: Tables) -> DataFrame:
    """The roll-up on arriving lines: six files, one a batch, each with lines from all over every log."""
    lines = _lines(t)
    path = scratch_path(t.spark, "arriving")
    lines.select("job", "n", "line").repartition(6, F.xxhash64("job", "n")).sortWithinPartitions(c("n").desc()).write.parquet(path)
    stream = read_table_stream(t.spark, path, "*.parquet", files_per_batch=1)
    return stream_job_summary(stream, _jobs(lines), c("line").startswith("error ")).select(
        "job", "status", "warnings_count", "errors_count", F.array_join("warnings_sample", "|").alias("warnings_sample"),
        F.array_join("errors_sample", "|").alias("errors_sample"))


@query("a5_pipeline_summary", f"""
WITH RECURSIVE {_SUMMARY} SELECT pipeline, 0 AS section, NULL::BIGINT AS ord,
  '{{"total_jobs":' || count(*) || ',"total_warnings":' || sum(warnings_count) || ',"total_errors":' || sum(errors_count) || '}}' AS text FROM summary GROUP BY pipeline
UNION ALL SELECT pipeline, 1, job, '{{"job":' || job || ',"status":"' || status || '","warnings_count":' || warnings_count || ',"errors_count":' || errors_count
  || coalesce(',"warnings_sample":["' || replace(replace(warnings_sample, chr(10), '\\n'), '|', '","') || '"]', '')
  || coalesce(',"errors_sample":["' || replace(errors_sample, chr(10), '\\n') || '"]', '') || '}}' FROM summary""")
def _(t: Tables) -> DataFrame:
    return lg.pipeline_report(_summary(t), ["pipeline"], cols=["status", "warnings_count", "errors_count", "warnings_sample", "errors_sample"])


# --- review requests ---------------------------------------------------------------------------

_DIFF = "'+' || replace(text, chr(10), chr(10) || '-')"


def _changes(t: Tables) -> DataFrame:
    """A document is a changed file, its source the request."""
    diff = F.concat(F.lit("+"), F.replace("text", F.lit("\n"), F.lit("\n-")))
    return ch.with_line_counts(t("documents").select(
        c("source").alias("mr"), c("doc_id").alias("ord"), F.concat("lang", F.lit("/"), c("doc_id").cast("string")).alias("new_path"),
        (c("lang") == "de").alias("new_file"), (c("lang") == "es").alias("renamed_file"), (c("lang") == "fr").alias("deleted_file"),
        (c("n_chars") > 2000).alias("generated_file"), diff.alias("diff")))


_CHANGES = rf"""changes AS (SELECT source AS mr, doc_id AS ord, lang || '/' || doc_id AS new_path, lang, n_chars, diff,
  len(regexp_extract_all(diff, '(?m)^\+[^+]')) AS lines_added, len(regexp_extract_all(diff, '(?m)^-(?:[^-]|$)')) AS lines_removed
  FROM (SELECT *, {_DIFF} AS diff FROM documents)),
stats AS (SELECT mr, count(*) AS total_files_changed, CAST(sum(lines_added) AS BIGINT) AS total_lines_added, CAST(sum(lines_removed) AS BIGINT) AS total_lines_removed FROM changes GROUP BY mr)"""


@query("a6_mr_stats", f"WITH {_CHANGES} SELECT * FROM stats")
def _(t: Tables) -> DataFrame:
    return ch.mr_stats(_changes(t))


_MR_HEAD = """'Merge Request Details:
Title: Work on ' || mr || '
Author: Name ' || mr || ' (' || mr || ')
State: opened
Created At: 2024-01-01
Updated At: None
Source Branch: dev
Target Branch: main
Labels: ' || labels || '
Pipeline Status: None
Approvals Required: 2
Approvals Received: ' || langs || '
Web URL: https://git.example/' || mr || '
Merge Status: mergeable
First Contribution: false
Assignees:
' || CASE WHEN toxic > 0 THEN '- Ann ' || mr || ' (ann)
- Bo (bo)' ELSE 'None' END || '

Changes:'"""


@query("a7_mr_report", f"""
WITH {_CHANGES}, mrs AS (SELECT source AS mr, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS labels, count(DISTINCT lang) AS langs, count_if(toxic = 1) AS toxic
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source),
pieces AS (SELECT mr, 0 AS s, NULL AS ord, {_MR_HEAD} AS x FROM mrs
 UNION ALL SELECT mr, 1, ord, 'File: ' || new_path || chr(10) || '  - Lines Added: ' || lines_added || chr(10) || '  - Lines Removed: ' || lines_removed || chr(10)
  || '  - Change Type: ' || CASE lang WHEN 'de' THEN 'New File' WHEN 'es' THEN 'Renamed File' WHEN 'fr' THEN 'Deleted File' ELSE 'Modified' END || chr(10)
  || '  - Generated File: ' || CASE WHEN n_chars > 2000 THEN 'Yes' ELSE 'No' END || chr(10) || '  - Diff:' || chr(10) || diff || chr(10) FROM changes
 UNION ALL SELECT mr, 2, NULL, 'Statistics:' || chr(10) || 'Total Files Changed: ' || total_files_changed || chr(10) || 'Total Lines Added: ' || total_lines_added
  || chr(10) || 'Total Lines Removed: ' || total_lines_removed FROM stats)
SELECT mr, s AS section, ord, x AS text FROM pieces""")
def _(t: Tables) -> DataFrame:
    seen = t("documents").join(t("labels"), "doc_id", "left").groupBy(c("source").alias("mr")).agg(
        F.array_sort(F.collect_set("lang")).alias("labels"), F.count_if(c("toxic") == 1).alias("toxic"))

    def person(name, user):
        return F.struct(name.alias("name"), F.lit(user).alias("username"))
    team = F.array(person(F.concat(F.lit("Ann "), "mr"), "ann"), person(F.lit("Bo"), "bo"))
    mrs = seen.select(
        "mr", "labels", F.concat(F.lit("Work on "), "mr").alias("title"), F.concat(F.lit("Name "), "mr").alias("author_name"),
        c("mr").alias("author_username"), F.lit("opened").alias("state"), F.lit("2024-01-01").alias("created_at"),
        F.lit(None).cast("string").alias("updated_at"), F.lit("dev").alias("source_branch"), F.lit("main").alias("target_branch"),
        F.lit(None).cast("string").alias("pipeline_status"), F.lit(2).alias("approvals_required"), c("labels").alias("approved_by"),
        F.concat(F.lit("https://git.example/"), "mr").alias("web_url"), F.lit("mergeable").alias("merge_status"),
        F.lit(False).alias("first_contribution"), F.when(c("toxic") > 0, team).otherwise(F.array().cast(
            "array<struct<name:string,username:string>>")).alias("assignees"))
    return ch.mr_report(mrs, _changes(t))


@query("a8_mr_comments", """
SELECT conv_id AS mr, CAST(turn AS VARCHAR) AS id, text AS body, role AS author, CAST(conv_id AS VARCHAR) AS created_at, NULL::VARCHAR AS updated_at FROM conversations""")
def _(t: Tables) -> DataFrame:
    note = F.to_json(F.struct(c("turn").alias("id"), c("text").alias("body"), F.struct(c("role").alias("username")).alias("author"),
                              c("conv_id").cast("string").alias("created_at")))
    return ch.mr_comments(t("conversations").select(c("conv_id").alias("mr"), note.alias("note")))


# --- issues: regions, nations and suppliers as a tree, customers as comments --------------------

def _issues(t: Tables) -> DataFrame:
    nation = t("nation")
    none = F.lit(None).cast("string")

    def rows(df, key, parent, kind, text):
        return df.select(key.alias("key"), parent.alias("parent"), F.lit(kind).alias("issuetype"), F.concat(F.lit("About "), key).alias("summary"),
                         F.lit("To Do").alias("status"), text.alias("description"), F.lit("Ann").alias("reporter"), none.alias("assignee"))
    regions = t("region").withColumnRenamed("r_regionkey", "n_regionkey")
    suppliers = t("supplier").withColumnRenamed("s_nationkey", "n_nationkey").join(nation, "n_nationkey")
    return (rows(t("region"), c("r_name"), none, "Epic", none)
            .unionByName(rows(nation.join(regions, "n_regionkey"), c("n_name"), c("r_name"), "Story", c("r_name")))
            .unionByName(rows(suppliers, c("s_name"), c("n_name"), "Task", none)))


def _comments(t: Tables) -> DataFrame:
    customers = t("customer").withColumnRenamed("c_nationkey", "n_nationkey").join(t("nation"), "n_nationkey")
    return customers.select(c("n_name").alias("key"), c("c_custkey").alias("ord"), c("c_name").alias("author"), c("c_mktsegment").alias("body"))


_ISSUES = """issues AS (SELECT r_name AS key, NULL AS parent, 'Epic' AS issuetype, NULL AS description FROM region
  UNION ALL SELECT n_name, r_name, 'Story', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT s_name, n_name, 'Task', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey),
parented AS (SELECT i.*, coalesce(p.key || ': About ' || p.key, 'No parent issue') AS parent_text FROM issues i LEFT JOIN issues p ON p.key = i.parent AND p.issuetype <> 'Epic'),
talk AS (SELECT n_name AS key, c_custkey AS ord, c_name || ': ' || c_mktsegment AS comment FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query("j8_with_parent", f"WITH {_ISSUES} SELECT key, parent_text FROM parented")
def _(t: Tables) -> DataFrame:
    return iss.with_parent(_issues(t)).select("key", "parent_text")


@query("j9_with_comments", f"WITH {_ISSUES} SELECT key, ord, coalesce(comment, 'None') AS comment FROM issues LEFT JOIN talk USING (key)")
def _(t: Tables) -> DataFrame:
    return iss.with_comments(_issues(t), _comments(t)).select("key", "ord", "comment")


@query("a9_issue_report", f"""
WITH {_ISSUES} SELECT key, 0 AS section, NULL::BIGINT AS ord, chr(10) || '**Title**: About ' || key || chr(10) || '**Key**: ' || key || chr(10) || '**Status**: To Do' || chr(10)
 || '**Description**: ' || coalesce(description, 'None') || chr(10) || '**Reporter**: Ann' || chr(10) || '**Assignee**: None' || chr(10) || '**Comments**: ' AS text FROM issues
UNION ALL SELECT key, 1, ord, coalesce(comment, 'None') FROM issues LEFT JOIN talk USING (key)
UNION ALL SELECT key, 2, NULL, '**Parent Issue Summary**: ' || chr(10) || parent_text || chr(10) FROM parented""")
def _(t: Tables) -> DataFrame:
    return iss.issue_report(_issues(t), _comments(t))


# --- checks ---------------------------------------------------------------------------------------

@query("v1_check_unique", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return ck.check_unique(t("documents"), ["text"])


@query("v2_check_fk", """
SELECT o_orderkey, 'missing' AS violation FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT o_orderkey, 'forbidden' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def _(t: Tables) -> DataFrame:
    agents = t("customer").withColumnRenamed("c_custkey", "o_custkey")
    tasks = t("orders").select("o_orderkey", "o_custkey")
    return ck.check_fk(tasks, agents.where("c_acctbal > 0"), ["o_custkey"], agents.where("c_mktsegment = 'MACHINERY'")).select("o_orderkey", "violation")


@query("v3_check_first_contains", """
SELECT conv_id, text AS first_text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r = 1 AND NOT contains(text, 'the')""")
def _(t: Tables) -> DataFrame:
    return ck.check_first_contains(t("conversations"), "conv_id", "turn", "text", "the")


@query("v4_check_min_count", """
SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 8""")
def _(t: Tables) -> DataFrame:
    return ck.check_min_count(t("customer"), t("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", 8)


@query("v5_check_predicates", """
SELECT 'retail_positive' AS rule, count_if(NOT coalesce(p_retailprice > 0, false))::BIGINT AS violations FROM part
UNION ALL SELECT 'size_over_five', count_if(NOT coalesce(p_size > 5, false))::BIGINT FROM part
UNION ALL SELECT 'type_required', count_if(p_type IS NULL OR p_type = '')::BIGINT FROM part
UNION ALL SELECT 'red_has_type', count_if((CASE WHEN p_name LIKE 'red%' THEN p_name END IS NULL) <> (p_type IS NULL))::BIGINT FROM part""")
def _(t: Tables) -> DataFrame:
    part = t("part").withColumn("red", F.when(c("p_name").startswith("red"), c("p_name")))
    return ck.check_predicates(part, {
        "retail_positive": ck.positive("p_retailprice"), "size_over_five": c("p_size") > 5, "type_required": ck.required("p_type"),
        "red_has_type": ck.both_or_neither("red", "p_type")})


@query("v6_check_domain", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'error') GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    return ck.check_domain(t("events"), "event_type", ["click", "view", "error"])


# --- graphs ---------------------------------------------------------------------------------------

@query("g1_expand_groups", """
SELECT r_name AS root, s_name AS project FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey
UNION ALL SELECT n_name, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey""")
def _(t: Tables) -> DataFrame:
    nations = t("nation").join(t("region"), c("n_regionkey") == c("r_regionkey"))
    groups = t("region").select(c("r_name").alias("group")).unionByName(t("nation").select(c("n_name").alias("group")))
    projects = t("supplier").join(t("nation"), c("s_nationkey") == c("n_nationkey"))
    return gr.expand_groups(groups, nations.select(c("r_name").alias("parent"), c("n_name").alias("group")),
                            projects.select(c("n_name").alias("group"), c("s_name").alias("project")))


def _shop_links(t: Tables) -> DataFrame:
    """A site of all regions, nations, suppliers and parts, with links off the site as well."""
    def page(kind, key):
        return F.concat(F.lit(f"https://shop.example/{kind}/"), c(key).cast("string"))
    sold = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    links = [
        t("region").select(F.lit("https://shop.example").alias("src"), page("region", "r_regionkey").alias("dst")),
        t("nation").select(page("region", "n_regionkey"), page("nation", "n_nationkey")),
        t("supplier").select(page("nation", "s_nationkey"), page("supplier", "s_suppkey")),
        t("customer").select(page("nation", "c_nationkey"), F.concat(F.lit("https://other.example/customer/"), c("c_custkey").cast("string"))),
        sold.select(page("supplier", "l_suppkey"), page("part", "l_partkey")),
        sold.select(page("part", "l_partkey"), page("supplier", "l_suppkey")),
    ]
    out = links[0]
    for more in links[1:]:
        out = out.unionAll(more)
    return out


_SHOP = """edges AS (SELECT 'https://shop.example' AS src, 'https://shop.example/region/' || r_regionkey AS dst FROM region
 UNION SELECT 'https://shop.example/region/' || n_regionkey, 'https://shop.example/nation/' || n_nationkey FROM nation
 UNION SELECT 'https://shop.example/nation/' || s_nationkey, 'https://shop.example/supplier/' || s_suppkey FROM supplier
 UNION SELECT 'https://shop.example/nation/' || c_nationkey, 'https://other.example/customer/' || c_custkey FROM customer
 UNION SELECT 'https://shop.example/supplier/' || l_suppkey, 'https://shop.example/part/' || l_partkey FROM lineitem
 UNION SELECT 'https://shop.example/part/' || l_partkey, 'https://shop.example/supplier/' || l_suppkey FROM lineitem)"""


@query("g2_crawl_closure", f"""
WITH RECURSIVE {_SHOP}, walk(url, depth) AS (SELECT 'https://shop.example', 0
  UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.url WHERE w.depth <= 10 AND starts_with(e.dst, 'https://shop.example'))
SELECT 'https://shop.example/' AS seed, url, min(depth) AS depth FROM walk GROUP BY url""")
def _(t: Tables) -> DataFrame:
    seeds = t("region").select(F.lit("https://shop.example/").alias("seed")).distinct()
    return gr.crawl_closure(_shop_links(t), seeds)


@query("g2_crawl_pages", r"""
WITH RECURSIVE links AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>', '', 'g'), '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages),
sites AS (SELECT DISTINCT regexp_extract(url, '^([^/]*//[^/?#]*)', 1) AS site FROM pages),
-- the site's root links to its stored pages; those link on by path
edges AS (SELECT regexp_extract(url, '^([^/]*//[^/?#]*)', 1) AS src, regexp_replace(url, '#.*', '') AS dst FROM pages
  UNION SELECT regexp_replace(url, '#.*', ''), regexp_replace(regexp_extract(url, '^([^/]*//[^/?#]*)', 1) || href, '#.*', '') FROM links
  WHERE NOT regexp_matches(href, '^(mailto:|javascript:|#)') AND NOT regexp_matches(href, '\.(png|svg|jpg|jpeg|gif)$')),
walk(seed, url, depth) AS (SELECT site, site, 0 FROM sites
  UNION SELECT w.seed, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.url WHERE w.depth <= 10 AND starts_with(e.dst, w.seed))
SELECT seed, url, min(depth) AS depth FROM walk GROUP BY seed, url""")
def _(t: Tables) -> DataFrame:
    from corpusflow.functions.urls import clean_url
    pages = t("pages").select(F.regexp_extract("url", "^([^/]*//[^/?#]*)", 1).alias("site"), clean_url(c("url")).alias("url"), "html")
    edges = pages.select(c("site").alias("src"), c("url").alias("dst")).unionAll(gr.link_edges(pages))
    return gr.crawl_closure(edges, pages.select(c("site").alias("seed")).distinct())


_CRAWLED = r"""links AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>', '', 'g'), '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages),
sites AS (SELECT DISTINCT regexp_extract(url, '^([^/]*//[^/?#]*)', 1) AS site FROM pages),
edges AS (SELECT regexp_extract(url, '^([^/]*//[^/?#]*)', 1) AS src, regexp_replace(url, '#.*', '') AS dst FROM pages
  UNION SELECT regexp_replace(url, '#.*', ''), regexp_replace(regexp_extract(url, '^([^/]*//[^/?#]*)', 1) || href, '#.*', '') FROM links
  WHERE NOT regexp_matches(href, '^(mailto:|javascript:|#)') AND NOT regexp_matches(href, '\.(png|svg|jpg|jpeg|gif)$')),
walk(seed, url, depth) AS (SELECT site, site, 0 FROM sites
  UNION SELECT w.seed, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.url WHERE w.depth <= 10 AND starts_with(e.dst, w.seed))"""


@query("g2_crawl_index", f"""
WITH RECURSIVE {_CRAWLED}, {elements_sql(False)},
page_docs AS (SELECT regexp_replace(any_value(url), '#.*', '') AS url, string_agg(text, chr(10) ORDER BY ord) AS text FROM elements
  WHERE page_id IN (SELECT min_by(page_id, html) FROM pages GROUP BY regexp_replace(url, '#.*', '')) GROUP BY page_id),
documents AS (SELECT w.seed || '|' || d.url AS doc_id, d.text, w.seed AS source FROM (SELECT DISTINCT seed, url FROM walk) w JOIN page_docs d ON d.url = w.url),
{SPLIT_CHUNKS} SELECT namespace AS seed, count(DISTINCT page_content) AS chunks FROM chunks GROUP BY namespace""")
def _(t: Tables) -> DataFrame:
    """From a crawl to documents to an index, one namespace per site; what the index holds of each."""
    from corpusflow.functions.urls import clean_url
    pages = t("pages").select(F.regexp_extract("url", "^([^/]*//[^/?#]*)", 1).alias("site"), clean_url(c("url")).alias("url"), "html")
    edges = pages.select(c("site").alias("src"), c("url").alias("dst")).unionAll(gr.link_edges(pages))
    docs = gr.crawl_documents(pages, edges, pages.select(c("site").alias("seed")).distinct())
    path = scratch_path(t.spark, "crawled")
    text = F.replace("page_content", F.lit("\n\n"), F.lit("\n"))
    build_index(t.spark, path, document_chunks(docs.select(F.concat_ws("|", "seed", "url").alias("doc_id"), text.alias("text"), c("seed").alias("source"))))
    return read_index(t.spark, path).groupBy(c("namespace").alias("seed")).agg(F.count("*").alias("chunks"))
