"""Queries over incremental upkeep of the index, memory tables and streams."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusflow.catalog.base import SPLIT_CHUNKS, Tables, hits_sql, query, vectors_sql
from corpusflow.functions.text import memory_namespace, source_hash
from corpusflow.operators import index as ix, search as se
from corpusflow.plans.ingest import refresh
from corpusflow.plans.retrieve import document_chunks, embedded_queries
from corpusflow.session import materialized, scratch_path
from corpusflow.sources import documents as sd
from corpusflow.streaming import polling as po

c = F.col


def _yesterday_today(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two runs over the documents: first without the Spanish ones, then without the German."""
    docs = t.spread("documents", "doc_id")
    return document_chunks(docs.where("lang <> 'es'")), document_chunks(docs.where("lang <> 'de'"))


def _covered(t: Tables) -> DataFrame:
    """The namespaces of a run, known from the documents before they are cut up."""
    return t("documents").select(c("source").alias("namespace")).distinct()


# content and metadata (the source) are what identifies a chunk
_RUNS = f"""{SPLIT_CHUNKS}, tagged AS (SELECT c.*, d.lang FROM chunks c JOIN documents d USING (doc_id)),
old AS (SELECT DISTINCT namespace, page_content FROM tagged WHERE lang <> 'es'),
new AS (SELECT DISTINCT namespace, page_content FROM tagged WHERE lang <> 'de'),
plan AS (SELECT namespace, page_content, CASE WHEN o.page_content IS NULL THEN 'add' WHEN n.page_content IS NULL THEN 'delete' ELSE 'skip' END AS action
  FROM (SELECT DISTINCT * FROM (SELECT * FROM old UNION ALL SELECT * FROM new)) k
  LEFT JOIN old o USING (namespace, page_content) LEFT JOIN new n USING (namespace, page_content))"""


def _with_text(plan: DataFrame, *chunks: DataFrame) -> DataFrame:
    """The text behind the keys of a plan."""
    known = chunks[0]
    for more in chunks[1:]:
        known = known.unionByName(more)
    known = known.select("namespace", "key", "page_content").dropDuplicates(["namespace", "key"])
    return plan.join(known, ["namespace", "key"]).drop("key")


@query("j2_plan_upsert", f"WITH RECURSIVE {_RUNS} SELECT namespace, page_content, action FROM plan")
def _(t: Tables) -> DataFrame:
    old, new = (ix.fingerprint(x) for x in _yesterday_today(t))
    return _with_text(ix.plan_upsert(new, old, namespaces=_covered(t)), old, new)


@query("j3_plan_deletes", f"WITH RECURSIVE {_RUNS} SELECT namespace, page_content FROM plan WHERE action = 'delete'")
def _(t: Tables) -> DataFrame:
    old, new = (ix.fingerprint(x) for x in _yesterday_today(t))
    return _with_text(ix.plan_deletes(old, new, namespaces=_covered(t)), old)


@query("a10_upsert_counts", f"""
WITH RECURSIVE {_RUNS} SELECT namespace, count_if(action = 'add')::BIGINT AS added, 0::BIGINT AS updated, count_if(action = 'skip')::BIGINT AS skipped, count_if(action = 'delete')::BIGINT AS deleted
FROM plan GROUP BY namespace""")
def _(t: Tables) -> DataFrame:
    old, new = (ix.fingerprint(x) for x in _yesterday_today(t))
    return ix.upsert_counts(ix.plan_upsert(new, old, namespaces=_covered(t)))


@query("a13_distinct_documents", "SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY text, lang")
def _(t: Tables) -> DataFrame:
    docs = t("documents").withColumn("metadata", F.create_map(F.lit("lang"), "lang"))
    return ix.distinct_documents(ix.fingerprint(docs, "text").select("doc_id", "lang", "key"), ["key"], ["doc_id"]).drop("key")


def _sites(t: Tables) -> DataFrame:
    """Page addresses as chunks without metadata, one namespace per site, whose name is an address as well."""
    site = F.regexp_extract("url", "^([^/]*//[^/?#]*)", 1)
    return t("pages").select(site.alias("namespace"), F.concat(F.lit("p"), "page_id").alias("chunk_id"), c("page_id").cast("string").alias("doc_id"),
                             F.lit(0).alias("ord"), c("url").alias("page_content"), F.lit(None).cast("map<string,string>").alias("metadata"))


_SITES = "sites AS (SELECT regexp_extract(url, '^([^/]*//[^/?#]*)', 1) AS namespace, count(DISTINCT url) AS n FROM pages GROUP BY ALL)"


@query("i1_build_index", f"""
WITH RECURSIVE {_RUNS}, {_SITES}
SELECT 1 AS run, namespace, count(*) AS added, 0::BIGINT AS updated, 0::BIGINT AS skipped, 0::BIGINT AS deleted FROM old GROUP BY namespace
UNION ALL SELECT 1, namespace, n, 0, 0, 0 FROM sites
UNION ALL SELECT 2, namespace, count_if(action = 'add')::BIGINT, 0, count_if(action = 'skip')::BIGINT, count_if(action = 'delete')::BIGINT FROM plan GROUP BY namespace
UNION ALL SELECT 2, namespace, 0, 0, 0, n FROM sites
UNION ALL SELECT 3, namespace, 0, 0, count(*), 0 FROM new GROUP BY namespace
UNION ALL SELECT 4, namespace, count(*), 0, 0, 0 FROM new GROUP BY namespace""")
def _(t: Tables) -> DataFrame:
    """First build, a changed corpus without its sites, the same corpus again; run 4 is what the index then holds."""
    path = scratch_path(t.spark, "index")
    old, new = _yesterday_today(t)
    sites = _sites(t)
    covered = _covered(t).unionByName(sites.select("namespace").distinct())
    runs = [ix.build_index(t.spark, path, chunks, namespaces=covered).withColumn("run", F.lit(i)) for i, chunks in ((1, old.unionByName(sites)), (2, new), (3, new))]
    zero = F.lit(0).cast("bigint")
    held = ix.read_index(t.spark, path).where("size(embedding) = 64").groupBy("namespace").agg(F.count("*").alias("added"))
    runs.append(held.select("namespace", "added", zero.alias("updated"), zero.alias("skipped"), zero.alias("deleted"), F.lit(4).alias("run")))
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out


def _memories(t: Tables) -> DataFrame:
    """Messages as memories of the crew, one table per role."""
    namespace = memory_namespace(F.lit("Crew"), c("role"))
    return t("conversations").select(
        namespace.alias("namespace"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), c("conv_id").cast("string").alias("doc_id"),
        c("turn").cast("int").alias("ord"), c("text").alias("page_content"), F.create_map(F.lit("source"), namespace).alias("metadata"))


_MEMORY = "m AS (SELECT DISTINCT role || '-' || md5('crew') AS namespace, text FROM conversations)"


@query("m1_memory_save", f"""
WITH {_MEMORY} SELECT 1 AS run, namespace, count(*) AS added, 0 AS skipped FROM m GROUP BY namespace
UNION ALL SELECT 2, namespace, 0, count(*) FROM m GROUP BY namespace""")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "memory")
    runs = [ix.memory_save(t.spark, path, _memories(t)).select(F.lit(i).alias("run"), "namespace", "added", "skipped") for i in (1, 2)]
    return runs[0].unionByName(runs[1])


@query("m2_memory_reset", f"""
WITH {_MEMORY}, {_SITES} SELECT 'left' AS state, namespace, count(*) AS n FROM m WHERE namespace NOT LIKE 'system-%' GROUP BY namespace
UNION ALL SELECT 'deleted', namespace, count(*) FROM m WHERE namespace LIKE 'system-%' GROUP BY namespace
UNION ALL SELECT 'deleted', namespace, n FROM sites""")
def _(t: Tables) -> DataFrame:
    """The system's table and those of all sites are emptied."""
    path = scratch_path(t.spark, "memory")
    ix.memory_save(t.spark, path, _memories(t).unionByName(_sites(t)))
    emptied = t("conversations").where("role = 'system'").select(memory_namespace(F.lit("crew"), c("role")).alias("namespace"))
    counts = ix.memory_reset(t.spark, path, emptied.unionByName(_sites(t).select("namespace")).distinct())
    left = ix.read_index(t.spark, path).groupBy("namespace").agg(F.count("*").alias("n"))
    return (left.select(F.lit("left").alias("state"), "namespace", "n")
            .unionByName(counts.select(F.lit("deleted").alias("state"), "namespace", c("deleted").alias("n"))))


@query("q3_memory_search", f"""
WITH said AS (SELECT role || '-' || md5('crew') AS namespace, conv_id || '-' || turn AS chunk_id, text FROM conversations),
kept AS (SELECT min(chunk_id) AS chunk_id, namespace, text FROM said GROUP BY namespace, text),
asked AS (SELECT item_id, text FROM benchmark UNION ALL SELECT -1 - conv_id, text FROM conversations WHERE turn = 0),
{vectors_sql('cv', 'kept', 'chunk_id', 'text')}, {vectors_sql('qv', 'asked', 'item_id', 'text')}, {hits_sql('hits', 'qv', 'cv', 3)}
SELECT qid, text AS context, namespace AS metadata, rank FROM hits JOIN kept USING (chunk_id) WHERE 1 - round(d2, 9) / sqrt(2) >= 0.35
UNION ALL SELECT NULL, namespace, NULL, count(*) FROM kept WHERE namespace NOT LIKE 'user-%' GROUP BY namespace""")
def _(t: Tables) -> DataFrame:
    """Memory as one job: save, search what was saved, reset one table; the rows without a query are what is left."""
    path = scratch_path(t.spark, "memory")
    ix.memory_save(t.spark, path, _memories(t))
    asked = t("benchmark").select(c("item_id").alias("qid"), "text").unionByName(
        t("conversations").where("turn = 0").select((-1 - c("conv_id")).alias("qid"), "text"))
    stored = ix.read_index(t.spark, path)
    hits = se.memory_search(stored, embedded_queries(asked, "qid", "text"))
    found = materialized(hits.join(stored.select("chunk_id", "page_content", "namespace"), "chunk_id").select(
        "qid", c("page_content").alias("context"), c("namespace").alias("metadata"), c("rank").cast("bigint").alias("rank")), "found")
    ix.memory_reset(t.spark, path, t.spark.range(1).select(memory_namespace(F.lit("Crew"), F.lit("user")).alias("namespace")))
    left = ix.read_index(t.spark, path).groupBy("namespace").agg(F.count("*").alias("rank"))
    return found.unionByName(left.select(F.lit(None).cast("bigint").alias("qid"), c("namespace").alias("context"), F.lit(None).cast("string").alias("metadata"), "rank"))


# --- streams ------------------------------------------------------------------------------------------

def _polled(t: Tables, columns: str = "*") -> DataFrame:
    """The events as a stream of several files, the latest events first, one file a batch."""
    path = scratch_path(t.spark, "polled")
    events = t("events").selectExpr(columns)
    events.repartitionByRange(8, c("ts").desc()).sortWithinPartitions(c("ts").desc()).write.parquet(path)
    return po.read_table_stream(t.spark, path, "*.parquet", files_per_batch=1)


@query("st1_track_new", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND user_id % 2 = 0")
def _(t: Tables) -> DataFrame:
    """Every event is polled twice; those of one project, status and assignee pass, once each."""
    def poll():
        issues = _polled(t).select("event_id", "user_id", "event_type", c("ts").alias("created"), (c("user_id") % 2).cast("string").alias("assignee"),
                                   F.when(c("ts").isNotNull(), "open").alias("status"))
        return sd.scan_issues(issues, "error", "open", "0", project_col="event_type").select("event_id", "user_id", "event_type")
    return po.drain_to_table(po.track_new(poll().union(poll()), ["event_id"]), "tracked")


@query("st1_track_new_bounded", "SELECT event_id, user_id FROM events")
def _(t: Tables) -> DataFrame:
    polled, again = (_polled(t).select("event_id", "user_id") for _ in range(2))
    return po.drain_to_table(po.track_new(polled.union(again), ["event_id"], delay="1 hour"), "tracked")


@query("st2_refresh_job", f"""
WITH RECURSIVE {SPLIT_CHUNKS}, n AS (SELECT 'confluence-' || md5(lower(namespace)) || '.source' AS hash, namespace AS source, count(DISTINCT page_content) AS n FROM chunks GROUP BY namespace),
known AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT 'start' AS run, hash, 'confluence: spaces=' || source AS label, n AS added, 0::BIGINT AS skipped, 0::BIGINT AS deleted FROM n WHERE source NOT IN (SELECT source FROM known)
UNION ALL SELECT 'forced', hash, NULL, CASE WHEN source IN (SELECT source FROM known) THEN n ELSE 0 END, CASE WHEN source IN (SELECT source FROM known) THEN 0 ELSE n END, 0 FROM n""")
def _(t: Tables) -> DataFrame:
    """At start the sources without a label are ingested, then all of them by force; a space that holds nothing stays due."""
    path = scratch_path(t.spark, "refreshed")
    docs = t("documents")
    nothing = F.lit(None).cast("array<string>")
    config = docs.groupBy(F.lit("confluence").alias("source_type")).agg(F.array_append(F.sort_array(F.collect_set("source")), F.lit("empty space")).alias("spaces")) \
        .withColumns({"groups": nothing, "projects": nothing, "links": nothing})
    known = docs.join(t("labels").where("toxic = 1"), "doc_id").select(source_hash(F.lit("confluence"), c("source")).alias("hash"), F.lit("known").alias("label"))
    known.distinct().write.parquet(f"{path}/labels")

    def load(due: DataFrame) -> DataFrame:
        meta = F.create_map(F.lit("source"), "source")
        return due.join(docs, c("identifier") == c("source")).select("hash", "doc_id", c("text").alias("page_content"), meta.alias("metadata"))
    runs = [refresh(t.spark, path, config, {"confluence": load}, force).select(F.lit(run).alias("run"), "hash", "label", "added", "skipped", "deleted")
            for run, force in (("start", False), ("forced", True))]
    return runs[0].unionByName(runs[1])


def _streamed_index(t: Tables) -> str:
    path = scratch_path(t.spark, "stream-index")
    docs = po.read_table_stream(t.spark, t.folder, "documents.parquet")
    po.stream_index(docs, path, document_chunks, scratch_path(t.spark, "stream-state")).awaitTermination()
    return path


@query("st3_stream_index", f"WITH RECURSIVE {SPLIT_CHUNKS} SELECT namespace, count(DISTINCT page_content) AS chunks FROM chunks GROUP BY namespace")
def _(t: Tables) -> DataFrame:
    return ix.read_index(t.spark, _streamed_index(t)).groupBy("namespace").agg(F.count("*").alias("chunks"))


@query("st4_changed_since", f"""
WITH RECURSIVE {SPLIT_CHUNKS} SELECT true AS changed_at_first, false AS changed_again, count(*) AS chunks FROM (SELECT DISTINCT namespace, page_content FROM chunks)""")
def _(t: Tables) -> DataFrame:
    path = _streamed_index(t)
    changed, version = po.changed_since(t.spark, path, 0)
    again, _ = po.changed_since(t.spark, path, version)
    return ix.read_index(t.spark, path).agg(F.count("*").alias("chunks")).select(
        F.lit(changed).alias("changed_at_first"), F.lit(again).alias("changed_again"), "chunks")


@query("st5_stream_job_counts", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, user_id AS job, count_if(event_type = 'error')::BIGINT AS warnings, count(*) AS lines
FROM events GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    lines = _polled(t).select("ts", c("user_id").alias("job"), "event_type")
    rows = po.stream_job_counts(lines, ["job"], {"warnings": c("event_type") == "error", "lines": F.lit(True)}, time_col="ts", window="1 hour")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "job", "warnings", "lines")
