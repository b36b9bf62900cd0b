"""The chunk index: one Parquet table partitioned by namespace, kept up to date by content key."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from corpusflow.functions.text import content_key
from corpusflow.functions.vectors import embed
from corpusflow.operators.ordering import first_rows
from corpusflow.operators.runs import MANY_RUNS, Snapshot, Written, change, late_runs, read_runs, snapshot
from corpusflow.session import materialized

# Namespace choices that name no single index.
NO_SOURCE = "none"
ALL_SOURCES = "all"

INDEX_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("chunk_id", T.StringType()),
    T.StructField("doc_id", T.StringType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("page_content", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("namespace", T.StringType()),
])
# What a run stores (see ``runs``): chunks; keys that are gone, which hides them in earlier runs; counts per namespace
# with the time a full clean-up saw all of it; and keys that a run without clean-up saw again.
_CHUNKS = T.StructType([*INDEX_SCHEMA.fields[:-1], T.StructField("at", T.TimestampType()), T.StructField("run", T.StringType()), INDEX_SCHEMA["namespace"]])
_KEYED = [T.StructField("namespace", T.StringType()), T.StructField("key", T.StringType())]
_RUN = T.StructField("run", T.StringType())
_GONE = T.StructType([*_KEYED, _RUN])
_TOUCHED = T.StructType([*_KEYED, T.StructField("at", T.TimestampType()), _RUN])
_TOTALS = T.StructType([T.StructField("namespace", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("added", "updated", "skipped", "deleted")),
                        T.StructField("seen", T.TimestampType()), _RUN])
TABLES = {"chunks": _CHUNKS, "gone": _GONE, "touched": _TOUCHED, "totals": _TOTALS}


# --- identity and change plan ------------------------------------------------------------

def fingerprint(df: DataFrame, text_col: str = "page_content", meta_col: str = "metadata") -> DataFrame:
    """Add ``key``, the identity of a document: its content and metadata."""
    return df.withColumn("key", content_key(F.col(text_col), F.col(meta_col)))


def distinct_documents(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each set of equal documents; copies are dropped before the shuffle."""
    return first_rows(df, keys, order)


def _named(df: DataFrame) -> DataFrame:
    """Rows must name their namespace: a folder cannot be called null or nothing."""
    missing = F.raise_error(F.lit("a chunk has no namespace")).cast("string")
    return df.withColumn("namespace", F.when(F.length("namespace") > 0, F.col("namespace")).otherwise(missing))


def plan_upsert(incoming: DataFrame, records: DataFrame, cleanup: str | None = "full",
                namespaces: DataFrame | None = None) -> DataFrame:
    """``(namespace, key, action)`` with ``add``, ``skip`` or, in full clean-up, ``delete``.

    ``namespaces`` names what this run covers when ``incoming`` may be empty; recorded keys of
    other namespaces are left alone. Recorded keys are filtered where they lie by the incoming
    ones, whose size is known, so a small run does not shuffle a large index.
    """
    if cleanup not in ("full", None):
        raise ValueError(f"unknown cleanup: {cleanup}")
    new = materialized(_named(incoming.select("namespace", "key").distinct()), "incoming")
    known = materialized(records.select("namespace", "key").join(new, ["namespace", "key"], "left_semi").distinct(), "known")
    action = F.when(F.col("_known").isNull(), "add").otherwise("skip")
    plan = (new.join(known.withColumn("_known", F.lit(True)), ["namespace", "key"], "left")
            .select("namespace", "key", action.alias("action")))
    if cleanup is None:
        return plan
    gone = plan_deletes(records, new, cleanup, namespaces)
    return plan.unionByName(gone.withColumn("action", F.lit("delete")))


def plan_deletes(records: DataFrame, incoming: DataFrame, cleanup: str | None = "full",
                 namespaces: DataFrame | None = None) -> DataFrame:
    """Recorded keys of the covered namespaces that this run did not see."""
    if cleanup is None:
        return records.select("namespace", "key").where(F.lit(False))
    covered = (incoming if namespaces is None else namespaces).select("namespace").distinct()
    return (records.select("namespace", "key").join(covered, "namespace", "left_semi")
            .join(incoming.select("namespace", "key").distinct(), ["namespace", "key"], "left_anti").distinct())


def audit_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """What differs between two states of a table as whole rows, copies counted: the rows, ``change`` (gone or new) and ``copies``.

    Maps are compared as sorted entries and come back as such.
    """
    def comparable(df: DataFrame) -> DataFrame:
        return df.select([F.array_sort(F.map_entries(f.name)).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name)
                          for f in before.schema.fields])

    old, new = comparable(before), comparable(after)
    sides = [one.exceptAll(other).groupBy(*before.columns).agg(F.count("*").alias("copies")).withColumn("change", F.lit(change))
             for one, other, change in ((old, new, "gone"), (new, old, "new"))]
    return sides[0].unionByName(sides[1])


def upsert_counts(plan: DataFrame) -> DataFrame:
    """Added, updated, skipped and deleted keys per namespace."""
    def n(action):
        return F.count_if(F.col("action") == action).alias({"add": "added", "update": "updated", "skip": "skipped", "delete": "deleted"}[action])
    return plan.groupBy("namespace").agg(n("add"), n("update"), n("skip"), n("delete"))


# --- storage -----------------------------------------------------------------------------

def _table(spark: SparkSession, path: str, name: str, state: Snapshot) -> DataFrame:
    return read_runs(spark, path, name, TABLES[name], list(state.runs))


def _live(spark: SparkSession, path: str, state: Snapshot) -> DataFrame:
    """Chunks without those whose key went in a later run; as long as nothing was deleted, nothing is joined."""
    chunks = _table(spark, path, "chunks", state)
    if not state.having("gone"):
        return chunks
    gone = _table(spark, path, "gone", state).groupBy("namespace", "key").agg(F.max("run").alias("_gone"))
    return chunks.join(gone, (chunks["namespace"] == gone["namespace"]) & (chunks["key"] == gone["key"]) & (chunks["run"] < gone["_gone"]), "left_anti")


def read_index(spark: SparkSession, path: str, namespace: str | None = None) -> DataFrame:
    """The index, or one namespace of it (partition pruning); empty when there is none yet. Later runs do not show in it."""
    index = _live(spark, path, snapshot(spark, path)).select(*INDEX_SCHEMA.fieldNames())
    return index if namespace is None else index.where(F.col("namespace") == namespace)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """When each key was last seen in a run: added, met again, or in a namespace that a full clean-up went through."""
    state = snapshot(spark, path)
    touched = _table(spark, path, "touched", state).select("namespace", "key", "at")
    live = _live(spark, path, state).select("namespace", "key", "at")
    keys = live.join(touched.select("namespace", "key").distinct(), ["namespace", "key"], "left_semi").select("namespace", "key")
    again = touched.join(keys.distinct(), ["namespace", "key"], "left_semi")
    seen = _table(spark, path, "totals", state).groupBy("namespace").agg(F.max("seen").alias("seen"))
    return (live.unionByName(again).groupBy("namespace", "key").agg(F.max("at").alias("at")).join(seen, "namespace", "left")
            .select("key", F.col("namespace").alias("group_id"), F.greatest("at", "seen").alias("updated_at"), "namespace"))


def list_indexes(spark: SparkSession, path: str) -> DataFrame:
    """Namespaces that hold rows, from the runs' counts; neither texts nor keys are read."""
    return (_table(spark, path, "totals", snapshot(spark, path)).groupBy("namespace").agg(F.sum(F.col("added") - F.col("deleted")).alias("_n"))
            .where("_n > 0").select("namespace"))


def _store(rows: DataFrame, path: str, name: str, run: str) -> None:
    """Rows of one run; chunks in few files per namespace, and several for one that outgrows a partition (AQE)."""
    rows = rows.select([f.name for f in TABLES[name].fields if f.name != "run"])
    if name == "chunks":
        rows.hint("rebalance", "namespace").write.partitionBy("namespace").parquet(f"{path}/{name}/run={run}")
    else:
        rows.write.parquet(f"{path}/{name}/run={run}")


def _store_totals(counts: DataFrame, path: str, run: str, full: bool) -> tuple[DataFrame, Row]:
    """Write a run's counts; they are read back, with their sums, from what was written."""
    spark = counts.sparkSession
    seen = F.current_timestamp() if full else F.lit(None).cast("timestamp")
    _store(counts.withColumn("seen", seen), path, "totals", run)
    stored = spark.read.schema(T.StructType(_TOTALS.fields[:-1])).parquet(f"{path}/totals/run={run}").drop("seen")
    return stored, stored.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("added", "skipped", "deleted")]).first()


def write_index(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Replace the rows of the namespaces that occur in ``chunks`` and leave all others, or append."""
    spark = chunks.sparkSession
    chunks = materialized(_named(chunks).withColumn("at", F.current_timestamp()), "chunks")

    def write(base: Snapshot, run: str) -> Written:
        live = _live(spark, path, base).select("namespace", "key").distinct()
        new = chunks.select("namespace", "key").distinct()
        if mode == "overwrite":
            gone = materialized(live.join(new.select("namespace").distinct(), "namespace", "left_semi"), "gone")
        else:
            gone, new = live.limit(0), new.join(live, ["namespace", "key"], "left_anti")
        plan = new.withColumn("action", F.lit("add")).unionByName(gone.withColumn("action", F.lit("delete")))
        _, sums = _store_totals(upsert_counts(plan), path, run, False)
        if sums.deleted:
            _store(gone, path, "gone", run)
        _store(chunks, path, "chunks", run)
        return Written(["totals", "chunks", *["gone"] * bool(sums.deleted)], sums.added + sums.deleted)

    change(spark, path, write)


def build_index(spark: SparkSession, path: str, chunks: DataFrame, cleanup: str | None = "full",
                namespaces: DataFrame | None = None, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Bring the index at ``path`` up to date with ``chunks`` and return the counts.

    ``chunks``: namespace, chunk_id, doc_id, ord, page_content, metadata; a missing namespace is an
    error, missing text or metadata counts as empty, ids may be null. Chunks are worked out once, only new keys are
    embedded, and what goes is noted, not rewritten, so a run writes as much as it changes. Readers see a run
    whole or not at all. Running the same input again adds nothing, nor does a run that died part-way harm the next.
    """
    incoming = materialized(_named(fingerprint(chunks)).withColumn("_row", F.monotonically_increasing_id()), "chunks")

    def write(base: Snapshot, run: str) -> Written:
        plan = materialized(plan_upsert(incoming, _live(spark, path, base), cleanup, namespaces), "plan")
        counts, sums = _store_totals(upsert_counts(plan), path, run, cleanup is not None)
        tables = ["totals"] if sums.added or sums.skipped or sums.deleted else []
        if sums.deleted:
            _store(plan.where("action = 'delete'"), path, "gone", run)
            tables.append("gone")
        if sums.added:
            # copies are settled on their ids and places; texts are only fetched for the one that stays
            added = plan.where("action = 'add'").select("namespace", "key")
            first = first_rows(incoming.select("namespace", "key", "chunk_id", "_row").join(added, ["namespace", "key"], "left_semi"),
                               ["namespace", "key"], [F.col("chunk_id").asc_nulls_last(), "_row"])
            fresh = incoming.join(first.select("_row"), "_row", "left_semi").withColumn("at", F.current_timestamp())
            _store(embed(fresh, "page_content", embedder=embedder), path, "chunks", run)
            tables.append("chunks")
        if cleanup is None and sums.skipped:
            _store(plan.where("action = 'skip'").withColumn("at", F.current_timestamp()), path, "touched", run)
            tables.append("touched")
        return Written(tables, sums.added + sums.deleted + (sums.skipped if cleanup is None else 0), counts)

    counts = change(spark, path, write).result
    merge_runs(spark, path)
    return counts


def merge_runs(spark: SparkSession, path: str, many: int = MANY_RUNS) -> bool:
    """Put late runs together, if there are many, so that neither runs nor files pile up; False if there was nothing to do.

    The rows stay the same. What the merged runs deleted among themselves is left out; what they deleted of
    earlier runs stays noted. Folders of merged runs stay for readers that hold an older state (``vacuum``).
    """
    def write(base: Snapshot, run: str) -> Written:
        late = late_runs(base, many)
        own = Snapshot(base.number, tuple(late))
        tables = [n for n in TABLES if own.having(n) and not (n == "gone" and len(late) == len(base.runs))]
        for name in tables:
            rows = _live(spark, path, own) if name == "chunks" else _table(spark, path, name, own)
            if name == "totals":
                rows = rows.groupBy("namespace").agg(*[F.sum(n).alias(n) for n in ("added", "updated", "skipped", "deleted")], F.max("seen").alias("seen"))
            elif name == "touched":
                rows = rows.groupBy("namespace", "key").agg(F.max("at").alias("at"))
            elif name == "gone":
                rows = rows.select("namespace", "key").distinct()
            _store(rows, path, name, run)
        return Written(tables, sum(r.rows for r in late), instead_of=own.runs)

    return bool(change(spark, path, write).tables)


def compact_index(spark: SparkSession, path: str, target: str) -> None:
    """Write what the index at ``path`` holds to the new path ``target``, without its history."""
    live = _live(spark, path, snapshot(spark, path))
    records = read_records(spark, path).select("namespace", "key", F.col("updated_at").alias("seen"))
    rows = live.drop("at", "run").join(records, ["namespace", "key"]).withColumnRenamed("seen", "at")

    def write(base: Snapshot, run: str) -> Written:
        plan = live.select("namespace", "key").distinct().withColumn("action", F.lit("add"))
        _, sums = _store_totals(upsert_counts(plan), target, run, False)
        _store(rows, target, "chunks", run)
        return Written(["totals", "chunks"] if sums.added else [], sums.added)

    change(spark, target, write)


def build_ephemeral(chunks: DataFrame, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """An index for one session: embedded once into a scratch table, no deduplication, no record."""
    return materialized(embed(chunks, "page_content", embedder=embedder), "ephemeral")


def memory_save(spark: SparkSession, path: str, chunks: DataFrame) -> DataFrame:
    """Add to memory tables; nothing is ever removed and repeated saves change nothing."""
    return build_index(spark, path, chunks, cleanup=None)


def memory_reset(spark: SparkSession, path: str, namespaces: DataFrame) -> DataFrame:
    """Empty whole memory tables: a full clean-up without input."""
    nothing = spark.createDataFrame([], T.StructType([f for f in INDEX_SCHEMA if f.name not in ("key", "embedding")]))
    return build_index(spark, path, nothing, cleanup="full", namespaces=namespaces)


# --- registry of sources -----------------------------------------------------------------

def sources_to_refresh(configured: DataFrame, local: DataFrame, force: bool = False,
                       known_types: list[str] | None = None) -> DataFrame:
    """Configured sources without a local label, or all of them when forced.

    A source of unknown type that is due fails the job.
    """
    due = configured if force else configured.join(local.select("hash").distinct(), "hash", "left_anti")
    if known_types is not None:
        complaint = F.raise_error(F.concat(F.lit("Unknown source type: "), F.col("source_type"))).cast("string")
        due = due.withColumn("source_type", F.when(F.col("source_type").isin(known_types), F.col("source_type")).otherwise(complaint))
    return due


def orphan_labels(configured: DataFrame, local: DataFrame) -> DataFrame:
    """Labels of sources that are no longer configured."""
    return local.join(configured.select("hash").distinct(), "hash", "left_anti")


def register_labels(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The labels to append: those whose source has none yet."""
    return new.join(existing.select("hash").distinct(), "hash", "left_anti")


def available_labels(labels: DataFrame, indexes: DataFrame) -> DataFrame:
    """Labels whose source has an index."""
    return labels.join(indexes.select(F.col("namespace").alias("hash")).distinct(), "hash", "left_semi")


def select_source(index: DataFrame, selection: str) -> DataFrame:
    """``none``: nothing; ``all``: everything; otherwise one namespace."""
    if selection == ALL_SOURCES:
        return index
    if selection == NO_SOURCE:
        return index.where(F.lit(False))
    return index.where(F.col("namespace") == selection)


def resolve_label(requests: DataFrame, labels: DataFrame, *, request_col: str = "label", order: str = "hash") -> DataFrame:
    """Add the first hash whose label equals the request, ``none`` without one."""
    first = labels.groupBy(F.col("label").alias(request_col)).agg(F.min_by("hash", order).alias("_hash"))
    return (requests.join(first, request_col, "left")
            .withColumn("hash", F.coalesce("_hash", F.lit(NO_SOURCE))).drop("_hash"))
