"""Documents: rows of ``page_content`` and a ``metadata`` map whose ``source`` says where from."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from corpusflow.functions.text import source_hash

# Source types an index can be built from.
SOURCE_TYPES = ["text", "confluence", "web", "gitlab"]
# The lists of identifiers each configured type has.
IDENTIFIER_TYPES = {"confluence": ["spaces"], "gitlab": ["groups", "projects"], "web": ["links"]}


def text_source(df: DataFrame, text_col: str, meta_cols: Sequence[str], namespace: Column) -> DataFrame:
    """One document per row; the columns ``meta_cols`` become metadata, ``source`` the namespace."""
    pairs = [x for c in meta_cols if c != "source" for x in (F.lit(c), F.col(c).cast("string"))]
    return df.withColumn("metadata", F.create_map(*pairs, F.lit("source"), namespace)) \
        .withColumn("page_content", F.col(text_col)).withColumn("source", namespace)


def stamp_source(metadata: Column, namespace: Column) -> Column:
    """A metadata map with its ``source`` replaced."""
    return F.map_concat(F.map_filter(metadata, lambda k, _: k != "source"),
                        F.create_map(F.lit("source"), namespace))


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """All documents of all containers, duplicates included."""
    return reduce(DataFrame.unionByName, frames)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail when a source yields nothing; reads one row only."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def ingest_counts(df: DataFrame, source_col: str = "source") -> DataFrame:
    return df.groupBy(source_col).agg(F.count("*").alias("documents"))


def write_documents(df: DataFrame, path: str, sources: Sequence[str], *, source_col: str = "source", message: str | None = None) -> dict[str, int]:
    """Write documents and return how many each of the ``sources`` gave, counted while they are written, not by a second scan.

    With a ``message`` no document at all is an error. ``sources`` are configured ones, as many as a configuration lists.
    """
    seen = Observation()
    counts = [F.count_if(F.col(source_col) == name).alias(f"n{i}") for i, name in enumerate(sources)]
    df.observe(seen, F.count("*").alias("rows"), *counts).write.parquet(path)
    got = seen.get
    if message is not None and not got["rows"]:
        raise ValueError(message)
    return {name: got[f"n{i}"] for i, name in enumerate(sources)}


def scan_issues(df: DataFrame, project: str, status: str, assignee: str, *, project_col: str = "project",
                status_col: str = "status", assignee_col: str = "assignee", created_col: str = "created") -> DataFrame:
    """Open issues of one assignee in one project, the oldest first (a stream comes as it arrives)."""
    found = df.where((F.col(project_col) == project) & (F.col(status_col) == status) & (F.col(assignee_col) == assignee))
    return found if df.isStreaming else found.orderBy(F.col(created_col).asc())


def configured_sources(config: DataFrame) -> DataFrame:
    """``(hash, source_type, identifier_type, identifier, ord)`` of configuration rows.

    A row has a ``source_type`` and the arrays ``spaces``, ``groups``, ``projects`` and
    ``links``, of which those of its type count.
    """
    kinds = F.array(*[
        F.struct(F.lit(source_type).alias("of"), F.lit(kind).alias("identifier_type"), F.col(kind).alias("identifiers"))
        for source_type, names in IDENTIFIER_TYPES.items() for kind in names])
    lists = config.select("source_type", F.explode(kinds).alias("k")).where("source_type = k.of")
    rows = lists.select("source_type", "k.identifier_type", F.posexplode("k.identifiers").alias("ord", "identifier"))
    return rows.select(source_hash(F.col("source_type"), F.col("identifier")).alias("hash"), "source_type", "identifier_type",
                       "identifier", "ord")
