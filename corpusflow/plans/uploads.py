"""Questions over a few uploaded files, indexed for one session."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusflow.operators.index import build_ephemeral
from corpusflow.plans.retrieve import document_chunks
from corpusflow.sources.documents import require_rows
from corpusflow.sources.files import TEXT_TYPES, UPLOAD_MAX_FILES, UPLOAD_MAX_MB, filter_uploads
from corpusflow.sources.tree import read_tree


def upload_index(spark: SparkSession, folder: str, max_mb: int = UPLOAD_MAX_MB, max_files: int = UPLOAD_MAX_FILES,
                 embedder=None) -> DataFrame:
    """The chunks of all accepted uploads with their vectors, one namespace per file.

    Files are accepted from their listing alone; only accepted ones, a handful, are opened.
    """
    accepted = filter_uploads(read_tree(spark, folder, content=False), TEXT_TYPES, max_mb, max_files)
    names = [row.path for row in require_rows(accepted, f"no file accepted in {folder}").collect()]
    files = read_tree(spark, folder, only=names)
    docs = files.select(F.col("path").alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
                        F.col("path").alias("source"))
    return build_ephemeral(document_chunks(docs), embedder)
