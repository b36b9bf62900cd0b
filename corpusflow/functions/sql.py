"""Functions for use in SQL text."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession, functions as F

from corpusflow.operators.chunking import split_column


def register(spark: SparkSession) -> None:
    """Make functions that cut texts batch by batch known to a session's SQL.

    ``chunk_text(text, size, overlap)`` is an array: ``LATERAL VIEW posexplode(chunk_text(t, 1500, 300)) c AS ord, chunk``
    gives rows beside all other columns. ``chunk_rows(TABLE(SELECT id, text FROM docs))`` is a table of its own:
    ``id`` (as text), ``ord`` and ``chunk`` of the usual size, worked on where the rows lie.
    """
    @F.arrow_udf("array<string>")
    def chunk_text(texts: pa.Array, sizes: pa.Array, overlaps: pa.Array) -> pa.Array:
        return split_column(texts, sizes.to_pylist(), overlaps.to_pylist())

    @F.arrow_udtf(returnType="id string, ord int, chunk string")
    class ChunkRows:
        def eval(self, rows: pa.RecordBatch):
            chunks = split_column(rows.column(1))
            counts = chunks.value_lengths().to_numpy()
            first = np.concatenate([[0], np.cumsum(counts)])[:-1]
            owner = pa.array(np.repeat(np.arange(len(counts)), counts), pa.int64())
            ord_ = np.arange(len(owner)) - np.repeat(first, counts)
            yield pa.table({"id": rows.column(0).cast(pa.string()).take(owner), "ord": pa.array(ord_.astype(np.int32)), "chunk": chunks.flatten()})

    spark.udf.register("chunk_text", chunk_text)
    spark.udtf.register("chunk_rows", ChunkRows)
