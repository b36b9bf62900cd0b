"""Streams: poll-and-track, continuous index upkeep, log counters and the change signal."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from corpusflow.operators.index import build_index, sources_to_refresh
from corpusflow.operators.runs import current_number
from corpusflow.session import read_or_empty, scratch_path


def read_table_stream(spark: SparkSession, folder: str, file_name: str, files_per_batch: int = 1_000) -> DataFrame:
    """New Parquet files of one name pattern in a folder as a stream; a folder of that very name is a table and all its files count."""
    table = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{file_name}")
    files = {"maxFilesPerTrigger": files_per_batch}
    if table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isDirectory(table):
        folder = f"{folder}/{file_name}"
    else:
        files["pathGlobFilter"] = file_name
    schema = spark.read.options(**files).parquet(folder).schema
    return spark.readStream.schema(schema).options(**files).parquet(folder)


def track_new(stream: DataFrame, id_cols: list[str], *, delay: str | None = None) -> DataFrame:
    """Each id once, however often it is polled and in whatever order its rows are dated.

    Exact without ``delay`` (all ids stay in state). With it an id is forgotten ``delay`` after it first
    *arrived*, so state is bounded and no row is ever too late to be seen; a copy that arrives after
    that passes again.
    """
    if delay is None:
        return stream.dropDuplicates(id_cols)
    arrived = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay)
    return arrived.dropDuplicatesWithinWatermark(id_cols).drop("_arrived")


def drain_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that has arrived into a table in the shared folder and read it."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    query = (stream.writeStream.format("parquet").option("checkpointLocation", state)
             .outputMode("append").trigger(availableNow=True).start(out))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_index(stream: DataFrame, path: str, to_chunks: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Keep an index up to date with arriving documents; a repeated batch changes nothing."""
    def upsert(batch: DataFrame, _: int) -> None:
        build_index(batch.sparkSession, path, to_chunks(batch), cleanup=None)

    return (stream.writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(upsert).start())


def changed_since(spark: SparkSession, path: str, version: int) -> tuple[bool, int]:
    """Whether the index is newer than ``version``, and its version (the number of its last run). Each reader keeps its own."""
    current = current_number(spark, path)
    return current > version, current


def refresh_job(configured: DataFrame, local: DataFrame, ingest: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """One scheduled run: ingest what is due (``force``: everything) and return labels to store.

    ``ingest`` gets the due sources and returns those that succeeded, so a failed source stays
    due. An outside scheduler starts the job, at first without and later with ``force``.
    """
    due = sources_to_refresh(configured, local, force)
    done = ingest(due)
    label = F.concat("source_type", F.lit(": "), "identifier_type", F.lit("="), "identifier")
    fresh = done.join(local.select("hash").distinct(), "hash", "left_anti")
    return fresh.select("hash", label.alias("label"))


def stream_job_counts(stream: DataFrame, keys: list[str], counts: dict[str, Column], *, time_col: str, window: str,
                      name: str = "counts") -> DataFrame:
    """Counts per time window and job over all lines that have arrived, late ones included.

    Each batch adds its own counts to a table, written anew if the batch is repeated; reading adds
    them up. No state is kept, so nothing depends on the order or number of files in a batch.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    summed = [F.count_if(c).alias(n) for n, c in counts.items()]

    def add(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy(F.window(F.col(time_col).cast("timestamp"), window).alias("_w"), *keys).agg(*summed)
        part.select(F.col("_w.start").alias("window_start"), *keys, *counts).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
    types = {f.name: f.dataType for f in stream.schema}
    schema = StructType([StructField("window_start", TimestampType()), *[StructField(k, types[k]) for k in keys],
                         *[StructField(n, LongType()) for n in counts]])
    return read_or_empty(spark, out, schema).groupBy("window_start", *keys).agg(*[F.sum(n).alias(n) for n in counts])
