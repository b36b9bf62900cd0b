"""Session set-up and the shared scratch folder."""
from __future__ import annotations

import contextlib
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_shipped: set[str] = set()
_passing: list[list[str]] = []


def get_session(app: str = "corpusflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here assumes (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # the ids a poll has seen outgrow the heap
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session, once.

    Needed where it is not installed on the executors; Spark distributes the archive.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="corpusflow-"), "corpusflow.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a session whose tasks run in the driver's own process (``local``, ``local[...]``) may fall back
    to a temporary folder; anywhere else a missing setting is an error, because executors could not
    read what others wrote.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="corpusflow-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder, in the folder of this application."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing will read any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs whose results are written, which it does when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_scratch(spark: SparkSession) -> None:
    """Remove the scratch tables of this application; results that have not been read are gone with them."""
    drop_scratch(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


@contextlib.contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are written inside are removed at the end, and shuffle files may go; what is ``kept`` stays."""
    _passing.append([])
    try:
        yield
    finally:
        free_shuffles(spark)
        for path in _passing.pop():
            drop_scratch(spark, path)


def materialized(df: DataFrame, name: str = "table", kept: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: worked out once, its lineage cut.

    Unlike a checkpoint, the size of a written table is known when later joins are planned,
    so Spark broadcasts it where it is small and shuffles where it is not.
    """
    path = scratch_path(df.sparkSession, name)
    if _passing and not kept:
        _passing[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A Parquet table, or no rows where none has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_spread(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A Parquet table for costly work per row.

    A table of fewer input splits than the cluster has cores is spread by ``key``; a larger
    one, which keeps every core busy as it is, is read in place.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
