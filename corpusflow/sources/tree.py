"""A Spark data source for all files below a folder, one row per file.

Spark's own file formats leave out names that begin with ``.`` or ``_``, which a repository is
full of (``.env``, ``__init__.py``). Here they are listed like any other file.
"""
from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Bytes and files read by one task; bytes handed over at a time.
TASK_BYTES = 128 * 1024 * 1024
TASK_FILES = 10_000
BATCH_BYTES = 16 * 1024 * 1024

_SCHEMA = "path string, length bigint, content binary"
_ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])


class FileTree(DataSource):
    """``spark.read.format("file_tree").option("extensions", '[".txt", ".json"]').load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _Files(InputPartition):
    def __init__(self, names: list[tuple[str, int]]):
        self.names = names


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.extensions = tuple(json.loads(options.get("extensions", "[]")))
        self.skip = tuple(json.loads(options.get("skip", "[]")))
        self.only = frozenset(json.loads(options.get("only", "[]")))
        self.content = options.get("content", "true") == "true"

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder)

    def _wanted(self, relative: str) -> bool:
        if self.extensions and os.path.splitext(relative)[1].lower() not in self.extensions:
            return False
        return not relative.startswith(self.skip) and (not self.only or relative in self.only)

    def partitions(self) -> Sequence[InputPartition]:
        system, root = self._open()
        root = root.rstrip("/")
        tasks, names, size = [], [], 0
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            relative = info.path[len(root) + 1:]
            if not info.is_file or not self._wanted(relative):
                continue
            if names and (size + info.size > TASK_BYTES or len(names) >= TASK_FILES):
                tasks.append(_Files(names))
                names, size = [], 0
            names.append((relative, info.size))
            size += info.size
        return [*tasks, _Files(names)]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, root = self._open()
        root = root.rstrip("/")
        rows, size = [], 0
        for relative, length in partition.names:
            if self.content:
                with system.open_input_stream(f"{root}/{relative}") as stream:
                    rows.append((relative, length, stream.read()))
                size += length
            else:
                rows.append((relative, length, None))
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


def read_tree(spark: SparkSession, folder: str, extensions: Sequence[str] = (), skip: Sequence[str] = (),
              only: Sequence[str] = (), content: bool = True) -> DataFrame:
    """``(path, length, content)`` of all files, or those of some extensions, outside some
    folders (``skip``) or of given names (``only``); ``path`` is relative to ``folder``.

    With ``content=False`` the files are listed and not opened.
    """
    spark.dataSource.register(FileTree)
    return spark.read.format("file_tree").options(
        extensions=json.dumps(list(extensions)), skip=json.dumps(list(skip)), only=json.dumps(list(only)),
        content=str(content).lower()).load(folder)
