"""File listings as a data source: each folder is listed by a task of its own.

``spark.read.format("file_listing").load(prefix)`` has a row per file, empty ones
included, hidden ones (as Spark has them: ``_x``, ``.x``) not. Only names of folders pass through the driver: the
ones at the top, and below them as many levels as ``depth`` says, dealt out to
partitions that list what is in them. Conditions on name, path, size and time are
tested where the files are listed. Local paths are walked entry by entry; others
are opened by Arrow, which knows HDFS, S3 and GCS and takes their settings from
the environment.
"""

from __future__ import annotations

import fnmatch
import os
import re
import sys
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

# the source is made in tasks, whose workers need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "name string, modified_at timestamp_ntz, size_bytes bigint, path string"
BATCH = 5000  # rows handed to Spark at a time
PARTITIONS = 64  # at most; more folders share one
_EPOCH = datetime(1970, 1, 1)
_TESTS = {
    EqualTo: lambda a, b: a == b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    StringStartsWith: lambda a, b: a.startswith(b),
    StringEndsWith: lambda a, b: a.endswith(b),
    StringContains: lambda a, b: b in a,
}


class _Local:
    """The local file system; an entry is (path, is a folder, microseconds, bytes)."""

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int, int]]:
        with os.scandir(folder) as found:
            for entry in found:
                if entry.is_dir():
                    yield entry.path, True, 0, 0
                else:
                    status = entry.stat()
                    yield entry.path, False, status.st_mtime_ns // 1000, status.st_size

    def one(self, path: str) -> tuple[str, bool, int, int] | None:
        if os.path.isdir(path):
            return path, True, 0, 0
        if not os.path.exists(path):
            return None
        status = os.stat(path)
        return path, False, status.st_mtime_ns // 1000, status.st_size

    def delete(self, path: str) -> bool:
        try:
            os.unlink(path)
        except FileNotFoundError:
            return False
        return True

    def read(self, path: str):
        """A file to read, which can be told where to go on."""
        return open(path, "rb")

    def create(self, path: str):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "xb")

    def create_new(self, path: str, data: bytes) -> bool:
        """A file that is seen whole or not at all; False if one is there."""
        folder, name = os.path.split(path)
        hidden = f"{folder}/_{name}.{uuid.uuid4().hex}"
        os.makedirs(folder, exist_ok=True)
        with open(hidden, "xb") as file:
            file.write(data)
        try:
            os.link(hidden, path)
        except FileExistsError:
            return False
        finally:
            os.unlink(hidden)
        return True


class _Remote:
    """A file system that Arrow knows."""

    def __init__(self, system):
        self.system = system

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int, int]]:
        from pyarrow.fs import FileSelector

        for info in self.system.get_file_info(FileSelector(folder)):
            yield self._entry(info)

    def one(self, path: str) -> tuple[str, bool, int, int] | None:
        from pyarrow.fs import FileType

        info = self.system.get_file_info(path)
        return None if info.type == FileType.NotFound else self._entry(info)

    def _entry(self, info) -> tuple[str, bool, int, int]:
        from pyarrow.fs import FileType

        if info.type == FileType.Directory:
            return info.path, True, 0, 0
        return info.path, False, (info.mtime_ns or 0) // 1000, info.size

    def delete(self, path: str) -> bool:
        try:
            self.system.delete_file(path)
        except FileNotFoundError:
            return False
        return True

    def read(self, path: str):
        return self.system.open_input_file(path)

    def create(self, path: str):
        return self.system.open_output_stream(path)


def opened(path: str) -> tuple[_Local | _Remote, str]:
    """The file system of a path, and what listings show before the paths that it gives."""
    scheme = re.match(r"([A-Za-z][\w+.-]+):", path)
    if scheme is None or scheme[1] == "file":
        return _Local(), "file:"
    from pyarrow.fs import FileSystem

    system, plain = FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    return _Remote(system), path[: path.rindex(plain)] if plain in path else f"{scheme[1]}://"


def inside(path: str, start: str) -> str:
    """A path as its file system has it."""
    if start == "file:":
        path = re.sub(r"^file:/*", "/", path)
        return os.path.abspath(path)
    return path.removeprefix(start).rstrip("/")


class _Folders(InputPartition):
    """Folders to be listed, each with all below it (deep) or without folders."""

    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.prefix = options["path"]
        self.pattern = options.get("pattern")
        self.recursive = options.get("recursive", "false") == "true"
        self.depth = int(options.get("depth", "1"))
        self.tests: list = []

    def pushFilters(self, filters):
        for one in filters:
            column = one.attribute[0] if len(one.attribute) == 1 else None
            known = column in ("name", "path", "size_bytes", "modified_at")
            if known and type(one) in _TESTS:
                self.tests.append((type(one).__name__, column, one.value))
            elif not (known and isinstance(one, IsNotNull)):  # none of them ever is
                yield one

    def partitions(self) -> list[_Folders]:
        system, start = opened(self.prefix)
        plain = inside(self.prefix, start)
        if not self.recursive:
            return [_Folders([(plain, False)])]
        found, level = [], [plain]
        for _ in range(self.depth):
            found += [(folder, False) for folder in level]
            level = [p for folder in level for p, is_folder, *_ in self._below(system, folder) if is_folder]
        found += [(folder, True) for folder in level]
        return [_Folders(found[i::PARTITIONS]) for i in range(min(PARTITIONS, len(found)))]

    @staticmethod
    def _below(system, folder: str) -> Iterator[tuple[str, bool, int, int]]:
        """What is in a folder but for hidden entries; a file by itself."""
        one = system.one(folder)
        if one is None:
            raise FileNotFoundError(folder)
        if not one[1]:
            return iter([one])
        return (x for x in system.entries(folder) if x[0].rsplit("/", 1)[-1][0] not in "._")

    def read(self, partition: _Folders) -> Iterator[pa.RecordBatch]:
        system, start = opened(self.prefix)
        by_name = {kind.__name__: test for kind, test in _TESTS.items()}
        rows: list[tuple] = []
        waiting = list(partition.folders)
        while waiting:
            folder, deep = waiting.pop()
            for path, is_folder, micros, size in self._below(system, folder):
                if is_folder:
                    waiting += [(path, True)] * deep
                    continue
                row = {
                    "name": path.rsplit("/", 1)[-1],
                    "modified_at": _EPOCH + timedelta(microseconds=micros),
                    "size_bytes": size,
                    "path": start + path,
                }
                if self.pattern and not fnmatch.fnmatchcase(row["name"], self.pattern):
                    continue
                if all(by_name[kind](row[column], value) for kind, column, value in self.tests):
                    rows.append(tuple(row.values()))
                    if len(rows) == BATCH:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.timestamp("us"), pa.int64(), pa.string())
    arrays = [pa.array(list(column), kind) for column, kind in zip(zip(*rows), kinds)]
    return pa.record_batch(arrays, names=["name", "modified_at", "size_bytes", "path"])


class FileListing(DataSource):
    """Options: ``pattern`` (of names), ``recursive``, ``depth`` (levels that are partitions)."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(dict(self.options))


def listing(
    spark: SparkSession, prefix: str, pattern: str | None = None, recursive: bool = False, depth: int = 1
) -> DataFrame:
    """The files below a prefix as (name, modified_at, size_bytes, path)."""
    spark.dataSource.register(FileListing)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("file_listing").option("recursive", str(recursive).lower())
    if pattern:
        reader = reader.option("pattern", pattern)
    return reader.option("depth", str(depth)).load(prefix)


class Stores:
    """The file systems of many paths, each opened once."""

    def __init__(self) -> None:
        self.opened: dict[str, tuple] = {}

    def of(self, path: str) -> tuple[_Local | _Remote, str]:
        """The file system of a path, and the path in it."""
        store = "/".join(path.split("/")[:3]) if "://" in path else "file:"
        if store not in self.opened:
            self.opened[store] = opened(path)
        system, start = self.opened[store]
        return system, inside(path, start)


def deleted(paths: DataFrame) -> DataFrame:
    """Delete the files of a frame's column ``path`` in its tasks: (path, deleted).

    Lazy, like any frame; a task that runs again finds its files gone and says so.
    """

    def gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = Stores()
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                system, plain = stores.of(path)
                out.append(system.delete(plain))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.bool_())], names=["path", "deleted"])

    return paths.select("path").mapInArrow(gone, "path string, deleted boolean")
