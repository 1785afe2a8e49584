"""File system calls: existence, size, delete, rename, create if absent.

The one place that reaches through the session to Hadoop's file system, since
Spark itself has no call to delete or rename a path. Paths of the local file
system are served by Python, which can also create a file only if it is absent.
"""

from __future__ import annotations

import os
import re
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession

_default_schemes: dict[str, str] = {}


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path without its scheme if it is on the local file system."""
    scheme = urlparse(path).scheme if re.match(r"[A-Za-z][\w+.-]+:", path) else ""
    if not scheme:
        session = spark.sparkContext.applicationId
        if session not in _default_schemes:
            fs, _ = _at(spark, "/")
            _default_schemes[session] = fs.getUri().getScheme()
        scheme = _default_schemes[session]
    if scheme != "file":
        return None
    return "/" + re.sub(r"^file:/*", "", path).lstrip("/") if path.startswith("file:") else path


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def size_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files at or below the path."""
    fs, target = _at(spark, path)
    return fs.getContentSummary(target).getLength()


def modified_millis(spark: SparkSession, path: str) -> int:
    """Time of the last change, in milliseconds since the epoch."""
    fs, target = _at(spark, path)
    return fs.getFileStatus(target).getModificationTime()


def set_modified(spark: SparkSession, path: str, millis: int) -> None:
    """Give a file another time of its last change."""
    fs, target = _at(spark, path)
    fs.setTimes(target, millis, -1)


def write_new(spark: SparkSession, path: str, data: bytes) -> bool:
    """Write a file that is seen whole or not at all; False, and nothing written, if one is there.

    Of two writers of one path at the same time exactly one succeeds. The data goes to a hidden
    name first and is then linked (local) or renamed, which file systems such as HDFS refuse if the
    target exists. On an object store without such a rename, point the folder at a store that has one.
    """
    folder, name = path.rsplit("/", 1)
    hidden = f"{folder}/_{name}.{uuid.uuid4().hex}"
    local = local_path(spark, path)
    if local is not None:
        hidden = local_path(spark, hidden)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(hidden, "xb") as file:
            file.write(data)
        try:
            os.link(hidden, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(hidden)
        return True
    fs, target = _at(spark, path)
    if fs.exists(target):
        return False
    _, temporary = _at(spark, hidden)
    stream = fs.create(temporary, False)
    stream.write(bytearray(data))
    stream.close()
    if fs.rename(temporary, target):
        return True
    fs.delete(temporary, False)
    return False


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file as a whole."""
    local = local_path(spark, path)
    if local is not None:
        with open(local, "rb") as file:
            return file.read()
    fs, target = _at(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, without hidden ones; none if there is no folder."""
    local = local_path(spark, path)
    if local is not None:
        try:
            return sorted(n for n in os.listdir(local) if not n.startswith(("_", ".")))
        except FileNotFoundError:
            return []
    fs, target = _at(spark, path)
    if not fs.exists(target):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(target)]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a path with everything below; False if there was nothing."""
    fs, target = _at(spark, path)
    return fs.delete(target, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, old = _at(spark, source)
    _, new = _at(spark, target)
    if not fs.exists(old):
        raise FileNotFoundError(source)
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise IOError(f"could not rename {source} to {target}")


def can_join(spark: SparkSession, path: str) -> bool:
    """Whether files at a path can be made one without one process copying them all."""
    if local_path(spark, path) is not None:
        return True
    fs, target = _at(spark, path)
    return fs.hasPathCapability(target, "fs.capability.paths.concat")


def concat(spark: SparkSession, target: str, sources: list[str]) -> None:
    """Add files to the end of another one, by the file system itself; the files are gone then."""
    fs, whole = _at(spark, target)
    parts = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, len(sources))
    for i, source in enumerate(sources):
        parts[i] = _at(spark, source)[1]
    fs.concat(whole, parts)


def full_path(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as file listings show it."""
    fs, target = _at(spark, path)
    return fs.makeQualified(target).toString()
