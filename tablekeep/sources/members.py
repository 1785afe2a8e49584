"""Dump text as gzip files of many members, which many tasks can read.

A gzip file may consist of members, one after the other, and any reader of gzip takes them for one
text. Members written here hold whole lines and say in an extra field of their header how long they
are, so that a task finds where they start by going from header to header, and others inflate some of
them each. A gzip file without such fields is read as one member, by one task.
"""

from __future__ import annotations

import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablekeep.sources import files
from tablekeep.sources.listing import Stores, listing

# tasks get these functions whole, as their workers need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMBER_BYTES = 4 << 20  # of text in a member
TASK_BYTES = 64 << 20  # of compressed members that a task reads
BATCH_LINES = 10_000
CHUNK = 1 << 20

# The start of a gzip header with an extra field, and the name and length of ours.
# After the header's ten bytes come the length of all extra fields, then name, length and content.
HEADER = bytes((0x1F, 0x8B, 8, 4, 0, 0, 0, 0, 0, 255))
FIELD = b"TK"
FIELD_BYTES = 8
PREFIX_BYTES = len(HEADER) + 2 + 4 + FIELD_BYTES


def member(text: bytes) -> bytes:
    """Text as one member that knows its own length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(text) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(text), len(text) & 0xFFFFFFFF)
    length = PREFIX_BYTES + len(body) + len(tail)
    extra = FIELD + struct.pack("<HQ", FIELD_BYTES, length)
    return HEADER + struct.pack("<H", len(extra)) + extra + body + tail


def member_length(head: bytes) -> int | None:
    """What a member's header says of its length; None if it is not one of ours."""
    ours = head[:4] == HEADER[:4] and head[len(HEADER) + 2 : len(HEADER) + 4] == FIELD
    return struct.unpack_from("<Q", head, PREFIX_BYTES - FIELD_BYTES)[0] if ours and len(head) == PREFIX_BYTES else None


def inflated(stream, length: int | None) -> Iterator[bytes]:
    """The text of one member, or of all members to the file's end if no length is known."""
    left, unpack = length, zlib.decompressobj(zlib.MAX_WBITS | 16)
    while left is None or left > 0:
        data = stream.read(CHUNK if left is None else min(CHUNK, left))
        if not data:
            break
        left = None if left is None else left - len(data)
        while data:
            if unpack.eof:
                data = data.lstrip(b"\0")  # zeros may pad a file
                if not data:
                    break
                unpack = zlib.decompressobj(zlib.MAX_WBITS | 16)
            yield unpack.decompress(data)
            data = unpack.unused_data
    if not unpack.eof:
        raise EOFError("the file ends inside a gzip member")


def lines_in(parts: Iterator[bytes]) -> Iterator[str]:
    """The lines of a text in parts, without what ends them."""
    rest = b""
    for part in parts:
        *lines, rest = (rest + part).split(b"\n")
        for line in lines:
            yield line.removesuffix(b"\r").decode("utf-8", "replace")
    if rest:
        yield rest.decode("utf-8", "replace")


def write_members(
    lines: DataFrame,
    path: str,
    member_bytes: int = MEMBER_BYTES,
    before: str | None = None,
    after: str | None = None,
    one_file: bool = False,
) -> DataFrame:
    """Write the text column ``value`` as a gzip file for each partition that has rows.

    ``before`` and ``after`` are lines that each file starts and ends with. Tasks write under names of
    their own attempts; only files of attempts that count are given their place. With ``one_file`` the
    members of all partitions, in their order, are put together as one file, which takes no such lines:
    tasks copy them to their places in it, or the file system joins them. One that can do
    neither, such as an object store, has it written by one task. Returns (path, members, text_bytes)
    of the files.
    """
    if one_file and not (before is None and after is None):
        raise ValueError("lines before and after are for a file of each partition")
    spark, token = lines.sparkSession, uuid.uuid4().hex
    if one_file and not files.can_join(spark, path):
        lines = lines.coalesce(1)
    hidden = f"{path.rstrip('/')}/_writing-{token}"

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.sql.gz"
        stream, held, size, count, total = None, [], 0, 0, 0

        def flush() -> None:
            nonlocal held, size, count, total
            if held:
                text = b"\n".join(held) + b"\n"
                stream.write(member(text))
                total, count = total + len(text), count + 1
                held, size = [], 0

        for batch in batches:
            for value in batch.column(0).to_pylist():
                if stream is None:
                    system, plain = Stores().of(f"{hidden}/{own}")
                    stream = system.create(plain)
                    held = [before.encode()] if before is not None else []
                held.append((value or "").encode())
                size += len(held[-1]) + 1
                if size >= member_bytes:
                    flush()
        if stream is not None:
            held += [after.encode()] if after is not None else []
            flush()
            stream.close()
            yield pa.record_batch(
                [pa.array([own]), pa.array([count], pa.int64()), pa.array([total], pa.int64())],
                names=["name", "members", "text_bytes"],
            )

    done = lines.select(F.col("value").cast("string")).mapInArrow(
        written, "name string, members long, text_bytes long"
    ).collect()
    if one_file and len(done) > 1:
        done = [_joined(spark, hidden, sorted(done, key=lambda row: row["name"]))]
    for row in done:
        files.rename(spark, f"{hidden}/{row['name']}", f"{path.rstrip('/')}/{row['name']}")
    files.delete(spark, hidden)
    found = [(f"{path.rstrip('/')}/{r['name']}", r["members"], r["text_bytes"]) for r in done]
    return spark.createDataFrame(found, "path string, members long, text_bytes long")


def _joined(spark: SparkSession, folder: str, parts: list) -> dict:
    """Files of members put one after the other as one file; its name, members and bytes of text."""
    whole = f"part-{uuid.uuid4().hex}.sql.gz"
    if files.local_path(spark, folder) is None:
        first, *others = [f"{folder}/{row['name']}" for row in parts]
        files.rename(spark, first, f"{folder}/{whole}")
        files.concat(spark, f"{folder}/{whole}", others)
    else:
        files.write_new(spark, f"{folder}/{whole}", b"")
        sizes = [files.size_bytes(spark, f"{folder}/{row['name']}") for row in parts]
        starts = accumulate(sizes, initial=0)
        places = [(f"{folder}/{row['name']}", f"{folder}/{whole}", at) for row, at in zip(parts, starts)]

        def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stores = Stores()
            for batch in batches:
                for source, target, start in zip(*[c.to_pylist() for c in batch.columns]):
                    # the same bytes at the same place, however often a task is run
                    with open(stores.of(source)[1], "rb") as part, open(stores.of(target)[1], "r+b") as file:
                        file.seek(start)
                        while data := part.read(CHUNK):
                            file.write(data)
                yield pa.record_batch([batch.column(2)], names=["start"])

        frame = spark.createDataFrame(places, "source string, target string, start long")
        frame.repartition(len(places)).mapInArrow(copied, "start long").count()
        if files.size_bytes(spark, f"{folder}/{whole}") != sum(sizes):
            raise OSError(f"{folder}/{whole} is not as long as its parts")
    return {"name": whole, **{k: sum(row[k] for row in parts) for k in ("members", "text_bytes")}}


def member_index(found: DataFrame) -> DataFrame:
    """(path, name, start, length) of all members of listed gzip files; one without a length for a
    file that does not tell."""

    def hopped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = Stores()
        for batch in batches:
            rows = []
            for path, name, size in zip(*[c.to_pylist() for c in batch.columns]):
                system, plain = stores.of(path)
                start = 0
                with system.read(plain) as stream:
                    while start < size:
                        stream.seek(start)
                        length = member_length(stream.read(PREFIX_BYTES))
                        rows.append((path, name, start, length))
                        start = size if length is None else start + length
            if rows:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
                arrays = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
                yield pa.record_batch(arrays, names=["path", "name", "start", "length"])

    return found.select("path", "name", "size_bytes").mapInArrow(
        hopped, "path string, name string, start long, length long"
    )


def stored_members(
    spark: SparkSession, prefix: str, pattern: str = "*.gz", recursive: bool = False
) -> tuple[DataFrame, int]:
    """:func:`member_index` of the gzip files below a prefix, and how many tasks their bytes need, or as
    many as there are cores."""
    found = listing(spark, prefix, pattern, recursive)
    index = member_index(found.where("size_bytes > 0"))
    size = found.agg(F.sum("size_bytes")).first()[0] or 0
    return index, max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def lines_at(stores: Stores, path: str, start: int, length: int | None) -> Iterator[str]:
    """The lines of one member."""
    system, plain = stores.of(path)
    with system.read(plain) as stream:
        stream.seek(start)
        yield from lines_in(inflated(stream, length))


def member_lines(spark: SparkSession, prefix: str, pattern: str = "*.gz", recursive: bool = False) -> DataFrame:
    """Lines of gzip files as (path, name, start, n, value): a line's member, and its number in it.

    Members are dealt out to tasks by their bytes.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = Stores()
        for batch in batches:
            for path, name, start, length in zip(*[c.to_pylist() for c in batch.columns]):
                lines, n = lines_at(stores, path, start, length), 0
                while held := list(islice(lines, BATCH_LINES)):
                    yield _lines(path, name, start, n, held)
                    n += len(held)

    index, parts = stored_members(spark, prefix, pattern, recursive)
    dealt = index.repartition(parts, "path", "start")
    return dealt.mapInArrow(read, "path string, name string, start long, n long, value string")


def _lines(path: str, name: str, start: int, n: int, values: list[str]) -> pa.RecordBatch:
    count = len(values)
    return pa.record_batch(
        [
            pa.array([path] * count),
            pa.array([name] * count),
            pa.array([start] * count, pa.int64()),
            pa.array(range(n, n + count), pa.int64()),
            pa.array(values, pa.string()),
        ],
        names=["path", "name", "start", "n", "value"],
    )
