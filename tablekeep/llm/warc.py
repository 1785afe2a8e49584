"""WARC archives compressed with Zstandard: one frame per record, the dictionary in front.

An archive starts with a skippable frame that holds the dictionary its records were compressed
with; then follows one frame for each record. Archives are written by Spark's text writer, whose
commit makes lost and repeated tasks harmless on any store. It ends every row with a line feed; each
row therefore ends in the head of a skippable frame of one byte, and the line feed is that byte,
so that the file is nothing but valid frames.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablekeep.llm.common import col, settled

# fixed values: magic numbers of frames, the version line and the profile of revisits
DICTIONARY_MAGIC = 0x184D2A5D
FILLER_MAGIC = 0x184D2A50
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILLER = struct.pack("<II", FILLER_MAGIC, 1)  # its one byte is the writer's line feed
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

LEVEL = 3
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 2 << 20
SAMPLE_RECORDS = 1000
READ_BYTES = 32 << 10


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page: object, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}').urn}>"


def record(page: object, url: str | None, payload: bytes, refers_to: object, date: str) -> bytes:
    """A response record, or a revisit of the record of the page ``refers_to`` if that is given."""
    digest = payload_digest(payload)
    block = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        b"Content-Length: %d\r\n\r\n" % len(payload)
    )
    revisit = refers_to is not None
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(page, digest),
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if url is not None:  # control characters must not end the header
        head["WARC-Target-URI"] = quote(url, safe="!#$&'()*+,/:;=?@[]%~")
    if page is not None:
        head["X-Page-Id"] = str(page)
    if revisit:
        head["WARC-Profile"] = PROFILE
        head["WARC-Refers-To"] = _record_id(refers_to, digest)
        head["X-Refers-To-Page-Id"] = str(refers_to)
    else:
        block += payload
    return _record_bytes(head, block)


def _record_bytes(head: dict[str, str], block: bytes) -> bytes:
    head["Content-Length"] = str(len(block))
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items())
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary for records like these; empty if they are too few or too short for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive_parts(records: Iterator[bytes]) -> Iterator[bytes]:
    """The rows of an archive: the dictionary's frame, then a frame for each record.

    The dictionary is trained on the first records, of which a bounded number waits.
    """
    waiting, size, compressor = [], 0, None

    def begin() -> Iterator[bytes]:
        nonlocal compressor
        dictionary = train(waiting)
        if dictionary:
            yield struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary + FILLER
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True)
        for x in waiting:
            yield compressor.compress(x) + FILLER

    for one in records:
        if compressor:
            yield compressor.compress(one) + FILLER
            continue
        waiting.append(one)
        size += len(one)
        if size >= SAMPLE_BYTES or len(waiting) >= SAMPLE_RECORDS:
            yield from begin()
    if compressor is None and waiting:
        yield from begin()


def frames(data: memoryview) -> Iterator[bytes]:
    """The records of an archive, each from a frame of its own."""
    at, decompressor = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise ValueError("the dictionary is cut off")
        raw = bytes(data[8 : 8 + size])
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        at = 8 + size
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT)
        decompressor = zstandard.ZstdDecompressor(dict_data=known)
    decompressor = decompressor or zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError(f"the frame at byte {at} is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == FILLER_MAGIC:
            at += 8 + size
            if at > len(data):
                raise ValueError("a skippable frame is cut off")
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame starts at byte {at}")
        frame, parts, begin = decompressor.decompressobj(), [], at
        while not frame.eof:
            if at >= len(data):
                raise ValueError(f"the frame at byte {begin} is cut off")
            piece = bytes(data[at : at + READ_BYTES])
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the block of a record; raises ValueError if they do not fit together."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (b"WARC/1.0", VERSION):
        raise ValueError(f"no record head: {raw[:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"no header line: {line[:80]!r}")
        fields[name.title()] = value.strip()
    for name in REQUIRED:
        if name.title() not in fields:
            raise ValueError(f"a record without {name}")
    size = fields["Content-Length"]
    if not size.isdecimal() or len(rest) != int(size) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError(f"Content-Length {size}, but {len(rest) - 4} bytes")
    return fields, rest[:-4]


def page_of(raw: bytes) -> dict | None:
    """What a response or revisit record says of its page; None for records of other kinds."""
    fields, block = parse(raw)
    kind = fields["Warc-Type"]
    if kind not in ("response", "revisit"):
        return None
    digest = fields.get("Warc-Payload-Digest", "").removeprefix("sha1:")
    head, found, payload = block.partition(b"\r\n\r\n")
    size = None
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            size = int(value)
    if not found or size is None:
        raise ValueError("no HTTP head with a length")
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"the payload of {fields['Warc-Record-Id']} is not what its head says")
    if kind == "revisit" and (payload or "X-Refers-To-Page-Id" not in fields):
        raise ValueError(f"{fields['Warc-Record-Id']} is no proper revisit")
    return {
        "page_id": fields.get("X-Page-Id"),
        "url": fields.get("Warc-Target-Uri"),
        "record_type": kind,
        "payload": payload if kind == "response" else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": fields.get("X-Refers-To-Page-Id"),
    }


def with_first(pages: DataFrame, ident: str, html: str, least_bytes: int) -> DataFrame:
    """``id``, ``url``, ``payload`` and ``first``: the page that a repeated payload belongs to.

    Only payloads that occur more than once are joined, by their digest; one that very many pages
    have is a skewed key of that join, which Spark splits.
    """
    named = pages.select(
        col(pages, ident).alias("id"),
        col(pages, "url").cast("string").alias("url"),
        F.coalesce(col(pages, html), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    firsts = named.filter(F.octet_length("payload") >= least_bytes).groupBy("digest")
    firsts = firsts.agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = settled(firsts.select("digest", "first"), "warc-firsts")
    joined = named.join(firsts, "digest", "left").drop("digest")
    own = F.col("first").isNull() | F.col("first").eqNullSafe(F.col("id"))
    return joined.withColumn("first", F.when(~own, F.col("first")))


def write_archives(
    pages: DataFrame,
    path: str,
    ident: str = "page_id",
    html: str = "html",
    least_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write one archive for each partition of the pages (columns ``ident``, ``url``, ``html``).

    Of pages with equal payloads of at least ``least_bytes`` the one with the smallest id is
    written as a response and the others as revisits of it; rows that share the smallest id are
    responses all. A null payload is empty, a null url or id has no header. Other columns are not
    archived. No pages make no archive.
    """
    rows = with_first(pages, ident, html, least_bytes)

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                columns = [batch.column(n) for n in ("id", "url", "payload", "first")]
                for row in zip(*columns):
                    page, url, payload, first = (x.as_py() for x in row)
                    yield record(page, url, payload, first, date)

        held, size = [], 0
        for part in archive_parts(records()):
            held.append(part)
            size += len(part)
            if size >= 1 << 20:
                yield pa.record_batch([pa.array(held, pa.binary())], names=["value"])
                held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(held, pa.binary())], names=["value"])

    parts = rows.mapInArrow(archived, "value binary")
    parts.select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path)


def read_archives(spark: SparkSession, path: str, ident_type: str = "long") -> DataFrame:
    """One row per response or revisit record of the archives in a folder.

    ``page_id``, ``url`` (percent-encoded as stored), ``record_type``, ``payload`` (binary, null for
    revisits), ``payload_bytes``, ``payload_digest``, ``refers_to``. Records of other kinds are
    skipped; a damaged archive, record or payload fails the read with the reason.
    """
    names = [
        "page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"
    ]
    schema = pa.schema(
        [(n, {"payload": pa.binary(), "payload_bytes": pa.int64()}.get(n, pa.string())) for n in names]
    )
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                held, size = [], 0
                data = memoryview(content.as_buffer())
                try:
                    for raw in frames(data):
                        page = page_of(raw)
                        if page:
                            held.append(page)
                            size += len(raw)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                except (ValueError, zstandard.ZstdError) as error:
                    raise ValueError(f"{name}: {error}") from error
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    found = files.mapInArrow(
        pages,
        "page_id string, url string, record_type string, payload binary, payload_bytes long,"
        " payload_digest string, refers_to string",
    )
    return found.withColumns(
        {n: F.col(n).cast(ident_type) for n in ("page_id", "refers_to")}
    )
