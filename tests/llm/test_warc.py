import base64
import hashlib
import re
import struct

import pytest
import zstandard

from tablekeep.llm import warc
from tablekeep.session import scratch_folder

SCHEMA = "page_id long, url string, html string"


def pages():
    rows = [(i, f"http://h/{i}?é \r\nX: y", f"<p>page {i % 40} " + "text " * (i % 40) + "é</p>") for i in range(120)]
    return rows + [(500, None, None), (501, "u", ""), (None, "v", "<p>no id</p>"), (None, "v", "<p>page 3</p>"),
                   (502, "big", "x" * 300_000), (7, "again", rows[7][2]), (7, "again", rows[7][2])]


def expected(rows, least):
    smallest = {}
    for page, _, html in rows:
        if page is not None:
            smallest[html or ""] = min(smallest.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        first = smallest.get(html or "") if len(raw) >= least else None
        revisit = first is not None and first != page
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page, len(raw), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, root, least):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    warc.write_archives(df, root, least_bytes=least)
    found = warc.read_archives(spark, root).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=repr) == expected(pages(), least)
    texts = {hashlib.sha1((h or "").encode()).digest(): (h or "").encode() for _, _, h in pages()}
    for r in found:
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert texts[hashlib.sha1(r.payload).digest()] == bytes(r.payload)


def files(spark, root):
    return [bytes(r.content) for r in spark.read.format("binaryFile").load(root).collect() if r.length]


def test_archives_are_frames_with_a_dictionary(spark, root):
    rows = [(i, "u", f"<html><p>some words about {i}, and others</p></html>" * 5) for i in range(300)]
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), root)
    (data,) = files(spark, root)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and size > 0
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    assert dictionary.dict_id() != 0
    records = list(warc.frames(memoryview(data)))
    assert len(records) == 300
    for raw in records:
        fields, block = warc.parse(raw)
        assert len(block) == int(fields["Content-Length"])
    # the records cannot be read without it
    with pytest.raises((zstandard.ZstdError, ValueError)):
        list(warc.frames(memoryview(data[8 + size :])))


def test_compressed_dictionary_and_archives_without(spark):
    record = warc.record(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    plain = zstandard.ZstdCompressor().compress(record)
    assert [warc.page_of(x)["payload"] for x in warc.frames(memoryview(plain + plain))] == [b"payload"] * 2
    trained = warc.train([b"some sample %d of text" % i * 20 for i in range(300)])
    packed = zstandard.ZstdCompressor().compress(trained)
    head = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained)).compress(record)
    assert list(warc.frames(memoryview(head + frame))) == [record]
    assert list(warc.frames(memoryview(b""))) == []


def damaged():
    record = warc.record(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    pack = zstandard.ZstdCompressor(write_checksum=True).compress
    yield pack(record)[:-6]
    yield pack(record) + b"junk"
    yield pack(record) + b"junk that is longer"
    yield pack(record.replace(b"WARC/1.1", b"WORC/1.1"))
    yield pack(re.sub(rb"Content-Length: \d+(\r\n\r\nHTTP)", rb"Content-Length: 91\1", record))
    yield pack(record.replace(b"WARC-Date: ", b"X-Date: "))
    yield pack(record.replace(b"payload\r", b"PAYLOAD\r"))
    yield pack(record[:-4])
    yield struct.pack("<II", warc.DICTIONARY_MAGIC, 1000) + b"x"
    yield struct.pack("<II", warc.FILLER_MAGIC, 10) + b"x"


@pytest.mark.parametrize("data", list(damaged()))
def test_damage_is_found(data):
    with pytest.raises((ValueError, zstandard.ZstdError)):
        for raw in warc.frames(memoryview(data)):
            warc.page_of(raw)


def test_damaged_file_fails_the_read(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(next(damaged()))
    with pytest.raises(Exception, match="a.warc.zst"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_other_records_are_skipped():
    info = warc._record_bytes(
        {"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:x>", "WARC-Date": "2024-01-01T00:00:00Z"}, b"software: x"
    )
    assert warc.page_of(info) is None


def test_empty_and_extra_columns(spark, root):
    warc.write_archives(spark.createDataFrame([], SCHEMA), root)
    assert warc.read_archives(spark, root).collect() == []
    other = scratch_folder(spark, "test")
    df = spark.createDataFrame([(1, "u", "<p>x</p>", 3, "y")], SCHEMA + ", first int, digest string")
    warc.write_archives(df, other)
    assert warc.read_archives(spark, other).count() == 1
