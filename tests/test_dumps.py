"""Dump text that many tasks read: gzip members, and rows in COPY blocks across splits."""

import gzip
import random
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablekeep.sources import copy_text, files, members
from tablekeep.sources.artifacts import dump_lines
from tablekeep.sources.copy_text import block_rows, copy_rows, plain_lines, read_copy_text, table_of, write_copy_text
from tablekeep.sources.members import member_lines, write_members
from tests.conftest import rows


def bag(df):
    return Counter(repr(tuple(r)) for r in df.collect())


def test_one_file_is_read_by_many_tasks(spark, root, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("value"))
    done = write_members(lines.coalesce(1), f"{root}/dump", member_bytes=20_000)
    assert done.count() == 1 and done.first()["members"] > 8
    found = member_lines(spark, f"{root}/dump")
    assert bag(found.select("value")) == bag(lines)
    readers = found.select(F.spark_partition_id()).distinct().count()
    assert readers > 4
    whole = gzip.open(f"{root}/dump/{found.first()['name']}").read().decode()
    assert whole == "".join(f"{r[0]}\n" for r in lines.collect())


def test_lines_keep_their_order(spark, root):
    lines = spark.range(5000).selectExpr("concat(id, repeat('x', id % 50)) AS value")
    write_members(lines.coalesce(1), f"{root}/d", member_bytes=3000)
    found = member_lines(spark, f"{root}/d").orderBy("start", "n")
    assert [r["value"] for r in found.collect()] == [r[0] for r in lines.collect()]


def test_other_gzip_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"one\ntwo\r\nthree"))
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"x\n") + gzip.compress(b"y\n") + b"\0" * 100)
    (tmp_path / "c.gz").write_bytes(b"")
    (tmp_path / "d.gz").write_bytes(members.member(b"p\n") + gzip.compress(b"q\n\nr"))
    found = rows(member_lines(spark, str(tmp_path)).select("name", "value"))
    assert found == [
        ("a.gz", "one"), ("a.gz", "three"), ("a.gz", "two"), ("b.gz", "x"), ("b.gz", "y"),
        ("d.gz", ""), ("d.gz", "p"), ("d.gz", "q"), ("d.gz", "r"),
    ]
    assert dump_lines(spark, str(tmp_path), "*.gz").count() == 9


def test_damaged_members_are_errors(spark, tmp_path):
    whole = members.member(b"some text\n" * 1000)
    (tmp_path / "a.gz").write_bytes(whole[:-20])
    with pytest.raises(Exception, match="ends inside"):
        member_lines(spark, str(tmp_path)).collect()
    (tmp_path / "a.gz").write_bytes(whole[:60] + bytes([whole[60] ^ 255]) + whole[61:])
    with pytest.raises(Exception):
        member_lines(spark, str(tmp_path)).collect()


def test_a_task_that_fails_leaves_no_file(spark, root):
    bad = spark.range(10).selectExpr("IF(id = 9, raise_error('no'), 'x') AS value")
    with pytest.raises(Exception):
        write_members(bad, f"{root}/d")
    assert member_lines(spark, root, recursive=True).count() == 0
    assert write_members(spark.range(0).selectExpr("'x' AS value"), f"{root}/e").count() == 0


SCHEMA = (
    "i int, s string, d double, f float, b boolean, t timestamp_ntz, y date, n decimal(20,5),"
    " r binary, `A b` string"
)
AWKWARD = [
    (1, "a\tb\nc\\d\r\v\f\b", 0.1, 1.5, True, datetime(2024, 1, 2, 3, 4, 5, 678), date(1999, 1, 1),
     Decimal("1.5"), b"\x00\\", "\\N"),
    (None,) * 10,
    (2, "", -1e300, float("inf"), False, None, None, None, b"", "\\."),
    (3, "COPY s.t (a) FROM stdin;", 5e-324, float("nan"), None, None, None, None, None, "\\\\n\\t"),
    (4, "\\.", 1e22, 0.0, None, None, None, None, None, "N"),
    (5, "日本 \u2028 \x85 ü", 123456789.125, None, None, None, None, None, None, "\\"),
]


@pytest.mark.parametrize("member_bytes", [1, 60, 1 << 20])
def test_awkward_values_come_back(spark, root, member_bytes):
    df = spark.createDataFrame(AWKWARD * 5, SCHEMA).coalesce(2)
    write_copy_text(df, f"{root}/dump", "My", "t", member_bytes)
    assert bag(read_copy_text(spark, f"{root}/dump", "My", "t", df.schema)) == bag(df)


def test_rows_that_look_like_blocks_and_blocks_across_members(spark, root):
    """Rows are lines of other dumps; members hold a line or two, so most of them begin inside a block."""
    texts = ["COPY a.b (x) FROM stdin;", "\\.", "x", "COPY a.b (x) FROM stdin;", "\\N", ""]
    one = spark.createDataFrame([(t,) for t in texts * 20], "x string").coalesce(1)
    two = spark.createDataFrame([(str(i),) for i in range(50)], "x string").coalesce(1)
    lines = []
    for table, df in (("b", one), ("c", two), ("b", two)):
        lines += [copy_text.header("a", table, ["x"]), *[r[0] for r in copy_rows(df).collect()], "\\.", "", "-- end"]
    for n, size in enumerate((1, 30, 100, 10_000)):
        dump = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
        write_members(dump, f"{root}/{n}", size)
        assert bag(read_copy_text(spark, f"{root}/{n}", "a", "b", one.schema)) == bag(one.unionAll(two))
        assert bag(read_copy_text(spark, f"{root}/{n}", "a", "c", one.schema)) == bag(two)
        assert read_copy_text(spark, f"{root}/{n}", "a", "none", one.schema).isEmpty()


def test_plain_files_in_splits(spark, tmp_path):
    pick = random.Random(4)
    values = ["".join(pick.choice("ab\\\t\n") for _ in range(pick.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    text = "\n".join([copy_text.header("s", "t", ["i", "v"]), *[r[0] for r in copy_rows(df).collect()], "\\.", ""])
    (tmp_path / "a.sql").write_text(text + "-- more\n" + text)
    (tmp_path / "b.sql").write_text("SELECT 1;\n" * 300 + text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = plain_lines(spark, str(tmp_path))
        assert lines.select("path", "start").distinct().count() > 10
        found = table_of(block_rows(lines), "s", "t", df.schema)
        assert bag(found) == bag(df.unionAll(df).unionAll(df))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_columns_by_name(spark, root):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    write_copy_text(df, f"{root}/d", "s", "t")
    other = df.select("s", "i")
    assert rows(read_copy_text(spark, f"{root}/d", "s", "t", other.schema)) == rows(other)
    with pytest.raises(Exception, match="no column z"):
        read_copy_text(spark, f"{root}/d", "s", "t", df.withColumnRenamed("i", "z").schema).collect()
    with pytest.raises(ValueError, match="no column of type"):
        write_copy_text(df.select(F.array("i").alias("a")), f"{root}/e", "s", "t")


def test_lines_are_not_taken_for_as_small_as_their_places(spark, root):
    """The places of a few members are small, their text is not: only places may be joined by broadcast."""
    df = spark.range(60_000).selectExpr("id AS i", "repeat('x', 1200) AS s").coalesce(1)
    write_copy_text(df, f"{root}/d", "s", "t", member_bytes=1 << 16)
    found = read_copy_text(spark, f"{root}/d", "s", "t", df.schema)
    size = spark.conf.get("spark.sql.maxBroadcastTableSize", "8GB")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "64MB")
    try:
        assert found.selectExpr("count(*)", "sum(i)", "sum(length(s))").first()[:] == (60_000, 1_799_970_000, 72_000_000)
        lines = block_rows(member_lines(spark, f"{root}/d").drop("name"))
        assert lines.selectExpr("count(*)", "count(DISTINCT value)").first()[:] == (60_000, 60_000)
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", size)


def test_one_file_is_written_by_many_tasks(spark, root):
    lines = spark.range(0, 5000, 1, 7).selectExpr("concat(id, repeat('x', id % 50)) AS value").where("length(value) > 1")
    done = write_members(lines, f"{root}/d", member_bytes=3000, one_file=True).collect()
    assert [p["path"] for p in done] == [f"{root}/d/{n}" for n in files.children(spark, f"{root}/d")]
    text = "".join(f"{r[0]}\n" for r in lines.collect())
    assert gzip.open(files.local_path(spark, done[0]["path"])).read().decode() == text
    assert done[0]["text_bytes"] == len(text) and done[0]["members"] > 7
    found = member_lines(spark, f"{root}/d").orderBy("start", "n")
    assert [r["value"] for r in found.collect()] == [r[0] for r in lines.collect()]
    assert write_members(lines.where("false"), f"{root}/e", one_file=True).isEmpty()
