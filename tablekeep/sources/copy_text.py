"""Rows in dump text, in the COPY format: written by expressions, read back across file splits.

A block is a line ``COPY schema.table (a, b) FROM stdin;``, a line per row, and a line ``\\.``. Files are
read in segments (splits of plain files, members of gzip files) by tasks that do not see what stood before.
A segment maps the block that was open at its start to the one open at its end. Either none was,
and its lines are read from there; or one was, and all up to the first ``\\.`` are rows of it, which is
never a row itself, as backslashes in rows are doubled. So each segment is summed up for both cases, the
summaries of a file are put one after the other, and then every segment knows what it starts in.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby, islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablekeep.functions.hashing import column_of
from tablekeep.sources.listing import Stores
from tablekeep.sources.members import BATCH_LINES, MEMBER_BYTES, lines_at, stored_members, write_members

# tasks get these functions whole, as their workers need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the format: how NULL and the end of a block are written, and the letters that
# stand for characters after a backslash.
NULL, END = r"\N", r"\."
ESCAPES = {"\b": "b", "\f": "f", "\n": "n", "\r": "r", "\t": "t", "\v": "v"}
_OPEN = re.compile(r'COPY (.+?) \((.*)\) FROM stdin;\s*\Z')
_PLAIN = re.compile(r"[a-z_][a-z0-9_]*\Z")

SPLIT_KEYS = ["path", "start"]
SUMMARY = "path string, start long, closed string, ended boolean, later string"


def in_quotes(name: str) -> str:
    return name if _PLAIN.match(name) else '"' + name.replace('"', '""') + '"'


def header(schema_name: str, table_name: str, columns: Sequence[str]) -> str:
    table = f"{in_quotes(schema_name)}.{in_quotes(table_name)}"
    return f"COPY {table} ({', '.join(map(in_quotes, columns))}) FROM stdin;"


def _field(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.when(value, "t").otherwise("f")
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit(r"\\x"), F.lower(F.hex(value)))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        raise ValueError(f"COPY text holds no column of type {kind.simpleString()}")
    text = value.cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):  # Infinity and NaN are spelt alike
        return text
    if isinstance(kind, T.StringType):
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for sign, letter in ESCAPES.items():
            text = F.replace(text, F.lit(sign), F.lit("\\" + letter))
    return text


def copy_rows(df: DataFrame) -> DataFrame:
    """Each row as a line of COPY text, in a column ``value``."""
    fields = [
        F.when(column_of(f.name).isNull(), NULL).otherwise(_field(column_of(f.name), f.dataType))
        for f in df.schema.fields
    ]
    return df.select(F.concat_ws("\t", *fields).alias("value"))


def write_copy_text(
    df: DataFrame, path: str, schema_name: str, table_name: str, member_bytes: int = MEMBER_BYTES
) -> DataFrame:
    """Write a table as gzip dump files, each a block of its own; see ``members.write_members``."""
    opened = header(schema_name, table_name, df.columns)
    return write_members(copy_rows(df), path, member_bytes, opened, END)


def _after(state: str, line: str) -> str:
    """The block that is open after a line, '' if none is; only an end closes one."""
    if state:
        return "" if line == END else state
    return line.strip() if _OPEN.match(line) else ""


def _summary(lines: Iterable[str]) -> tuple[str, bool, str]:
    """What is open at a segment's end if nothing was at its start, and if a block was: False if that
    one still is, else True and what is open then."""
    closed, ended, later = "", False, ""
    for line in lines:
        if line != END and not line.startswith("COPY "):
            continue
        closed = _after(closed, line)
        later = _after(later, line) if ended else later
        ended = ended or line == END
    return closed, ended, later


def _summary_row(path: str, start: int, lines: Iterable[str]) -> pa.RecordBatch:
    arrays = [pa.array([x]) for x in (path, start, *_summary(lines))]
    return pa.record_batch(arrays, names=["path", "start", "closed", "ended", "later"])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summaries of segments given line by line."""
    lines = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    for (path, start), own in groupby(lines, key=lambda row: row[:2]):
        yield _summary_row(path, start, (line for *_, line in own))


def _member_summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summaries of members given by their places."""
    stores = Stores()
    for batch in batches:
        for path, start, length in zip(*[c.to_pylist() for c in batch.columns]):
            yield _summary_row(path, start, lines_at(stores, path, start, length))


def _composed(table: pa.Table) -> pa.Table:
    """What each segment of a file starts in, from the summaries of those before it."""
    rows, state = [], ""
    for row in sorted(table.to_pylist(), key=lambda r: r["start"]):
        rows.append((row["path"], row["start"], state))
        if not state:
            state = row["closed"]
        elif row["ended"]:
            state = row["later"]
    kinds = (pa.string(), pa.int64(), pa.string())
    arrays = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
    return pa.Table.from_arrays(arrays, names=["path", "start", "opened"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, state = None, ""
    for batch in batches:
        out: list[tuple[str, str]] = []
        for path, start, opened, line in zip(*[c.to_pylist() for c in batch.columns]):
            if (path, start) != at:
                at, state = (path, start), opened or ""
            if state and line != END:
                out.append((state, line))
            else:
                state = _after(state, line)
        if out:
            blocks, lines = (list(x) for x in zip(*out))
            yield pa.record_batch([pa.array(blocks), pa.array(lines)], names=["block", "value"])


def _member_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of members given by their places and the blocks that they start in."""

    def found(lines: Iterable[str], state: str) -> Iterator[tuple[str, str]]:
        for line in lines:
            if state and line != END:
                yield state, line
            else:
                state = _after(state, line)

    stores = Stores()
    for batch in batches:
        for path, start, length, opened in zip(*[c.to_pylist() for c in batch.columns]):
            rows = found(lines_at(stores, path, start, length), opened or "")
            while held := list(islice(rows, BATCH_LINES)):
                blocks, lines = (list(x) for x in zip(*held))
                yield pa.record_batch([pa.array(blocks), pa.array(lines)], names=["block", "value"])


def plain_lines(spark: SparkSession, prefix: str, pattern: str = "*.sql") -> DataFrame:
    """Lines of plain text files as (path, start, n, value): the split a line is in, and its order."""
    lines = spark.read.option("pathGlobFilter", pattern).text(prefix)
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("n"),
        "value",
    )


def block_rows(lines: DataFrame) -> DataFrame:
    """The rows of all COPY blocks, as (block, value): the line that opened it and the row's line.

    ``lines`` are (path, start, n, value), in order inside a task, as both readers give them. They
    are read twice: to sum up the segments, and to take the rows.
    """
    summed = lines.select(*SPLIT_KEYS, "value").mapInArrow(_summaries, SUMMARY)
    # every line has its start; an outer join keeps the lines, whose size is not known, from a broadcast
    known = lines.join(_starts(summed), SPLIT_KEYS, "left").sortWithinPartitions(*SPLIT_KEYS, "n")
    return known.select(*SPLIT_KEYS, "opened", "value").mapInArrow(_rows, "block string, value string")


def _starts(summed: DataFrame) -> DataFrame:
    return summed.groupBy("path").applyInArrow(_composed, "path string, start long, opened string")


def member_block_rows(index: DataFrame, parts: int) -> DataFrame:
    """:func:`block_rows` of gzip members, given as ``members.stored_members``.

    What a member starts in is joined to its place, and each member is read twice from there, so no
    line is shuffled.
    """
    places = index.select(*SPLIT_KEYS, "length")
    starts = _starts(places.repartition(parts, *SPLIT_KEYS).mapInArrow(_member_summaries, SUMMARY))
    known = places.join(starts, SPLIT_KEYS, "left").repartition(parts, *SPLIT_KEYS)
    return known.select(*SPLIT_KEYS, "length", "opened").mapInArrow(_member_rows, "block string, value string")


def _unescaped(field: Column) -> Column:
    """A field's text; a backslash before any other character stands for that character."""
    pieces = F.split(field, r"\\\\", -1)  # at doubled backslashes, which hide what follows them

    def plain(piece: Column) -> Column:
        for sign, letter in ESCAPES.items():
            piece = F.replace(piece, F.lit("\\" + letter), F.lit(sign))
        return F.replace(piece, F.lit("\\"), F.lit(""))

    return F.array_join(F.transform(pieces, plain), "\\")


def _value(field: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        value = field.isin("t", "true")
    elif isinstance(kind, T.BinaryType):
        value = F.unhex(F.substring(field, 4, 1 << 30))  # after a doubled backslash and x
    elif isinstance(kind, T.StringType):
        value = _unescaped(field)
    else:
        value = field.cast(kind)
    return F.when(field != NULL, value)


def table_of(rows: DataFrame, schema_name: str, table_name: str, schema: T.StructType) -> DataFrame:
    """The rows of one table out of ``block_rows``, with the columns of a schema.

    A block's own list says where a column is. One that does not hold all of them raises an error,
    when it is read.
    """
    qualified = f"{in_quotes(schema_name)}.{in_quotes(table_name)}"
    parts = F.regexp_extract("block", r"^COPY (.+?) \((.*)\) FROM stdin;", 1)
    names = F.split(F.regexp_extract("block", r"^COPY (.+?) \((.*)\) FROM stdin;", 2), ", ")
    own = rows.where(parts.isin(qualified, in_quotes(table_name))).select(
        names.alias("names"), F.split("value", "\t", -1).alias("fields")
    )

    def field(name: str) -> Column:
        place = F.array_position("names", F.lit(in_quotes(name)))
        missing = F.raise_error(F.lit(f"the dump of {table_name} has no column {name}"))
        return F.when(place == 0, missing.cast("string")).otherwise(F.get("fields", place - 1))

    return own.select(*[_value(field(f.name), f.dataType).alias(f.name) for f in schema.fields])


def read_copy_text(
    spark: SparkSession, prefix: str, schema_name: str, table_name: str, schema: T.StructType
) -> DataFrame:
    """A table out of gzip dump files, whatever else these hold."""
    rows = member_block_rows(*stored_members(spark, prefix))
    return table_of(rows, schema_name, table_name, schema)


