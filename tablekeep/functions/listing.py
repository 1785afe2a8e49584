"""Listing lines: date, time, size and name, separated by blanks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablekeep.functions.times import parse_listing_time

# Fixed value: shape of a listing line. The name is the rest of the line, so
# names with blanks stay whole.
LINE_PATTERN = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\s+(\d+)\s+(\S.*)$"


# Fixed value: what does not count around a listing or a line.
SPACE = " \t\n\r\x0b\x0c"


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE))


def split_lines(text: Column) -> Column:
    """Lines of a whole listing held in one value; white space around it does not count."""
    return F.split(trimmed(text), "\n")


def fields(line: Column) -> Column:
    """Whitespace-separated fields of a line."""
    return F.split(trimmed(line), r"\s+")


def is_blank(line: Column) -> Column:
    return F.coalesce(trimmed(line), F.lit("")) == F.lit("")


def parse_line(line: Column) -> Column:
    """Struct ``(name, modified_at, size_bytes)``, its fields NULL on any other text."""

    def part(group: int) -> Column:
        return F.regexp_extract(line, LINE_PATTERN, group)

    return F.struct(
        F.nullif(part(3), F.lit("")).alias("name"),
        parse_listing_time(part(1)).alias("modified_at"),
        F.nullif(part(2), F.lit("")).try_cast("bigint").alias("size_bytes"),
    )
