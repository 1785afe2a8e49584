"""Artifacts on storage: file listings, listing text and dump text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablekeep.functions.listing import is_blank, parse_line, split_lines
from tablekeep.sources.listing import listing
from tablekeep.sources.members import member_lines


def _one_slash(path: Column) -> Column:
    """A local path as the file scan shows it: ``file:/x``, not ``file:///x``."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def list_files(
    spark: SparkSession, prefix: str, pattern: str | None = None, recursive: bool = False
) -> DataFrame:
    """Files below a prefix as (name, modified_at, size_bytes, path), empty ones included.

    Folders are listed side by side in tasks, see ``sources.listing``; no path
    goes through the driver, and conditions on names and times are tested there.
    """
    return listing(spark, prefix, pattern, recursive)


def lines_of(listing: DataFrame, column: str = "listing") -> DataFrame:
    """One row per line of whole listing texts."""
    return listing.select(F.explode(split_lines(F.col(column))).alias("line"))


def _is_whole(entry: Column) -> Column:
    return (
        entry["name"].isNotNull()
        & entry["modified_at"].isNotNull()
        & entry["size_bytes"].isNotNull()
    )


def parse_listing(lines: DataFrame, column: str = "line") -> DataFrame:
    """Every line with its outcome: ``parsed``, ``blank`` or ``malformed``.

    A line is parsed only when date, size and name are all there and valid.
    """
    outcome = (
        F.when(_is_whole(F.col("entry")), "parsed")
        .when(is_blank(F.col(column)), "blank")
        .otherwise("malformed")
    )
    return (
        lines.withColumn("entry", parse_line(F.col(column)))
        .withColumn("outcome", outcome)
        .select(*lines.columns, "outcome", "entry.*")
    )


def listed_artifacts(lines: DataFrame, column: str = "line") -> DataFrame:
    """The artifacts of a listing; other lines are left out.

    Written as an array of one or no entry to be unpacked: a plain filter would
    be pushed below the parsing and parse every line again.
    """
    entries = lines.select(F.array(parse_line(F.col(column))).alias("entries"))
    return entries.select(F.inline(F.filter("entries", _is_whole)))


def listing_report(lines: DataFrame, column: str = "line") -> DataFrame:
    """How many lines were parsed, blank and malformed."""
    return parse_listing(lines, column).groupBy("outcome").agg(F.count(F.lit(1)).alias("lines"))


def _decoded(uri: Column) -> Column:
    """A path as listings show it; a plus sign stands for itself."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def dump_lines(
    spark: SparkSession, prefix: str, pattern: str = "*.sql.gz", recursive: bool = False
) -> DataFrame:
    """Text of dump files, line by line, as (path, name, value).

    A gzip file is read by as many tasks as it has members that tell their length (see
    ``sources.members``), one that has none by one task; files are read side by side.
    """
    if pattern.endswith(".gz"):
        return member_lines(spark, prefix, pattern, recursive).select("path", "name", "value")
    reader = spark.read.option("pathGlobFilter", pattern)
    reader = reader.option("recursiveFileLookup", str(recursive).lower())
    return reader.text(prefix).select(
        _one_slash(_decoded(F.col("_metadata.file_path"))).alias("path"),
        _decoded(F.col("_metadata.file_name")).alias("name"),
        "value",
    )
