"""What changed: by statistics, by fingerprint, by row."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tablekeep.functions.hashing import column_of, free_name, row_hash
from tablekeep.functions.naming import qualified
from tablekeep.functions.times import moment

KEYS = ["schema_name", "table_name"]


def changed_since(table_stats: DataFrame, since: datetime | str) -> DataFrame:
    """Tables with either gather time strictly after ``since``.

    A missing time counts as no evidence: the row stays only if the other time
    is after ``since``.
    """
    after = moment(since)
    return table_stats.where(
        (F.col("last_analyze") > after) | (F.col("last_autoanalyze") > after)
    ).select("*", qualified(F.col("schema_name"), F.col("table_name")).alias("qualified_name"))


def changed_tables(current: DataFrame, base: DataFrame) -> DataFrame:
    """``new``, ``dropped``, ``changed`` or ``unchanged`` for every table of either side.

    Both sides hold one row per table: schema_name, table_name, row_count,
    fingerprint and, if both know it, schema_json. Hashes know no column names, so
    a renamed column shows in the schema only.
    """
    figures = ["row_count", "fingerprint"]
    if "schema_json" in current.columns and "schema_json" in base.columns:
        figures.append("schema_json")
        current = current.withColumn("schema_json", _shape(F.col("schema_json")))
        base = base.withColumn("schema_json", _shape(F.col("schema_json")))
    now = current.select(*KEYS, F.struct(*figures).alias("now"))
    old = base.select(*KEYS, F.struct(*figures).alias("old"))
    same = reduce(and_, [F.col(f"now.{f}") == F.col(f"old.{f}") for f in figures])
    return now.join(old, KEYS, "full_outer").select(
        *KEYS,
        F.when(F.col("old").isNull(), "new")
        .when(F.col("now").isNull(), "dropped")
        .when(same, "unchanged")
        .otherwise("changed")
        .alias("change"),
        F.col("old.row_count").alias("old_rows"),
        F.col("now.row_count").alias("new_rows"),
    )


def _shape(schema_json: Column) -> Column:
    """A schema without what does not matter: whether NULL is allowed, and metadata."""
    plain = F.regexp_replace(schema_json, r'"(nullable|containsNull|valueContainsNull)":\w+', "")
    return F.regexp_replace(plain, r'"metadata":\{[^{}]*\}', "")


def row_delta(old: DataFrame, new: DataFrame, method: str = "digest") -> DataFrame:
    """Rows inserted and deleted between two versions of a table, as bags.

    One row per distinct changed row: ``change`` and how many ``copies`` of it
    came or went; no key is needed.

    ``digest``, the default, reads both versions twice but shuffles only 128-bit
    digests and counts of rows; then only rows whose digest has an uneven count
    are compared by content. A changed row could be missed only if a different row
    with the same digest made up for it.

    ``content`` puts both versions whole through one aggregation: copies are
    counted before the shuffle, so a row held a billion times moves as one row per
    task, and whole rows spread over all partitions by content.
    """
    names = old.columns
    if set(names) != set(new.columns):
        raise ValueError("both versions must have the same columns")
    own = {k: free_name(names, k) for k in ("sign", "net")}
    both = old.select(*map(column_of, names), F.lit(-1).alias(own["sign"])).unionAll(
        new.select(*map(column_of, names), F.lit(1).alias(own["sign"]))
    )
    return net_changes(both, names, own["sign"], method)


def net_changes(signed: DataFrame, names: list[str], sign: str, method: str = "digest") -> DataFrame:
    """:func:`row_delta` of rows that a column says to be there so often, or to be missing."""
    own = {"sign": sign, **{k: free_name([*names, sign], k) for k in ("net", "d1", "d2")}}
    if method == "content":
        return _net_rows(signed, names, own)
    if method != "digest":
        raise ValueError("method is one of content, digest")
    schema = signed.select(*map(column_of, names)).schema
    digested = signed.withColumns({own["d1"]: row_hash(schema), own["d2"]: row_hash(schema, salt=1)})
    keys = [own["d1"], own["d2"]]
    uneven = digested.groupBy(*keys).agg(F.sum(own["sign"]).alias(own["net"]))
    uneven = uneven.where(F.col(own["net"]) != 0)
    return _net_rows(digested.join(uneven, keys, "left_semi"), names, own)


def _net_rows(signed: DataFrame, names: list[str], own: dict[str, str]) -> DataFrame:
    """Distinct rows whose signs do not add up to zero."""
    net = F.col(own["net"])
    return (
        signed.groupBy(*map(column_of, names))
        .agg(F.sum(own["sign"]).alias(own["net"]))
        .where(net != 0)
        .select(
            F.when(net > 0, "inserted").otherwise("deleted").alias("change"),
            F.abs(net).alias("copies"),
            *map(column_of, names),
        )
    )
