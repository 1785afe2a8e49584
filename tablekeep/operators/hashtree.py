"""Hash trees of tables: fingerprints of buckets of keys, and of groups of buckets up to the root.

A row's bucket depends on its keys alone, so equal rows are in equal buckets. A node's fingerprint
is the sum of its rows' hashes, as that of a whole table is: nodes add up to their parents, and
the root is the table's own fingerprint. Two tables with equal nodes have the same rows below them,
so a comparison goes down only where nodes differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablekeep.functions.hashing import fingerprint_parts, portable_key_text, row_hash

BUCKETS, FAN = 256, 16
TREE = "level int, node bigint, row_count bigint, fingerprint decimal(38,0)"


def bucket_of(df: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    """The bucket of a row: the first 32 bits of the md5 of its keys' text, modulo ``buckets``.

    Other SQL engines can compute it. Without keys a row is its own key.
    """
    if not keys:
        return F.pmod(row_hash(df.schema, salt=2), F.lit(buckets)).cast("int")
    digest = F.md5(portable_key_text(df.schema, list(keys)))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def levels(buckets: int, fan: int = FAN) -> int:
    """How many levels a tree has above its buckets."""
    above = 0
    while buckets > 1:
        buckets, above = -(-buckets // fan), above + 1
    return above


def tree(leaves: DataFrame, buckets: int, fan: int = FAN) -> DataFrame:
    """All nodes from the leaves (``node``, ``row_count``, ``fingerprint``), level 0, to the root."""
    ways = [
        F.struct(F.lit(level).alias("level"), F.floor(F.col("node") / fan**level).alias("node"))
        for level in range(levels(buckets, fan) + 1)
    ]
    nodes = leaves.select(F.explode(F.array(*ways)).alias("at"), "row_count", "fingerprint")
    return nodes.groupBy("at.level", "at.node").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("fingerprint").cast("decimal(38,0)").alias("fingerprint"),
    )


def leaves(df: DataFrame, bucket: str) -> DataFrame:
    """The fingerprint of each bucket of a table, whose column ``bucket`` does not count."""
    plain = df.drop(bucket)
    hashed = df.select(F.col(bucket).cast("bigint").alias("node"), row_hash(plain.schema).alias("hash64"))
    return hashed.groupBy("node").agg(*fingerprint_parts(F.col("hash64")))


def different_buckets(old: DataFrame, new: DataFrame, buckets: int, fan: int = FAN) -> list[int]:
    """The buckets whose fingerprints differ, found from the root down.

    Of each level only the children of differing nodes are read. The list is no longer than the
    number of buckets.
    """
    both = old.withColumn("side", F.lit(0)).unionAll(new.withColumn("side", F.lit(1)))
    wanted: set[int] = {0}
    for level in range(levels(buckets, fan), -1, -1):
        first, last = min(wanted), max(wanted) + 1
        if level < levels(buckets, fan):
            first, last = first * fan, last * fan
        nodes = both.where((F.col("level") == level) & F.col("node").between(first, last - 1))
        seen: dict[int, dict] = {}
        for row in nodes.collect():
            seen.setdefault(row["node"], {})[row["side"]] = (row["row_count"], row["fingerprint"])
        apart = {n for n, sides in seen.items() if sides.get(0) != sides.get(1)}
        if level < levels(buckets, fan):
            apart = {n for n in apart if n // fan in wanted}
        if not apart:
            return []
        wanted = apart
    return sorted(wanted)
