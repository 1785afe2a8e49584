"""Proportional stratified interleaving: shards of equal row counts, each with the whole's mixture.

Rows are put in a seeded random order within their stratum. Row r of a stratum of n rows has the
fractional rank (r + u) / n, where u in [0, 1) is drawn per stratum. In the order of the fractional
ranks every stretch holds each stratum in proportion, so the order is cut into equal stretches.

No stratum is ordered in one task. The random order is cut into buckets by the leading bits of its
hash, the fractional ranks by their value; both are even by construction, however uneven the strata
are, and a row's rank is the count of the buckets before its own plus its rank inside it. Only the
counts per bucket are gathered, whose number does not grow with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablekeep.llm.common import settled

BUCKETS = 4096


def _before(order: str, partition: list[str], value: str) -> Column:
    window = Window.partitionBy(*partition) if partition else Window.partitionBy()
    window = window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def assign_shards(
    rows: DataFrame, stratum: str, shards: int, seed: int = 42, buckets: int = BUCKETS
) -> DataFrame:
    """The rows with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in its shard).

    Shards differ by one row at most, and the rows of one stratum in two shards by two at most.
    Give the columns that identify a row, not whole texts: all of them are shuffled. A null stratum
    is a stratum of its own; null values elsewhere are values. Rows equal in every column are
    counted before they are ordered and get ranks one after the other. The result depends on the
    rows, the seed and the number of shards only. An empty frame gives an empty frame. Columns
    called ``shard`` or ``slot`` are replaced.
    """
    if shards < 1 or buckets < 1:
        raise ValueError("shards and buckets must be positive")
    rows = rows.drop("shard", "slot")
    names = rows.columns
    keys = [f"c{i}" for i in range(len(names))]
    at = {n: k for n, k in zip(names, keys)}
    plain = rows.toDF(*keys)
    counted = plain.groupBy(*keys).agg(F.count("*").alias("copies"))
    order = F.xxhash64(F.lit(seed), *keys)
    # a null and an empty stratum stay apart
    group = F.coalesce(F.concat(F.lit("v"), F.col(at[stratum]).cast("string")), F.lit("n"))
    counted = settled(
        counted.withColumn("h", order)
        .withColumn("s", group)
        .withColumn("b", F.pmod(F.shiftrightunsigned("h", 32), F.lit(buckets)).cast("int")),
        "shard-rows",
    )

    totals = counted.groupBy("s", "b").agg(F.sum("copies").alias("held"))
    totals = totals.select(
        "s",
        "b",
        _before("b", ["s"], "held").alias("earlier"),
        F.sum("held").over(Window.partitionBy("s")).alias("n"),
    )
    inside = Window.partitionBy("s", "b").orderBy("h", *keys)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("inner", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    start = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "s"), 12) / F.lit(float(1 << 52))
    ranked = (
        ranked.join(totals, ["s", "b"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("r", F.col("earlier") + F.col("inner") + F.col("copy"))
        .withColumn("f", (F.col("r") + start) / F.col("n"))
        .withColumn("g", F.least(F.floor(F.col("f") * buckets), F.lit(buckets - 1)).cast("int"))
        .select(*keys, "s", "r", "f", "g")
    )
    ranked = settled(ranked, "shard-ranks")

    spans = ranked.groupBy("g").agg(F.count("*").alias("held"))
    spans = spans.select(
        "g",
        _before("g", [], "held").alias("earlier"),
        F.sum("held").over(Window.partitionBy()).alias("n"),
    )
    inside = Window.partitionBy("g").orderBy("f", "s", "r")
    placed = ranked.withColumn("inner", F.row_number().over(inside) - 1).join(spans, "g")
    position = F.col("earlier") + F.col("inner")
    placed = placed.withColumn("position", position).withColumn(
        "shard", F.expr(f"cast(position * {shards} div n as int)")
    )
    first = F.expr(f"(shard * n + {shards - 1}) div {shards}")
    placed = placed.withColumn("slot", (F.col("position") - first).cast("long"))
    return placed.select(*keys, "shard", "slot").toDF(*names, "shard", "slot")


def shard_rows(
    rows: DataFrame, stratum: str, shards: int, seed: int = 42, buckets: int = BUCKETS
) -> DataFrame:
    """Whole rows with ``shard`` and ``slot``, texts shuffled once.

    Shards are given out by a 128-bit digest of the row; equal rows take their slots in any order,
    as nothing tells them apart. Nested columns must be hashable by Spark (maps are not).
    """
    rows = rows.drop("shard", "slot")
    names = rows.columns
    keys = [f"c{i}" for i in range(len(names))]
    digest = [F.xxhash64(F.lit(n), *keys).alias(f"d{n}") for n in range(2)]
    digested = rows.toDF(*keys).select("*", *digest)
    narrow = digested.select("d0", "d1", F.col(keys[names.index(stratum)]).alias("stratum"))
    placed = assign_shards(narrow, "stratum", shards, seed, buckets).drop("stratum")
    same = Window.partitionBy("d0", "d1")
    placed = placed.withColumn("copy", F.row_number().over(same.orderBy("shard", "slot")))
    digested = digested.withColumn("copy", F.row_number().over(same.orderBy("d0")))
    joined = digested.join(placed, ["d0", "d1", "copy"])
    return joined.select(*keys, "shard", "slot").toDF(*names, "shard", "slot")
