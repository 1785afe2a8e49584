"""Connected components of a graph given by its links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablekeep.llm.common import settled


def component_labels(links: DataFrame) -> DataFrame:
    """(``node``, ``label``) for each node of the links (``a``, ``b``): the smallest node reachable.

    Large and small stars by turns: each node's larger neighbours are handed to its smallest
    neighbour, then its smaller ones, until nothing changes. Nothing but two numbers a round comes
    to the driver; each round is written to the shared folder. A node with very many links is
    a skewed join key, which Spark splits, and its smallest neighbour is found by partial aggregates.
    """
    links = links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    links = settled(links.distinct(), "links")
    state = None
    while True:
        now = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if now == state or not now["n"]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
        state = now
        links = settled(_star(_star(links, large=True), large=False), "links")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round over links (larger ``a``, smaller ``b``)."""
    if large:
        pairs = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = links
    least = pairs.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("node"), F.least("a", "low").alias("low")
    )
    joined = pairs.join(least, pairs.a == least.node)
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
        moved = moved.unionByName(joined.select("a", F.col("low").alias("b")))
    return moved.filter("a <> b").distinct()
