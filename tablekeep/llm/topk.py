"""Exact top-k inner products, pruned by segment statistics from coarse to fine.

Cut two vectors into segments of l components each. With the segment means m and deviations s, their
squared distance is at least sum l ((m1 - m2)^2 + (s1 - s2)^2), hence their inner product at most
sum l (m1 m2 + s1 s2). One segment gives a coarse bound, more and shorter ones a finer bound. A
candidate whose bound is below the k-th best score known of a query is out; the survivors of the
finest level are scored exactly, with Python's integers where 64 bits could overflow.

Queries and candidates are cut into blocks of bounded size, and each pair of blocks is a unit of
work. Candidate blocks are taken in rounds of doubling size: the k-th best scores of earlier rounds
prune the later ones, so a round hands on a few rows a query, however many candidates there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablekeep.llm.common import col, settled

SEGMENTS = (1, 4, 16, 32)
CANDIDATES = 8192  # in a block
QUERIES, LEAST_QUERIES = 2048, 256  # in a block: at most, and at least where cores would be idle
TILE = 128  # queries compared at once
EXACT = 2.0**53  # whole numbers below are exact as doubles
BOUNDED = 2.0**400  # of a component whose statistics do not overflow


def finite(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """``row`` (a number of its own), ``id``, ``v`` (little-endian doubles) and ``dim`` of each vector
    that takes part: not those that are null or hold a component that is null or not finite."""
    narrow = vectors.select(
        col(vectors, ident).cast("long").alias("id"),
        col(vectors, vector).cast("array<double>").alias("x"),
    )

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, packed, dims = [], [], []
            for i, x in enumerate(batch.column(1)):
                if not x.is_valid or x.values.null_count:
                    continue
                values = x.values.to_numpy(zero_copy_only=False)
                if np.isfinite(values).all():
                    rows.append(i)
                    packed.append(values.astype("<f8").tobytes())
                    dims.append(len(values))
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(rows, pa.int32())),
                    pa.array(packed, pa.binary()),
                    pa.array(dims, pa.int32()),
                ],
                names=["id", "v", "dim"],
            )

    found = narrow.mapInArrow(converted, "id long, v binary, dim int")
    return found.select(F.monotonically_increasing_id().alias("row"), "*")


def whole(vectors: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(factor * x) as doubles, which may be infinite, and exactly: as 64-bit integers where
    that leaves room for sums of products, else as Python's."""
    with np.errstate(over="ignore"):
        real = np.floor(factor * vectors)
    if np.abs(real).max(initial=0) ** 2 * max(1, vectors.shape[1]) < 2.0**62:
        return real, real.astype(np.int64)
    exact = np.empty(vectors.shape, object)
    for i, x in enumerate(vectors.ravel().tolist()):
        # doubles from 2 ** 53 on are whole numbers
        exact.flat[i] = int(x) * factor if abs(x) >= EXACT else math.floor(Fraction(x) * factor)
    return real, exact


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Per vector the means and deviations of its segments, each times the root of its length.

    The product of two such rows is the upper bound of the vectors' inner product.
    """
    n, dim = vectors.shape
    bounds = np.unique(np.linspace(0, dim, min(segments, dim) + 1).astype(int))
    sizes = np.diff(bounds)
    sums = np.add.reduceat(vectors, bounds[:-1], axis=1)
    squares = np.add.reduceat(vectors * vectors, bounds[:-1], axis=1)
    means = sums / sizes
    deviations = np.sqrt(np.maximum(squares / sizes - means * means, 0))
    return np.hstack([means, deviations]) * np.tile(np.sqrt(sizes), 2)


def _scores(queries: np.ndarray, candidates: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs, in pieces that keep the gathered vectors small."""
    small = queries.dtype != object and candidates.dtype != object
    if small and len(q):
        largest = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0))
        small = largest * queries.shape[1] < 2**63
    if not small:
        out = np.empty(len(q), object)
        for i, (a, b) in enumerate(zip(q.tolist(), c.tolist())):
            out[i] = sum(map(mul, queries[a].tolist(), candidates[b].tolist()))
        return out
    out = np.empty(len(q), np.int64)
    for at in range(0, len(q), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = np.einsum("ij,ij->i", queries[q[part]], candidates[c[part]])
    return out


def _bounds(stat: np.ndarray, table: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The bounds of pairs, in pieces that keep the gathered statistics small."""
    out = np.empty(len(q))
    for at in range(0, len(q), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = np.einsum("ij,ij->i", stat[q[part]], table[c[part]])
    return out


def _promising(
    own: np.ndarray, candidates: np.ndarray, other: np.ndarray, bound: np.ndarray, k: int
) -> np.ndarray:
    """Per query the k-th best exact score among the candidates of the greatest bounds."""
    bound = np.where(other, bound, -np.inf)
    top = np.argpartition(bound, bound.shape[1] - k, axis=1)[:, -k:]
    q, c = np.repeat(np.arange(len(own)), k), top.ravel()
    exact = _scores(own, candidates, q, c).astype(np.float64)
    exact[~other[q, c]] = -np.inf
    return exact.reshape(len(own), k).min(axis=1)


def best_in_block(
    query_rows: np.ndarray,
    queries: np.ndarray,
    known: np.ndarray,
    rows: np.ndarray,
    ids: np.ndarray,
    candidates: np.ndarray,
    k: int,
    factor: int = 1,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of query, position of candidate, exact score) of the pairs that may be in a top ``k``.

    ``known`` is each query's k-th best score so far, or minus infinity. At most k pairs a query.
    """
    found: list[tuple] = []
    dim = queries.shape[1]
    real, candidates = whole(candidates, factor)
    asked, queries = whole(queries, factor)
    largest = np.abs(real).max(initial=0), np.abs(asked).max(initial=0)
    # products of doubles are exact as long as all sums are whole numbers below 2 ** 53
    exactly = max(largest) < EXACT and largest[0] * largest[1] * dim < EXACT
    levels = [s for s in SEGMENTS if s < 2 * dim] or [1]
    if not dim or max(largest) >= BOUNDED:  # every score is zero, or there are no bounds
        levels = []
    tables = [segment_statistics(real, s) for s in levels]
    stats = [segment_statistics(asked, s) for s in levels]
    slack = np.zeros(len(asked))
    if levels:  # what rounding may take from a bound or a score as a double, by the vectors' lengths
        lengths = np.sqrt((asked * asked).sum(axis=1))
        slack = (dim + 8) * 2.0**-50 * (lengths * np.sqrt((real * real).sum(axis=1)).max(initial=0) + 1)
    for start in range(0, len(queries), TILE):
        own = queries[start : start + TILE]
        tile = slice(start, start + len(own))
        other = query_rows[tile, None] != rows[None, :]
        least = known[tile] - slack[tile]
        alive, q, c = other, None, None
        for level, (stat, table) in enumerate(zip(stats, tables)):
            if q is None and np.count_nonzero(alive) * 16 < alive.size:
                q, c = np.nonzero(alive)
            if q is not None:  # few are left: pair by pair
                keep = _bounds(stat[tile], table, q, c) >= least[q]
                q, c = q[keep], c[keep]
                continue
            bound = stat[tile] @ table.T
            if level >= len(levels) - 2 and np.isinf(least).any() and len(rows) > k:
                best = _promising(own, candidates, other, bound, k) - slack[tile]
                least = np.maximum(least, best)
            alive = alive & (bound >= least[:, None])
        if q is None:
            q, c = np.nonzero(alive)
        if not exactly and levels and len(q) > k * len(own):  # only close ones need exact products
            rough = np.einsum("ij,ij->i", asked[tile][q], real[c]) if len(q) * dim < 1 << 22 else (
                asked[tile] @ real.T
            )[q, c]
            keep = rough >= least[q] - slack[tile][q]
            q, c = q[keep], c[keep]
        if exactly and len(q) * 16 > other.size:  # many survivors: all at once
            exact = (asked[tile] @ real.T)[q, c].astype(np.int64)
        else:
            exact = _scores(own, candidates, q, c)
        order = np.lexsort((rows[c], ids[c], q))
        if exact.dtype == object:
            values = exact.tolist()
            order = np.array(sorted(order.tolist(), key=lambda i: (q[i], -values[i])), np.int64)
        else:
            order = order[np.lexsort((-exact[order], q[order]))]
        q, c, exact = q[order], c[order], exact[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < k
        found.append((q[keep] + start, c[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    ident: str = "vec_id",
    vector: str = "embedding",
    factor: int = 64,
    candidates: int = CANDIDATES,
    queries: int | None = None,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the candidate's id and ``score`` of each query's best ``k``.

    ``is_query`` is a condition on the column ``id``. Every row is a candidate of all queries but
    itself, if its vector is of the same length; so rows that repeat an id, or an id and its vector,
    count each by itself, as queries (told apart by ``query_row``) and as candidates. Scores are
    exact inner products of floor(factor * x); ties go to the smaller id, a null id last. Ids are
    whole numbers. See ``finite`` for the vectors that take no part. A score of the result that fits
    no 64-bit integer raises an error that names the two ids. No vectors, or no queries, give no rows.
    """
    spark = vectors.sparkSession
    found = settled(finite(vectors, ident, vector), "topk-vectors")
    total = found.count()
    blocks = max(1, math.ceil(total / candidates))
    asked = found.filter(is_query)
    asking = asked.count()
    if queries is None:
        cores = spark.sparkContext.defaultParallelism
        queries = min(QUERIES, max(LEAST_QUERIES, math.ceil(asking / cores)))
    asked_blocks = max(1, math.ceil(asking / queries))
    spread = F.xxhash64(F.lit(7), "row")
    all_rows = found.withColumn("cb", F.pmod(spread, F.lit(blocks)).cast("int"))
    asked = asked.withColumn("qb", F.pmod(spread, F.lit(asked_blocks)).cast("int"))

    kinds = "row long, query_id long, id long, candidate long, score long"
    best = spark.createDataFrame([], kinds)
    first = 0
    while first < blocks:
        last = min(blocks, max(1, 2 * first))
        kth = best.groupBy("row").agg(
            F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least")
        )
        left = asked.join(kth, "row", "left").withColumn(
            "cb", F.explode(F.sequence(F.lit(first), F.lit(last - 1)))
        )
        right = all_rows.filter((F.col("cb") >= first) & (F.col("cb") < last)).withColumn(
            "qb", F.explode(F.sequence(F.lit(0), F.lit(asked_blocks - 1)))
        )
        units = left.select("qb", "cb", "dim", F.lit(0).alias("side"), "id", "row", "least", "v")
        units = units.unionByName(
            right.select(
                "qb", "cb", "dim", F.lit(1).alias("side"), "id", "row",
                F.lit(None).cast("double").alias("least"), "v",
            )
        )
        units = units.repartition("qb", "cb").sortWithinPartitions("qb", "cb", "dim", "side")
        pairs = units.mapInArrow(_searched(k, factor), kinds)
        merged = best.unionByName(pairs)
        order = Window.partitionBy("row").orderBy(
            F.desc("score"), F.col("id").asc_nulls_last(), "candidate"
        )
        merged = merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        if last >= blocks:
            return merged.select(
                "query_id",
                "rank",
                F.col("id").alias(ident),
                F.when(F.col("score") > LOWEST, F.col("score"))
                .otherwise(F.raise_error(_misfit("query_id", "id")))
                .alias("score"),
                F.col("row").alias("query_row"),
            )
        best = settled(merged.drop("rank"), "topk-best")
        first = last


LOWEST = -(1 << 63)  # stands for this score and all below


def _misfit(query: str, candidate: str) -> Column:
    text = F.concat(F.lit("the score of "), F.coalesce(F.col(query).cast("string"), F.lit("null")))
    other = F.coalesce(F.col(candidate).cast("string"), F.lit("null"))
    return F.concat(text, F.lit(" and "), other, F.lit(" does not fit 64 bits"))


def _searched(k: int, factor: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            sides = unit.column("side").to_numpy()
            asked = int((sides == 0).sum())
            if not asked or asked == len(sides):
                continue
            dim = unit.column("dim")[0].as_py()
            rows, ids = unit.column("row").to_numpy(), unit.column("id")
            data = b"".join(unit.column("v").to_pylist())
            vectors = np.frombuffer(data, "<f8").reshape(len(rows), dim)
            least = unit.column("least").slice(0, asked).fill_null(float("-inf"))
            q, c, scores = best_in_block(
                rows[:asked],
                vectors[:asked],
                least.to_numpy(zero_copy_only=False),
                rows[asked:],
                ids.slice(asked).fill_null((1 << 63) - 1).to_numpy(),
                vectors[asked:],
                k,
                factor,
            )
            if scores.dtype == object:
                for a, b, score in zip(q, c, scores):
                    if score >= 1 << 63:  # among the best in any case
                        raise OverflowError(
                            f"the score of {ids[int(a)]} and {ids[asked + int(b)]} does not fit 64 bits"
                        )
                scores = np.array([max(int(x), LOWEST) for x in scores], np.int64)
            yield pa.record_batch(
                [
                    pa.array(rows[q]),
                    ids.take(pa.array(q)),
                    ids.take(pa.array(c + asked)),
                    pa.array(rows[asked + c]),
                    pa.array(scores),
                ],
                names=["row", "query_id", "id", "candidate", "score"],
            )

    return searched


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one pair of blocks and one length of vectors, which lie together."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(n).to_numpy() for n in ("qb", "cb", "dim")])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist(), len(keys)]
        for a, b in zip(bounds, bounds[1:]):
            key = tuple(keys[a])
            if held and key != at:
                yield _joined(held)
                held = []
            at = key
            held.append(batch.slice(a, b - a))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts).combine_chunks()
    return table.to_batches()[0]
