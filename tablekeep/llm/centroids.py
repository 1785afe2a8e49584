"""Exact centroid clustering over blocks of a space-filling curve with zone maps.

Vectors are quantised to whole numbers, laid along a Hilbert curve through their principal axes and
cut into blocks of bounded size. A block keeps the least and greatest value of each component, its
box. For a block, a centroid is out if even its nearest corner of the box is farther than the
farthest corner of another one, or if the centroid nearest to the middle of the box is nearer all
over the box (the difference of two squared distances is linear, so its least value over a box is a
sum over the components). The vectors of the block are compared exactly with the centroids left.

The blocks are written once as a table, a row each, and read in every round. A round hands the driver
sums and counts of the centroids, whose size is the number of centroids times that of components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablekeep.llm.common import col, give_back, settled

FACTOR = 256
BLOCK = 512  # vectors in a block
AXES, AXIS_BITS = 8, 7  # of the curve: together below 63 bits
LARGEST = 1 << 62
HALF = 31  # sums are kept as two halves, so that they cannot overflow


def quantised(vectors: DataFrame, ident: str, vector: str, dim: int, factor: int) -> DataFrame:
    """``id``, ``v`` (little-endian 64-bit integers floor(factor * x)) of each vector that takes part.

    Left out are null vectors and those with another number of components, a null or one that is not
    finite. A component whose integer has more than 62 bits raises an error, as no sum could hold it.
    """
    narrow = vectors.select(
        col(vectors, ident).alias("id"), col(vectors, vector).cast("array<double>").alias("x")
    )
    kind = narrow.schema["id"].dataType.simpleString()

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            rows, packed = [], []
            for i, x in enumerate(lists):
                if not x.is_valid or len(x.values) != dim or x.values.null_count:
                    continue
                values = x.values.to_numpy(zero_copy_only=False)
                if not np.isfinite(values).all():
                    continue
                scaled = np.floor(factor * values)
                if (np.abs(scaled) >= LARGEST).any():
                    raise ValueError(f"components of vector {batch.column(0)[i]} are too large")
                rows.append(i)
                packed.append(scaled.astype("<i8").tobytes())
            ids = batch.column(0).take(pa.array(rows, pa.int32()))
            yield pa.record_batch([ids, pa.array(packed, pa.binary())], names=["id", "v"])

    return narrow.mapInArrow(converted, f"id {kind}, v binary")


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point on the Hilbert curve through a grid of ``2 ** bits`` cells an axis.

    The axes' bits are turned into the curve's, transposed, by undoing its rotations from the
    highest bit down; then they are interleaved.
    """
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(axes):
            turned = (x[i] & q) != 0
            swapped = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swapped)
            x[i] ^= swapped
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[axes - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            place = place << 1 | (x[i] >> level & 1)
    return place


def _matrix(packed: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), "<i8").reshape(len(packed), dim)


def _moments(found: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, means and covariances of all vectors; each task sends dim + 2 short rows."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((dim + 2, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim).astype(np.float64)
            sums[:dim] += x.T @ x
            sums[dim] += x.sum(axis=0)
            sums[dim + 1, :1] += len(x)
        i, j = np.divmod(np.arange(sums.size), dim)
        arrays = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums.ravel())]
        yield pa.record_batch(arrays, names=["i", "j", "s"])

    rows = found.select("v").mapInArrow(summed, "i int, j int, s double")
    total = np.zeros((dim + 2, dim))
    for i, j, s in rows.groupBy("i", "j").agg(F.sum("s")).collect():
        total[i, j] = s
    count = max(1.0, total[dim + 1, 0]) if dim else 1.0
    mean = total[dim] / count
    return int(count), mean, total[:dim] / count - np.outer(mean, mean)


def _blocks(found: DataFrame, dim: int) -> DataFrame:
    """The vectors along the curve as blocks: ``ids``, ``vs`` (joined) and ``n``."""
    spark = found.sparkSession
    kind = found.schema["id"].dataType.simpleString()
    _, mean, spread = _moments(found, dim)
    strength, axes = np.linalg.eigh(np.nan_to_num(spread))
    axes, strength = axes[:, ::-1][:, :AXES], strength[::-1][:AXES]
    width = np.sqrt(np.maximum(strength, 1e-9)) * 3  # the grid holds three deviations to each side

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                along = (_matrix(batch.column(1), dim) - mean) @ axes / width
                cells = np.clip((along + 1) * (1 << AXIS_BITS) / 2, 0, (1 << AXIS_BITS) - 1)
                place = pa.array(hilbert(cells.astype(np.int64), AXIS_BITS), pa.int64())
                yield pa.record_batch([*batch.columns, place], names=["id", "v", "place"])

    laid = found.mapInArrow(placed, f"id {kind}, v binary, place long")
    # rows of one place are told apart, so that copies of one vector fall into several parts
    laid = laid.withColumn("apart", F.xxhash64(F.monotonically_increasing_id()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = laid.repartitionByRange(parts, "place", "apart").sortWithinPartitions("place", "apart")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []

        def block():
            return pa.record_batch(
                [
                    pa.array([ids[:BLOCK]], pa.list_(id_type)),
                    pa.array([b"".join(vectors[:BLOCK])], pa.binary()),
                ],
                names=["ids", "vs"],
            )

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            ids += batch.column(0).to_pylist()
            vectors += batch.column(1).to_pylist()
            while len(ids) >= BLOCK:
                yield block()
                del ids[:BLOCK], vectors[:BLOCK]
        if ids:
            yield block()

    return laid.select("id", "v").mapInArrow(cut, f"ids array<{kind}>, vs binary")


def _room(a: np.ndarray, b: np.ndarray) -> type:
    """The type in which squared distances of these whole numbers are exact."""
    largest = int(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    return np.int64 if 16 * largest * largest * a.shape[-1] < 2**62 else object


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest, or tie for it, to a vector inside a box."""
    kind = _room(np.stack([low, high]), centroids)
    low, high, c = low.astype(kind), high.astype(kind), centroids.astype(kind)
    gap = np.maximum(np.maximum(low - c, c - high), 0)
    reach = np.maximum(abs(c - low), abs(c - high))
    left = np.flatnonzero((gap * gap).sum(axis=1) <= (reach * reach).sum(axis=1).min())
    middle = c[left] * 2 - (low + high)
    best = left[(middle * middle).sum(axis=1).argmin()]
    # |x - c|^2 - |x - best|^2 = |c|^2 - |best|^2 - 2 x (c - best), least at a corner of the box
    own, apart = c[left], c[left] - c[best]
    corner = np.where(apart > 0, high, low)
    least = (own * own).sum(axis=1) - (c[best] * c[best]).sum() - 2 * (corner * apart).sum(axis=1)
    return left[(least <= 0).astype(bool)]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector of a block, the smaller of equals, and the
    squared distance."""
    left = candidates(vectors.min(axis=0), vectors.max(axis=0), centroids)
    own = centroids[left]
    largest = int(max(np.abs(vectors).max(initial=0), np.abs(own).max(initial=0)))
    if 4 * largest * largest * vectors.shape[1] < 2**53:  # products of doubles are exact
        x, c = vectors.astype(np.float64), own.astype(np.float64)
        apart = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (x @ c.T)
    else:
        kind = _room(vectors, own)
        x, c = vectors.astype(kind), own.astype(kind)
        apart = np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)
    at = apart.argmin(axis=1)
    found = apart[np.arange(len(apart)), at]
    if found.dtype == object and max(found) >= 2**63:
        raise OverflowError("a squared distance does not fit 64 bits")
    return left[at], found.astype(np.int64)


def _moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of exact means, or as they were if no vector is theirs."""
    dim = centroids.shape[1]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.zeros((len(centroids), dim + 1), np.int64)
        low = np.zeros_like(high)
        for batch in batches:
            for packed in batch.column(0):
                x = np.frombuffer(packed.as_buffer(), "<i8").reshape(-1, dim)
                number, _ = nearest(x, centroids)
                order = np.argsort(number, kind="stable")
                own, starts = np.unique(number[order], return_index=True)
                x = x[order]
                high[own, :dim] += np.add.reduceat(x >> HALF, starts, axis=0)
                low[own, :dim] += np.add.reduceat(x & ((1 << HALF) - 1), starts, axis=0)
                low[:, dim] += np.bincount(number, minlength=len(centroids))
        some = np.flatnonzero(low[:, dim].repeat(dim + 1))
        number, place = np.divmod(some, dim + 1)
        yield pa.record_batch(
            [
                pa.array(number.astype(np.int32)),
                pa.array(place.astype(np.int32)),
                pa.array(high.ravel()[some]),
                pa.array(low.ravel()[some]),
            ],
            names=["number", "place", "high", "low"],
        )
        give_back()

    rows = blocks.select("vs").mapInArrow(summed, "number int, place int, high long, low long")
    wide = "decimal(38,0)"
    total = rows.groupBy("number", "place").agg(
        F.sum(F.col("high").cast(wide)), F.sum(F.col("low").cast(wide))
    )
    sums = np.zeros((len(centroids), dim + 1), object)
    for number, place, high, low in total.collect():
        sums[number, place] = (int(high) << HALF) + int(low)
    out = centroids.copy()
    for number, row in enumerate(sums):
        if row[dim]:
            out[number] = [int(s) // int(row[dim]) for s in row[:dim]]
    return out


def cluster(
    vectors: DataFrame,
    clusters: int = 40,
    rounds: int = 5,
    dim: int = 64,
    ident: str = "vec_id",
    vector: str = "embedding",
    factor: int = FACTOR,
    seed: str = "2:",
) -> DataFrame:
    """Per vector the id, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256``.

    The first centroids are the vectors of smallest SHA-256 of ``seed`` and id (a null id: seed
    alone), equal ids by their components; with fewer vectors than ``clusters`` all of them. Rows
    stand by themselves, so repeated rows count as often as they occur. See ``quantised`` for rows
    that take no part. Ties go to the smaller number, an empty cluster keeps its centroid. No
    vectors give no rows. Distances or inertias beyond 64 bits raise an error.
    """
    spark = vectors.sparkSession
    found = settled(quantised(vectors, ident, vector, dim, factor), "centroids-vectors")
    kind = found.schema["id"].dataType.simpleString()
    named = F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))
    first = found.orderBy(F.sha2(named.cast("binary"), 256), "v").limit(clusters).select("v").collect()
    if not first:
        return spark.createDataFrame([], _result(ident, kind))
    centroids = np.stack([np.frombuffer(bytes(r.v), "<i8") for r in first])
    blocks = settled(_blocks(found, dim), "centroids-blocks")
    for _ in range(rounds):
        centroids = _moved(blocks, centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, packed in zip(batch.column(0), batch.column(1)):
                x = np.frombuffer(packed.as_buffer(), "<i8").reshape(-1, dim)
                number, distance = nearest(x, centroids)
                yield pa.record_batch(
                    [ids.values, pa.array(number.astype(np.int32)), pa.array(distance)],
                    names=["id", "cluster", "distance"],
                )

    rows = settled(
        blocks.mapInArrow(assigned, f"id {kind}, cluster int, distance long"), "centroids-assigned"
    )
    wide = F.col("distance").cast("decimal(38,0)")
    sums = dict(rows.groupBy("cluster").agg(F.sum(wide)).collect())  # a row a cluster
    inertia = sum(sums.values(), Decimal(0))
    if inertia >= 2**63:
        raise OverflowError("the inertia does not fit 64 bits")
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    own = F.create_map(*[F.lit(x) for n, s in sums.items() for x in (n, int(s))])
    shown = F.create_map(*[F.lit(x) for n, d in enumerate(digests) for x in (n, d)])
    return rows.select(
        F.col("id").alias(ident),
        "cluster",
        "distance",
        own[F.col("cluster")].cast("long").alias("cluster_inertia"),
        F.lit(int(inertia)).cast("long").alias("inertia"),
        shown[F.col("cluster")].alias("centroid_sha256"),
    )


def _result(ident: str, kind: str) -> str:
    return (
        f"`{ident.replace('`', '``')}` {kind}, cluster int, distance long, cluster_inertia long,"
        " inertia long, centroid_sha256 string"
    )
