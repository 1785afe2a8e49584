"""SimHash near-duplicates: every pair of fingerprints within a few bits, by bit-sliced comparison.

Two fingerprints that differ in at most r bits agree in all but r of the blocks the bits are cut
into. With r + 2 blocks they agree in two whole blocks at least, so each distinct fingerprint is
filed under every pair of blocks, and only fingerprints filed together are compared. Files with
more than ``unit`` fingerprints are cut into parts and the parts compared two by two, each pair of
parts as a unit of its own, so that no task gets a large file whole.

A unit is compared vertically. Bit b of its candidates is one bit plane, 64 candidates a word. The
planes in which a candidate differs from a query are added up for 64 candidates at a time by
carry-save counters, and the words of a query are abandoned once all of their candidates are beyond
the radius. A unit returns a forest that connects what it has linked, not all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tablekeep.llm.common import col, settled, slices, text_column
from tablekeep.llm.components import component_labels

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
UNIT = 4096
COMPARED = 1 << 15  # pairs of a query and a word that go through the planes together
TEXT_BYTES = 1 << 20  # of texts whose shingles are hashed together
GATHERED = 1 << 14  # fingerprints of units that are compared together


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    return int(_fingerprints([text], shingle)[0])


def _fingerprints(texts: list[str], shingle: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z; 20, 09 to 0D
        if not words:
            continue
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        n = max(1, len(words) - shingle + 1)
        counts[i] = n
        first, last = (ends - sizes)[:n].tolist(), ends[-n:].tolist()
        hashes += [digest(joined[a:b], SEED) for a, b in zip(first, last)]
    result = np.zeros(len(texts), np.uint64)
    if hashes:
        bits = np.unpackbits(
            np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        )
        full = np.flatnonzero(counts)
        starts = np.cumsum(counts[full]) - counts[full]
        set_bits = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        over = (2 * set_bits > counts[full][:, None]).astype(np.uint8)
        result[full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return result


def fingerprints(
    docs: DataFrame, ident: str, text: str, shingle: int = SHINGLE, row_keys: bool = False
) -> DataFrame:
    """``id`` and ``fp`` (the fingerprint as a signed number) of each document.

    With ``row_keys`` also ``k1`` and ``k2``, see ``row_key``.
    """
    keys = row_key(docs, ident, text) if row_keys else []
    narrow = docs.select(col(docs, ident).alias("id"), *keys, col(docs, text).alias("t"))
    schema = narrow.drop("t").schema.add("fp", "long")
    at = len(narrow.columns) - 1

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, TEXT_BYTES):
            values = _fingerprints(text_column(batch, at).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(values.view(np.int64))], schema.names
            )

    return narrow.mapInArrow(hashed, schema)


def row_key(docs: DataFrame, ident: str, text: str) -> list:
    """128 bits of a document's id and text, as ``k1`` and ``k2``."""
    own = [col(docs, c) for c in (ident, text)]
    nulls = [c.isNull() for c in own]
    return [F.xxhash64(F.lit(n), *nulls, *own).alias(f"k{n}") for n in (1, 2)]


def block_masks(blocks: int, agree: int) -> list[int]:
    """For each choice of ``agree`` of the blocks the mask of their bits."""
    bounds = [BITS * i // blocks for i in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(bounds, bounds[1:])]
    return [sum(choice) for choice in combinations(own, agree)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def near_pairs(
    units: list[tuple[np.ndarray, np.ndarray]], radius: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per unit of (queries, candidates) the pairs that differ in ``radius`` bits at most.

    Returns the unit and the positions in its queries and candidates. All units go through the bit
    planes together: the candidates of a unit fill whole words of 64, and each of its queries is
    compared with each of its words. Counters of ones, twos, fours are carried from plane to plane;
    a (query, word) leaves when no candidate of the word can be within the radius any more.
    """
    words = np.array([-(-len(c) // 64) for _, c in units])
    first = np.cumsum(words) - words
    total = int(words.sum())
    padded = np.zeros(total * 64, np.uint64)
    real = np.zeros(total * 64, np.uint8)
    for (_, candidates), at in zip(units, (first * 64).tolist()):
        padded[at : at + len(candidates)] = candidates
        real[at : at + len(candidates)] = 1
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    planes = np.ascontiguousarray(planes).view(np.uint64)  # bit, word
    unreal = ~np.packbits(real, bitorder="little").view(np.uint64)
    queries = np.concatenate([q for q, _ in units])
    asked = np.array([len(q) for q, _ in units])
    owner = np.repeat(np.arange(len(units)), asked)
    own_words = words[owner]
    ends = np.cumsum(own_words)
    counters = max(1, radius.bit_length())
    limit = [(radius >> k) & 1 for k in range(counters)]
    everything = np.uint64(0xFFFFFFFFFFFFFFFF)
    found = [np.empty((3, 0), np.int64)]
    start = 0
    while start < len(queries):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + COMPARED, "right")))
        n = own_words[start:stop]
        q = np.repeat(np.arange(start, stop), n)
        w = first[owner[q]] + np.arange(len(q)) - np.repeat(ends[start:stop] - n - done, n)
        count = [np.zeros(len(q), np.uint64) for _ in range(counters)]
        beyond = unreal[w]
        for b in range(BITS):
            carry = planes[b][w] ^ (everything * ((queries[q] >> np.uint64(b)) & np.uint64(1)))
            for k in range(counters):
                count[k], carry = count[k] ^ carry, count[k] & carry
            beyond = beyond | carry
            if b % 8 == 7:
                beyond = beyond | _above(count, limit)
                alive = beyond != everything
                if not alive.all():
                    q, w, beyond = q[alive], w[alive], beyond[alive]
                    count = [c[alive] for c in count]
                if not len(q):
                    break
        if len(q):
            lanes = np.ascontiguousarray(~beyond).view(np.uint8).reshape(-1, 8)
            rows, lane = np.nonzero(np.unpackbits(lanes, axis=1, bitorder="little"))
            q, w = q[rows], w[rows]
            unit = owner[q]
            begin = np.cumsum(asked) - asked
            found.append(np.stack([unit, q - begin[unit], (w - first[unit]) * 64 + lane]))
        start = stop
    return tuple(np.concatenate(found, axis=1))


def _above(count: list[np.ndarray], limit: list[int]) -> np.ndarray:
    """The candidates whose count, read across the counters, is above the limit."""
    above = np.zeros_like(count[0])
    level = ~above
    for value, bit in zip(reversed(count), reversed(limit)):
        if bit:
            level = level & value
        else:
            above = above | (level & value)
            level = level & ~value
    return above


def near_links(
    prints: DataFrame, radius: int = RADIUS, blocks: int = 0, unit: int = UNIT
) -> DataFrame:
    """Links (``a``, ``b``) that connect all distinct fingerprints (``fp``) within the radius.

    Every pair within the radius is connected by links, directly or over others of its unit.
    ``blocks`` (radius + 2 by default) may be raised for very large inputs: of more blocks more
    must agree, which makes smaller files and more of them.
    """
    blocks = blocks or radius + 2
    masks = block_masks(blocks, blocks - radius)
    filed = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k"))
                for i, m in enumerate(masks)
            ]
        )
    )
    filed = prints.select("fp", filed.alias("f")).select("fp", "f.m", "f.k")
    sizes = filed.groupBy("m", "k").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = filed.join(settled(sizes, "simhash-files"), ["m", "k"])
    parts = F.ceil(F.col("n") / F.lit(unit)).cast("int")
    crowded = crowded.withColumn("parts", parts).withColumn(
        "p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    )
    crowded = crowded.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    crowded = crowded.select(
        "fp", "m", "k", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "p"
    )
    spread = crowded.repartition("m", "k", "i", "j").sortWithinPartitions("m", "k", "i", "j")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _gathered(_units(batches)):
            links = _compared(group, radius)
            if links:
                a, b = zip(*links)
                yield pa.record_batch(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
                )

    return spread.mapInArrow(linked, "a long, b long").distinct()


def _gathered(units: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Units, some at a time."""
    held, size = [], 0
    for unit in units:
        held.append(unit)
        size += len(unit)
        if size >= GATHERED:
            yield held
            held, size = [], 0
    if held:
        yield held


def _compared(units: list[np.ndarray], radius: int) -> list[tuple[int, int]]:
    """Links of the units' forests; rows of a unit: fingerprint, file, file, part, part, own part."""
    sides = []
    for rows in units:
        if rows[0, 3] == rows[0, 4]:
            sides.append((rows[:, 0], rows[:, 0]))
        else:
            first = rows[:, 5] == rows[0, 3]
            sides.append((rows[first, 0], rows[~first, 0]))
    where, x, y = near_pairs([(np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)) for a, b in sides], radius)
    links = []
    cuts = np.searchsorted(where, np.arange(len(units) + 1))
    for i in np.unique(where).tolist():
        a, b = sides[i]
        part = slice(cuts[i], cuts[i + 1])
        one, two = a[x[part]], b[y[part]]
        different = one != two
        if different.any():
            links += _forest(one[different].tolist(), two[different].tolist())
    return links


def _forest(one: list[int], two: list[int]) -> list[tuple[int, int]]:
    """Links from each linked number to the root of its tree, which is the smallest of the tree."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (above := parent.setdefault(i, i)) != i:
            parent[i] = parent[above]
            i = parent[i]
        return i

    for a, b in zip(one, two):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [(root(i), i) for i in list(parent) if root(i) != i]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The runs of at least two rows of one unit, which lie together."""
    held = np.empty((0, 6), np.int64)
    for batch in batches:
        columns = [batch.column(n).to_numpy() for n in ("fp", "m", "k", "i", "j", "p")]
        rows = np.concatenate([held, np.column_stack([c.astype(np.int64) for c in columns])])
        if not len(rows):
            continue
        cuts = np.flatnonzero((rows[1:, 1:5] != rows[:-1, 1:5]).any(axis=1)) + 1
        *whole, held = np.split(rows, cuts)
        yield from (np.ascontiguousarray(unit) for unit in whole if len(unit) > 1)
    if len(held) > 1:
        yield np.ascontiguousarray(held)


def near_duplicates(
    docs: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    blocks: int = 0,
    unit: int = UNIT,
) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    A component holds the documents whose fingerprints can be reached over steps of at most
    ``radius`` bits; its id is the smallest document id in it, null only if it has none. Texts
    without words (empty or null ones) have fingerprint zero and are linked like any other. Texts
    of fewer than ``shingle`` words are one shingle. Documents of one fingerprint are compared as
    one, so copies cost nothing; rows of equal ids are documents of their own.
    """
    prints = settled(fingerprints(docs, ident, text, shingle), "simhash")
    return prints.join(_components(prints, radius, blocks, unit), "fp").select(
        F.col("id").alias(ident),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def _components(prints: DataFrame, radius: int, blocks: int, unit: int) -> DataFrame:
    """``component_id`` and ``root`` (its smallest fingerprint) of each fingerprint ``fp``."""
    nodes = settled(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    links = near_links(nodes.select("fp"), radius, blocks, unit)
    labels = component_labels(links)
    roots = nodes.join(labels, nodes.fp == labels.node, "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("root")
    )
    roots = settled(roots, "simhash-roots")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select("fp", "root", "component_id")
    return settled(named, "simhash-components")


def drop_near_duplicates(
    docs: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    blocks: int = 0,
    unit: int = UNIT,
) -> DataFrame:
    """One document of each component of ``near_duplicates``: that of the smallest id.

    Null ids come last; of different texts with that id the one of the smallest hash stays, and of
    rows equal in id and text one. All columns are kept; texts are shuffled once.
    """
    prints = settled(fingerprints(docs, ident, text, shingle, row_keys=True), "simhash")
    named = _components(prints, radius, blocks, unit).select("fp", "root")
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "k1", "k2")).alias("row")
    kept = prints.join(named, "fp").groupBy("root").agg(first).select("row.k1", "row.k2")
    names = docs.columns
    keys = [f"c{i}" for i in range(len(names))]
    keyed = docs.select(*[col(docs, n).alias(k) for n, k in zip(names, keys)], *row_key(docs, ident, text))
    keyed = keyed.join(settled(kept, "simhash-kept"), ["k1", "k2"])
    same = Window.partitionBy("k1", "k2").orderBy("k1")
    keyed = keyed.withColumn("copy", F.row_number().over(same)).filter("copy = 1")
    return keyed.select(*keys).toDF(*names)
