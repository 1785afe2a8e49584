"""The trie of conversations' prefixes, rolled up by centroid decomposition.

A conversation is rebuilt from the first turns of another one and the rest of its own. Each prefix
of a rebuilt conversation is a node; equal prefixes are one node. A prefix is known by two sums of
hashes of (place, role, text), which can be built up from blocks, so that one conversation of very
many turns is not in one task: turns are sorted by ranges, numbered by range and place in it, and
summed by blocks.

Sums over subtrees come from centroid decomposition of the forest of parent edges. The mass of a
node is the number of (conversation, prefix) pairs in its subtree. In each component, the centroid
is the deepest node with at least half of the component's mass. The total of its subtree goes to all nodes
from the centroid to the component's top, then the component falls apart into the rest above and
the subtrees of the centroid's children, none with more than half of the mass. Components of many
nodes are split so by joins, all at once, a logarithmic number of rounds; whether a node is
above or below a centroid is told by the prefixes of the conversations that the two stand for.
Components of bounded size are finished in one task each, in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablekeep.llm.common import col, settled

FAMILY, TURNS = 100, 6  # conversations of a family, and the modulus of the number of shared turns
BITS = 52  # of each of the two hashes of a prefix
BLOCK = 1024  # turns summed at a time
COMPONENT = 1024  # nodes that are finished in one task
RUN = 4096  # conversation ids that are written out together
NO_ENDS = hashlib.sha256(b"").hexdigest()
KEY, PARENT, TOP = ["k1", "k2"], ["p1", "p2"], ["t1", "t2"]


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _modulo(value: Column) -> Column:
    return F.pmod(value, F.lit(1 << BITS))


def _numbered(turns: DataFrame) -> DataFrame:
    """``c``, ``part``, ``pos`` (from 0) inside the part, and the turn's hashes and length."""
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2"), F.col("apart")]
    laid = turns.withColumn("apart", F.monotonically_increasing_id())
    laid = laid.repartitionByRange(_parts(turns), *order).sortWithinPartitions(*order)
    laid = laid.select("c", F.monotonically_increasing_id().alias("at"), "h1", "h2", "n")
    return settled(laid.withColumn("part", F.shiftright("at", 33)), "trie-turns")


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (``c``, ``pos``, hashes, ``n``, ``len`` of the whole), and all
    conversations (``c``, ``len``)."""
    laid = _numbered(turns)
    parts = laid.groupBy("c", "part").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0)))
    shared = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(TURNS))
    convs = parts.groupBy("c").agg(F.sum("m").alias("total"))
    convs = convs.withColumn("h", shared).withColumn("base", F.col("c") - F.col("c") % FAMILY)
    bases = convs.select(F.col("c").alias("base"), F.col("total").alias("base_total"))
    convs = convs.join(bases, "base", "left")
    taken = F.least("h", F.coalesce("base_total", F.lit(0)))
    kept = F.greatest(F.col("total") - F.col("h"), F.lit(0))
    convs = settled(
        convs.withColumn("taken", taken).withColumn("len", taken + kept), "trie-conversations"
    )
    parts = parts.join(convs.select("c", "h", "taken", "len"), "c")
    own = laid.join(parts.drop("m"), ["c", "part"])
    own = own.withColumn("pos", F.col("at") - F.col("first") + F.col("offset"))
    columns = ["c", "pos", "h1", "h2", "n", "len"]
    rest = own.filter("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    heads = own.filter(F.col("pos") < TURNS - 1).select(F.col("c").alias("base"), "pos", "h1", "h2", "n")
    heads = convs.filter("taken > 0").select("c", "base", "h", "len").join(heads, "base")
    front = heads.filter("pos < h")
    return front.select(*columns).unionByName(rest.select(*columns)), convs.select("c", "len")


def _prefixes(rebuilt: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per conversation and prefix: ``c``, depth ``d``, its key, the key of the prefix one turn
    shorter, ``n`` of its last turn and ``len``. The empty prefix has the key (0, 0)."""
    hashed = rebuilt.withColumn("block", (F.col("pos") / BLOCK).cast("long"))
    for i in (1, 2):
        own = F.xxhash64(F.lit(i), "pos", "h1", "h2")
        hashed = hashed.withColumn(f"x{i}", F.shiftrightunsigned(own, 64 - BITS))
    wide = "decimal(38,0)"
    sums = hashed.groupBy("c", "block").agg(*[F.sum(x).cast(wide).alias(x) for x in ("x1", "x2")])
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = [_modulo(F.sum(f"x{i}").over(before)).cast("long").alias(f"o{i}") for i in (1, 2)]
    sums = sums.select("c", "block", *offsets).filter("block > 0")
    inside = Window.partitionBy("c", "block").orderBy("pos")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = hashed.withColumns({f"s{i}": F.sum(f"x{i}").over(inside) for i in (1, 2)})
    summed = summed.join(sums, ["c", "block"], "left")
    keys = {}
    for i in (1, 2):
        keys[f"k{i}"] = _modulo(_modulo(F.col(f"s{i}")) + F.coalesce(f"o{i}", F.lit(0)))
    summed = summed.withColumns(keys)
    for i in (1, 2):
        summed = summed.withColumn(f"p{i}", _modulo(F.col(f"k{i}") - F.col(f"x{i}")))
    summed = summed.select("c", (F.col("pos") + 1).alias("d"), *KEY, *PARENT, "n", "len")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.select(
        "c", zero.alias("d"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"),
        zero.alias("n"), "len",
    )
    return settled(roots.unionByName(summed), "trie-prefixes")


def _nodes(prefixes: DataFrame) -> DataFrame:
    """A row per node: key, parent's key, depth, smallest conversation ``c``, counts and ``mass``."""
    nodes = prefixes.groupBy(*KEY).agg(
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.min("d").alias("d"),
        F.min("c").alias("c"),
        F.max("n").alias("n"),
        F.count("*").alias("n_convs"),
        F.sum(F.col("len") - F.col("d") + 1).alias("mass"),
    )
    children = nodes.filter("p1 IS NOT NULL").groupBy(*PARENT).agg(F.count("*").alias("n_children"))
    children = children.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    nodes = nodes.join(children, KEY, "left").fillna(0, ["n_children"])
    return settled(nodes, "trie-nodes")


_WORK = [*KEY, *PARENT, "d", "c", "mass", *TOP, "leaf", "saved", "more_leaf", "more_saved"]


def _split(work: DataFrame, prefixes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """The components of at most ``limit`` nodes, and what the others fall apart into, if any."""
    totals = work.groupBy(*TOP).agg(F.count("*").alias("nodes"), F.max("mass").alias("total"))
    large = settled(totals.filter(F.col("nodes") > limit).select(*TOP, "total"), "trie-large")
    if large.isEmpty():
        return work, None
    small = work.join(large, TOP, "left_anti")
    rest = work.join(large, TOP)
    node = F.struct("mass", "k1", "k2", "d", "c")
    centroids = rest.filter("2 * mass >= total").groupBy(*TOP).agg(F.min(node).alias("x"))
    centroids = settled(
        centroids.select(
            *TOP, *[F.col(f"x.{name}").alias(f"x_{name}") for name in ("mass", "k1", "k2", "d", "c")]
        ),
        "trie-centroids",
    )
    # from the centroid to the top: the prefixes of a conversation that the centroid stands for
    way = centroids.join(prefixes.select(F.col("c").alias("x_c"), "d", *KEY), "x_c")
    way = way.filter("d <= x_d").select(*TOP, *KEY, F.lit(True).alias("above"))
    # below it: the prefix just below the centroid's depth, of a conversation of the node
    below = prefixes.filter("d > 0").select(
        "c", F.col("d").alias("under"), F.col("k1").alias("b1"), F.col("k2").alias("b2"),
        F.col("p1").alias("x_k1"), F.col("p2").alias("x_k2"),
    )
    rest = rest.drop("total").join(centroids, TOP).withColumn("under", F.col("x_d") + 1)
    lower = rest.filter("d > x_d").join(below, ["c", "under", "x_k1", "x_k2"], "left")
    upper = rest.filter("d <= x_d").withColumns({n: F.lit(None).cast("long") for n in ("b1", "b2")})
    told = lower.unionByName(upper).join(way, [*TOP, *KEY], "left")
    is_centroid = "(k1 = x_k1 AND k2 = x_k2)"
    told = settled(told.withColumn("centre", F.expr(is_centroid)), "trie-told")
    inside = told.filter("centre OR b1 IS NOT NULL").groupBy(*TOP)
    sums = inside.agg(F.sum("leaf").alias("x_leaf"), F.sum("saved").alias("x_saved"))
    told = told.join(sums, TOP)
    new = {}
    for name in ("leaf", "saved"):
        own = F.when(F.col("centre"), F.col(f"x_{name}") - F.col(name))
        own = own.when(F.col("above"), F.col(f"x_{name}")).otherwise(0)
        new[f"more_{name}"] = F.col(f"more_{name}") + own
    new["mass"] = (
        F.when(F.col("centre"), F.lit(1).cast("long"))
        .when(F.col("above"), F.col("mass") - F.col("x_mass"))
        .otherwise(F.col("mass"))
    )
    for t, k, b in zip(TOP, KEY, ("b1", "b2")):
        new[t] = F.when(F.col("centre"), F.col(k)).otherwise(F.coalesce(b, t))
    # a centroid becomes a component of its own; what stays above keeps the name of its top, which
    # only a top that is the centroid gives up
    return small, settled(told.withColumns(new).select(*_WORK), "trie-work")


def decomposed(parents: list[int], values: list[tuple[int, int]]) -> list[list[int]]:
    """Per node of a tree the sums of two values over its subtree. Parents come before their children;
    the first node's parent is -1."""
    out = [[0, 0] for _ in parents]
    inside = [0] * len(parents)  # the component that a node is in
    size = [0] * len(parents)
    work, known = [list(range(len(parents)))], 0
    while work:
        nodes = work.pop()
        if len(nodes) == 1:
            own = out[nodes[0]]
            own[0] += values[nodes[0]][0]
            own[1] += values[nodes[0]][1]
            continue
        known += 1
        for v in nodes:
            inside[v], size[v] = known, 1
        top = nodes[0]
        for v in reversed(nodes):
            if v != top:
                size[parents[v]] += size[v]
        centre = min((v for v in nodes if 2 * size[v] >= len(nodes)), key=size.__getitem__)
        above: list[int] = []
        below: dict[int, list[int]] = {}
        at: dict[int, int] = {centre: centre}  # nodes of the centroid's subtree, by its child
        first, second = values[centre]
        for v in nodes:
            if v == centre:
                continue
            branch = at.get(parents[v]) if v != top else None
            if branch is None:
                above.append(v)
                continue
            branch = v if branch == centre else branch
            at[v] = branch
            below.setdefault(branch, []).append(v)
            first += values[v][0]
            second += values[v][1]
        v = centre
        while v >= 0 and inside[v] == known:
            out[v][0] += first
            out[v][1] += second
            v = parents[v]
        work += [part for part in (above, *below.values()) if part]
        inside[centre] = 0
    return out


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole components, one after the other, parents before children."""

    def sums(rows: list[tuple]) -> pa.RecordBatch:
        places = {(r[0], r[1]): i for i, r in enumerate(rows)}
        parents = [places.get((r[2], r[3]), -1) for r in rows]
        found = decomposed(parents, [(r[4], r[5]) for r in rows])
        return pa.record_batch(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([f[0] + r[6] for f, r in zip(found, rows)], pa.int64()),
                pa.array([f[1] + r[7] for f, r in zip(found, rows)], pa.int64()),
            ],
            names=["k1", "k2", "n_leaves", "saved_tokens"],
        )

    top, held = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns):
            if row[:2] != top:
                if held:
                    yield sums(held)
                top, held = row[:2], []
            held.append(row[2:])
    if held:
        yield sums(held)


def _rolled_up(nodes: DataFrame, prefixes: DataFrame, limit: int) -> DataFrame:
    """Per node's key ``n_leaves`` and ``saved_tokens`` of its subtree."""
    zero = F.lit(0).cast("long")
    work = nodes.select(
        *KEY, *PARENT, "d", "c", "mass", zero.alias("t1"), zero.alias("t2"),
        (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("n")).alias("saved"),
        zero.alias("more_leaf"), zero.alias("more_saved"),
    )
    work, done = settled(work, "trie-work"), None
    while work is not None:
        small, work = _split(work, prefixes, limit)
        done = small if done is None else done.unionByName(small)
    done = done.repartition(*TOP).sortWithinPartitions(*TOP, "d")
    done = done.select(*TOP, *KEY, *PARENT, "leaf", "saved", "more_leaf", "more_saved")
    return done.mapInArrow(_finished, "k1 long, k2 long, n_leaves long, saved_tokens long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of a node as texts of some ids each."""
    held: list[int] = []
    key, rows = None, []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        arrays = [pa.array(list(x), kind) for x, kind in zip(zip(*rows), kinds)]
        return pa.record_batch(arrays, names=["k1", "k2", "first", "ids"])

    for batch in batches:
        for *own, c in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if own != key or len(held) == RUN:
                if held:
                    rows.append((*key, held[0], ",".join(map(str, held))))
                key, held = own, []
            held.append(c)
        if len(rows) >= 64:
            yield batch_of(rows)
            rows = []
    if held:
        rows.append((*key, held[0], ",".join(map(str, held))))
    if rows:
        yield batch_of(rows)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's ids; a stream, of which only the hash is held."""
    key, state = None, None
    for batch in batches:
        rows = []
        for *own, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)]):
            if own == key:
                state.update(b",")
            else:
                if key is not None:
                    rows.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256()
            state.update(ids.encode())
        if rows:
            yield _digest_rows(rows)
    if key is not None:
        yield _digest_rows([(*key, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string()]
    arrays = [pa.array(list(x), kind) for x, kind in zip(zip(*rows), kinds)]
    return pa.record_batch(arrays, names=["k1", "k2", "ends_sha256"])


def _ends(prefixes: DataFrame) -> DataFrame:
    """Per node the hash of the ids of the conversations that end there.

    SHA-256 takes its input in order, so the ids of one node go through one task, as a stream of
    texts that many tasks have made.
    """
    ends = prefixes.filter("d = len").select(*KEY, "c")
    order = [*KEY, "c"]
    ends = ends.repartitionByRange(_parts(prefixes), *order).sortWithinPartitions(*order)
    runs = ends.mapInArrow(_runs, "k1 long, k2 long, first long, ids string")
    runs = runs.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return runs.mapInArrow(_hashed, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(
    turns: DataFrame,
    ident: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    component: int = COMPONENT,
) -> DataFrame:
    """A row per node of the trie of rebuilt conversations.

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. A null role or text counts as
    empty. Turns are ordered by ``turn``, nulls first, equal ones by a hash of role and text, and a
    repeated row is a turn like any other. Rows without a conversation id take no part. A
    conversation with no turns left is a member of the root only. An empty table gives no rows.
    """
    role_of = F.coalesce(col(turns, role), F.lit(""))
    text_of = F.coalesce(col(turns, text), F.lit(""))
    rows = turns.select(
        col(turns, ident).cast("long").alias("c"),
        col(turns, turn).alias("turn"),
        F.xxhash64(F.lit(1), role_of, text_of).alias("h1"),
        F.xxhash64(F.lit(2), role_of, text_of).alias("h2"),
        F.length(text_of).cast("long").alias("n"),
    ).filter("c IS NOT NULL")
    prefixes = _prefixes(*_rebuilt(rows))
    nodes = _nodes(prefixes)
    sums = _rolled_up(nodes, prefixes, component)
    over = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("c").alias("parent_c"))
    found = nodes.join(over, PARENT, "left").join(sums, KEY).join(_ends(prefixes), KEY, "left")
    return found.select(
        F.col("c").alias(ident),
        F.col("d").alias("depth"),
        F.col("parent_c").alias(f"parent_{ident}"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
