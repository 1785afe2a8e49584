"""Removal of byte strings that occur more than once, found by suffix arrays of candidate contexts.

Every string of ``length`` bytes that starts at least twice, in one document or in several, is
removed wherever it is. Sorting all suffixes of a corpus at once is not needed for that:

1. Of the strings of ``length`` / 2 bytes inside each window of ``length`` bytes the one of smallest
   hash is the window's anchor. Equal windows have equal anchors at the same place, and there are
   few anchors. Anchors that occur once in the corpus take all their windows out of the question.
2. A repeated anchor is looked at in its context: the bytes around it that its windows can cover.
   Contexts that occur several times, as those of copies do, are repeated as a whole.
3. The different contexts of an anchor are written as texts over larger symbols (the edges
   of the tree that they form to either side of the anchor) and their suffixes are sorted by linear grouping.
   Neighbours in the suffix array share the longest prefixes: they give, for each start of a
   context, how far its longest repeat reaches.
4. Anchors with very many contexts are not sorted in one task. Their contexts are dealt out by
   longer common strings, with fewer windows each, as often as needed; at the end stand single
   windows, which need to be counted only.

Two hashes of 64 bits stand for equal contexts in step 2 and for equal texts; step 3 compares bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from tablekeep.llm.common import col, layout, settled, slices, text_column
from tablekeep.llm.suffix_sort import common_prefixes, suffix_array

LENGTH = 200
CHUNK = 1 << 18  # windows hashed together
TEXT = ["key", "twin", "size"]
SALTS = 64  # parts that the places of one context are dealt into
GROUP = 8192  # contexts of one anchor that are sorted together
SPLIT = 5  # parts that the windows of a larger group are dealt out to
SYMBOLS = 100_000  # in one suffix array
BITMAP_BITS = 1 << 26
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        step = min(size, n - size)
        out[size : size + step] = out[:step] * np.uint64(pow(base, size, 1 << 64))
        size += step
    return out


class Anchors:
    """Finds the anchors of texts: positions of the smallest substrings of their windows."""

    def __init__(self, length: int):
        self.length, self.k = length, length // 2
        self.windows = length - self.k + 1  # substrings in a window
        self.up = _powers(BASE, CHUNK + length + 1)
        self.down = _powers(pow(BASE, -1, 1 << 64), CHUNK + length + 1)

    def find(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Owner, position in ``data`` and hash of each anchor, by position."""
        sizes = np.maximum(0, np.diff(bounds) - self.length + 1)
        found, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        last = len(data) - self.length + 1  # windows of the whole, over the bounds too
        valid = np.zeros(max(0, last) + 1, np.int8)
        some = sizes > 0
        valid[bounds[:-1][some]] += 1
        valid[bounds[:-1][some] + sizes[some]] -= 1
        valid = np.cumsum(valid, dtype=np.int8)[:-1].astype(bool)
        for start in range(0, last, CHUNK):
            end = min(last, start + CHUNK)
            if not valid[start:end].any():
                continue
            own = self._hashes(data[start : end + self.length - 1])
            at = self._smallest(own)[valid[start:end]]
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            found.append(at + start)
            hashes.append(own[at])
        at, hashes = np.concatenate(found), np.concatenate(hashes)
        at, first = np.unique(at, return_index=True)  # chunks overlap
        return np.searchsorted(bounds, at, "right") - 1, at, hashes[first]

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        """A mixed polynomial hash of the ``k`` bytes from each position on."""
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        h = (sums[self.k :] - sums[: -self.k]) * self.down[: len(data) - self.k + 1]
        for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(32))

    def _smallest(self, hashes: np.ndarray) -> np.ndarray:
        """The position of the smallest of each ``windows`` hashes in a row, the first of equals."""
        bits = np.uint64(CHUNK.bit_length() + 1)
        low = (np.uint64(1) << bits) - np.uint64(1)
        packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        w, n = self.windows, len(packed)
        rows = np.append(packed, np.full(-n % w, MASK, np.uint64)).reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        return (np.minimum(back[: n - w + 1], ahead[w - 1 : n]) & low).astype(np.int64)


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """A bitmap over the lowest bits of 64-bit keys. Its size is fixed, whatever the number of keys.

    A key whose bit is not set is not among the keys; others have to be joined.
    """
    word = F.shiftrightunsigned(F.col(key).bitwiseAND(F.lit(BITMAP_BITS - 1)), 6).cast("int")
    bit = F.expr(f"shiftleft(1L, cast({key} & 63 as int))")
    words = keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys.astype(np.uint64) & np.uint64(BITMAP_BITS - 1)
    return (bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) != 0


def _shared(a: bytes, b: bytes) -> int:
    """How many leading bytes two strings share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - (
        (int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7
    ) // 8


def _edges(sides: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each string the edges (start, end) of its way down the tree of all of them.

    The tree branches where strings part; a last edge that only one string has is left out.
    """
    order = sorted(range(len(sides)), key=sides.__getitem__)
    shared = [_shared(sides[a], sides[b]) for a, b in zip(order, order[1:])]
    depths: list[set[int]] = [set() for _ in sides]
    for places, gaps in ((order, [0, *shared]), (order[::-1], [0, *shared[::-1]])):
        parted: list[int] = []  # the depths at which the strings seen so far part from this one
        for i, gap in zip(places, gaps):
            while parted and parted[-1] >= gap:
                parted.pop()
            if gap:
                parted.append(gap)
            depths[i].update(parted)
    ways = []
    for own in depths:
        bounds = sorted(own)
        ways.append(list(zip([0, *bounds], bounds)))
    return ways


END = 0  # the symbol after each context; how far repeats reach is cut there


class _Contexts:
    """Contexts of many anchors as one text of symbols, whose suffixes are sorted together."""

    def __init__(self, k: int, length: int):
        self.k, self.length = k, length
        self.text: list[int] = []
        self.sizes: list[int] = []  # bytes of each symbol
        self.known = 0  # symbols given out
        self.contexts: list[tuple] = []  # tag, start in the text, place of the anchor, end

    def add(self, group: list[tuple]) -> None:
        """Contexts of one anchor: (tag, bytes left of the anchor, context)."""
        k, symbols = self.k, {}
        lefts = [context[:left][::-1] for _, left, context in group]
        rights = [context[left + k :] for _, left, context in group]
        text, sizes = self.text, self.sizes

        def put(symbol: tuple, size: int) -> None:
            own = symbols.get(symbol)
            if own is None:
                self.known += 1
                own = symbols[symbol] = self.known
            text.append(own)
            sizes.append(size)

        ways = zip(group, lefts, _edges(lefts), rights, _edges(rights))
        for (tag, left, context), before, far, after, near in ways:
            start = len(text)
            for a, b in reversed(far):
                put((-1, a, before[a:b]), b - a)
            anchor = len(text)
            put((0, 0, context[left : left + k]), k)
            for a, b in near:
                put((1, a, after[a:b]), b - a)
            self.contexts.append((tag, start, anchor, len(text)))
            text.append(END)
            sizes.append(0)

    def repeats(self) -> Iterator[tuple]:
        """(tag, bytes before the anchor, bytes after it) of each repeat with another context."""
        order = suffix_array(self.text)
        shared = common_prefixes(self.text, order)
        longest = [0] * len(self.text)
        for place, start in enumerate(order):
            after = shared[place + 1] if place + 1 < len(order) else 0
            longest[start] = max(shared[place], after)
        ends = np.cumsum([0, *self.sizes]).tolist()
        for tag, start, anchor, end in self.contexts:
            for at in range(start, anchor + 1):
                stop = min(at + longest[at], end)
                if stop > anchor and ends[stop] - ends[at] >= self.length:
                    yield tag, ends[anchor] - ends[at], ends[stop] - ends[anchor + 1]


class _Finder:
    """The steps of the search over one frame of texts; ``TEXT``, 128 bits of hashes and the size,
    names a text."""

    def __init__(self, texts: DataFrame, length: int, group: int):
        self.texts, self.length, self.group = texts, length, group
        self.k = length // 2
        self.margin = length - self.k

    def spans(self) -> DataFrame:
        """The repeated ``spans`` of each text that has any."""
        repeated = settled(
            self.anchor_hashes().groupBy("kh").agg(F.count("*").alias("n")).filter("n > 1")
            .select("kh"),
            "repeat-anchors",
        )
        found = self.occurrences(bitmap(repeated, "kh")).join(repeated, "kh")
        # places are counted by context and salt first, so that those of a common context, which
        # may be a third of all, are never together
        found = found.withColumn("salt", F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS)).cast("int"))
        found = settled(found, "repeat-occurrences")
        place = F.struct(*TEXT, "pos")
        parts = found.groupBy("kh", "ch", "salt").agg(F.count("*").alias("c"), F.min(place).alias("at"))
        contexts = parts.groupBy("kh", "ch").agg(
            F.sum("c").alias("c"), F.min("at").alias("at"), F.collect_list("salt").alias("salts")
        )
        contexts = settled(contexts, "repeat-contexts")
        copies = contexts.filter("c > 1").select("kh", "ch", F.explode("salts").alias("salt"))
        copied = found.join(copies, ["kh", "ch", "salt"])
        start, end = self.window(F.col("pos"), F.col("size"))
        copied = copied.select(*TEXT, start.alias("start"), end.alias("end"))
        contexts = contexts.drop("salts")
        groups = contexts.groupBy("kh").agg(F.count("*").alias("m"), F.min("c").alias("least"))
        groups = groups.filter("m > 1 and least = 1").select("kh", "m")
        wanted = contexts.join(groups, "kh").select("kh", "m", "c", "at.*")
        sorted_out = self.compared(self.with_bytes(settled(wanted, "repeat-wanted")))
        spans = copied.filter(F.col("end") - F.col("start") >= self.length).unionByName(sorted_out)
        spans = spans.groupBy(*TEXT).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
        return settled(spans, "repeat-spans")

    def window(self, pos, size):
        """Where the windows of an anchor can reach."""
        return (
            F.greatest(pos - self.margin, F.lit(0)),
            F.least(pos + self.k + self.margin, size),
        )

    def anchor_hashes(self) -> DataFrame:
        length = self.length

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Anchors(length)
            for batch in slices(batches, 0):
                _, _, hashes = finder.find(*layout(text_column(batch, 0)))
                yield pa.record_batch([pa.array(hashes.view(np.int64))], names=["kh"])

        return self.texts.select("text").mapInArrow(hashed, "kh long")

    def occurrences(self, bits: np.ndarray) -> DataFrame:
        """Anchors whose bit is set: hash, hash of the context, text and position."""
        length, k, margin = self.length, self.k, self.margin

        def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Anchors(length)
            digest = xxhash.xxh3_64_intdigest
            for batch in slices(batches, 3):
                data, bounds = layout(text_column(batch, 3))
                owner, at, hashes = finder.find(data, bounds)
                keep = in_bitmap(bits, hashes)
                owner, at, hashes = owner[keep], at[keep], hashes[keep]
                first = np.maximum(bounds[owner], at - margin)
                last = np.minimum(bounds[owner + 1], at + k + margin)
                raw = data.tobytes()
                around = [
                    digest(raw[a:b], p - a)
                    for a, p, b in zip(first.tolist(), at.tolist(), last.tolist())
                ]
                rows = pa.array(owner)
                yield pa.record_batch(
                    [
                        pa.array(hashes.view(np.int64)),
                        pa.array(np.array(around, np.uint64).view(np.int64)),
                        *[batch.column(i).take(rows) for i in range(3)],
                        pa.array((at - bounds[owner]).astype(np.int32)),
                    ],
                    names=["kh", "ch", *TEXT, "pos"],
                )

        return self.texts.select(*TEXT, "text").mapInArrow(
            located, "kh long, ch long, key long, twin long, size int, pos int"
        )

    def with_bytes(self, wanted: DataFrame) -> DataFrame:
        """The wanted contexts with their bytes, taken from one text each."""
        k, margin = self.k, self.margin
        places = wanted.groupBy(*TEXT).agg(
            F.collect_list(F.struct("kh", "m", "c", "pos")).alias("places")
        )
        texts = held_texts(self.texts.select(*TEXT, "text"), bitmap(wanted, "key"))
        # a shuffle in any case: two Python steps in one task would take two workers
        joined = texts.join(places.hint("merge"), TEXT).select(*TEXT, "packed", "places")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack = zstandard.ZstdDecompressor()
            seen = None
            for batch in batches:
                for row in range(batch.num_rows):
                    *name, packed, places = (batch.column(i)[row].as_py() for i in range(5))
                    if name == seen:  # copies lie next to each other
                        continue
                    seen = name
                    text = unpack.decompress(packed)
                    out = []
                    for place in places:
                        pos = place["pos"]
                        left = min(margin, pos)
                        out.append(
                            (place["kh"], place["m"], place["c"], *name, pos, left,
                             text[pos - left : pos + k + margin])
                        )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*out), _CONTEXT_TYPES)], _CONTEXT_NAMES
                    )

        found = joined.mapInArrow(cut, _CONTEXT_SCHEMA)
        # a text whose copies came to several tasks was cut more than once
        return settled(found.dropDuplicates([*TEXT, "pos"]), "repeat-bytes")

    def compared(self, contexts: DataFrame) -> DataFrame:
        """The text, ``start`` and ``end`` of what single contexts share with others."""
        limit = self.group
        small = contexts.filter(F.col("m") <= limit).withColumn("unit", F.col("kh"))
        spans = self.sorted_units(small)
        large = contexts.filter(F.col("m") > limit).withColumns(
            {"unit": F.col("kh"), "lo": F.lit(0), "hi": F.lit(self.margin)}
        )
        ranges = [(0, self.margin)]
        while max(hi - lo for lo, hi in ranges) > 0 and not large.isEmpty():
            ranges = [part for whole in ranges for part in _parts(*whole)]
            dealt = settled(self.dealt(large), "repeat-dealt")
            sizes = dealt.groupBy("unit").agg(F.count("*").alias("m")).filter("m > 1")
            sized = settled(dealt.drop("m").join(settled(sizes, "repeat-units"), "unit"), "repeat-sized")
            single = sized.filter("lo = hi and c = 1").select(
                *TEXT, (F.col("pos") - F.col("lo")).alias("start")
            )
            spans = spans.unionByName(
                single.withColumn("end", F.col("start") + self.length)
            )
            rest = sized.filter("lo < hi")
            spans = spans.unionByName(self.sorted_units(rest.filter(F.col("m") <= limit)))
            large = rest.filter(F.col("m") > limit)
        return spans

    def dealt(self, large: DataFrame) -> DataFrame:
        """Each context for each part of its windows, under the hash of the bytes they share."""
        k, margin = self.k, self.margin
        names = large.columns

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    left, context = row["left"], row["context"]
                    right = len(context) - left - k
                    for lo, hi in _parts(row["lo"], row["hi"]):
                        if left >= lo and right >= margin - hi:  # else no such window
                            common = context[left - lo : left + k + margin - hi]
                            unit = xxhash.xxh3_64_intdigest(common, lo)
                            unit = unit - (1 << 64) if unit >> 63 else unit
                            out.append({**row, "unit": unit, "lo": lo, "hi": hi})
                yield pa.RecordBatch.from_pylist(out, batch.schema)

        return large.select(*names).mapInArrow(deal, large.schema)

    def sorted_units(self, rows: DataFrame) -> DataFrame:
        """Spans from the suffix arrays of the units' contexts."""
        k, length = self.k, self.length
        rows = rows.select("unit", "c", *TEXT, "pos", "left", "context")
        rows = rows.repartition("unit").sortWithinPartitions("unit")

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            text = _Contexts(k, length)
            for group in _runs(batches):
                text.add(group)
                if len(text.text) >= SYMBOLS:
                    yield _span_rows(text, k)
                    text = _Contexts(k, length)
            if text.contexts:
                yield _span_rows(text, k)

        return rows.mapInArrow(found, "key long, twin long, size int, start int, end int")


_CONTEXT_NAMES = ["kh", "m", "c", *TEXT, "pos", "left", "context"]
_CONTEXT_TYPES = [*[pa.int64()] * 5, *[pa.int32()] * 3, pa.binary()]
_CONTEXT_SCHEMA = (
    "kh long, m long, c long, key long, twin long, size int, pos int, left int, context binary"
)


def _parts(lo: int, hi: int) -> list[tuple[int, int]]:
    """A range of window offsets, both ends included, in ``SPLIT`` parts at most."""
    bounds = np.unique(np.linspace(lo, hi + 1, SPLIT + 1).astype(int)).tolist()
    return [(a, b - 1) for a, b in zip(bounds, bounds[1:])]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The contexts of each unit: ((count, key, twin, size, position), bytes left, context)."""
    unit, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for own, c, key, twin, size, pos, left, context in zip(*columns):
            if own != unit and held:
                yield held
                held = []
            unit = own
            held.append(((c, key, twin, size, pos), left, context))
    if held:
        yield held


def _span_rows(text: _Contexts, k: int) -> pa.RecordBatch:
    rows = [
        (key, twin, size, pos - before, pos + k + after)
        for (c, key, twin, size, pos), before, after in text.repeats()
        if c == 1  # the others are repeated as a whole
    ]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(columns, kinds)], [*TEXT, "start", "end"]
    )


def held_texts(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows (``key`` first, ``text`` last) whose key's bit is set, with the text ``packed``, which takes
    less of the shuffle that follows."""
    names = rows.columns
    fields = rows.schema.fields[:-1] + [T.StructField("packed", T.BinaryType())]

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, len(names) - 1):
            batch = batch.filter(pa.array(in_bitmap(bits, batch.column(0).to_numpy())))
            if not batch.num_rows:
                continue
            packed = [pack.compress(t.as_buffer()) for t in batch.column(len(names) - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(packed, pa.binary())], [*names[:-1], "packed"]
            )

    return rows.mapInArrow(chosen, T.StructType(fields))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans as maximal runs, touching ones joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


ADDED = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept_text")


def remove_repeats(
    docs: DataFrame,
    text: str = "text",
    length: int = LENGTH,
    with_texts: bool = True,
    group: int = GROUP,
) -> DataFrame:
    """The documents with what stays of their text once all repeated strings are gone.

    Added: ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``removed`` (maximal runs, as
    structs of ``start`` and ``end``) and ``kept_text``: the remaining bytes but for those of cut
    characters (null for a null text). Without ``with_texts`` neither this nor the text itself is
    returned. Matches do not cross documents and are judged on the input alone, so every
    occurrence of a repeat goes, the first too; copies of a text of ``length`` bytes or more lose
    all of it. A null text is empty; texts shorter than ``length`` lose nothing. Columns of the
    input that have the name of an added one are replaced.
    """
    docs = docs.drop(*[n for n in ADDED if n.lower() != text.lower()])
    names = docs.columns
    keys = [f"c{i}" for i in range(len(names))]
    at = names.index(text)
    plain = docs.toDF(*keys)
    whole = F.coalesce(F.col(keys[at]), F.lit(""))
    is_null = F.col(keys[at]).isNull()
    others = [k for k in keys if k != keys[at]]
    rows = plain.select(
        F.xxhash64(whole).alias("key"),
        F.xxhash64(F.lit(1), whole).alias("twin"),
        F.octet_length(whole).alias("size"),
        is_null.alias("null"),
        *others,
        whole.alias("text"),
    )
    spans = _Finder(rows, length, group).spans()
    bits = bitmap(spans, "key")
    touched = held_texts(rows, bits).join(spans.hint("merge"), TEXT, "left")
    schema = T.StructType(
        [plain.schema[k] for k in others]
        + [plain.schema[keys[at]]] * with_texts
        + [T.StructField(n, T.LongType()) for n in ADDED[:3]]
        + [
            T.StructField("kept_sha256", T.StringType()),
            T.StructField(
                "removed",
                T.ArrayType(
                    T.StructType(
                        [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
                    )
                ),
            ),
        ]
        + [T.StructField("kept_text", T.StringType())] * with_texts
    )
    touched = touched.select("null", *others, "packed", "spans")
    touched = touched.mapInArrow(_judged(len(others), None, with_texts, schema.names), schema)
    clean = rows.select("null", *others, "text", "key")
    clean = clean.mapInArrow(_judged(len(others), bits, with_texts, schema.names), schema)
    result = touched.unionByName(clean)
    left = [(k, n) for k, n in zip(keys, names) if k in schema.names]
    new = [n for n in ADDED if n in schema.names]
    return result.select(*[k for k, _ in left], *new).toDF(*[n for _, n in left], *new)


def _judged(others: int, bits: np.ndarray | None, with_texts: bool, names: list[str]):
    """What stays of packed texts with their spans or, given a bitmap, of the texts that it lets
    through, which have none."""
    removed_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        packed = bits is None
        for batch in slices(batches, others + 1):
            if not packed:
                batch = batch.filter(pa.array(~in_bitmap(bits, batch.column(others + 2).to_numpy())))
            texts, sizes, kept, runs = [], [], [], []
            nulls = batch.column(0).to_pylist()
            spans = batch.column(others + 2).to_pylist() if packed else [None] * len(nulls)
            for own, null, found in zip(batch.column(others + 1), nulls, spans):
                raw = own.as_buffer()
                raw = unpack.decompress(raw) if packed else raw.to_pybytes()
                cuts = merged(found)
                ends = [0, *[end for _, end in cuts]]
                starts = [*[start for start, _ in cuts], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(ends, starts)) if cuts else raw)
                if with_texts:
                    texts.append(None if null else raw.decode())
                sizes.append(len(raw))
                runs.append([{"start": a, "end": b} for a, b in cuts])
            columns = [
                *batch.columns[1 : others + 1],
                *[pa.array(texts, pa.string())] * with_texts,
                pa.array(sizes, pa.int64()),
                pa.array([n - len(x) for n, x in zip(sizes, kept)], pa.int64()),
                pa.array([len(x) for x in runs], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                pa.array(runs, removed_type),
            ]
            if with_texts:
                left = [None if t is None else k.decode("utf-8", "ignore") for t, k in zip(texts, kept)]
                columns.append(pa.array(left, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return judged


