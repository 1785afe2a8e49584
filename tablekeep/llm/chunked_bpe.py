"""BPE encoding that reuses content-defined chunks, and decoding.

Texts are cut where a rolling hash of the last 32 bytes says so, hence alike wherever a passage
stands. A chunk that occurs more than once in the corpus is encoded once; the others are encoded
where they are. A chunk by itself may be encoded wrongly at its ends, as words and characters that
belong together are cut. So every join is encoded again, with some words to either side, and the
result counts when it agrees with both chunks: what the chunks have at that end is what the same
strings give alone, and the outermost words of the join have the same ids in both. Otherwise more
words are taken, to the whole text at last, whose encoding needs no agreement.

Only texts that hold a repeated chunk are shuffled, and with them the ids of these chunks. Which
chunks may be repeated is told by a bitmap of fixed size; what it lets through beyond them is encoded
once as well, so it only costs time. A chunk's ids go to at most ``SALTS`` places, however many texts
hold it, and from there to the texts of that place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tablekeep.llm.common import (
    col,
    give_back,
    kept_in_process,
    layout,
    settled,
    slices,
    text_column,
    words_of,
)
from tablekeep.llm.packing import Tokens
from tablekeep.llm.repeats import bitmap, in_bitmap

WINDOW = 32  # bytes that the rolling hash sees
AVERAGE_BITS = 10  # a cut each 1,024 bytes or so
SHORTEST, LONGEST = 256, 8192  # bytes of a chunk
WORDS = 2  # to either side of a join at first
SALTS = 32
SLICE = 1 << 20  # bytes of texts worked on together
_MIX = 0x9E3779B97F4A7C15


def _gear() -> np.ndarray:
    """A random number for each byte."""
    out = np.arange(1, 257, dtype=np.uint64) * np.uint64(_MIX)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return (out ^ (out >> np.uint64(31))).astype(np.uint32)


_GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """The rolling hash that ends at each byte: the bytes' numbers, each shifted by its distance."""
    h, width = _GEAR[data], 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def cuts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each chunk, in order. An empty text has none."""
    marked = rolling(data) >> np.uint32(32 - AVERAGE_BITS) == 0
    inside = (data & 0xC0) == 0x80  # of a character
    places = np.flatnonzero(marked) + 1
    starts, ends, owners = [], [], []
    low = np.searchsorted(places, bounds)
    for text, (first, last) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        at, own = first, places[low[text] : low[text + 1]]
        while at < last:
            n = np.searchsorted(own, at + SHORTEST)
            end = min(int(own[n]) if n < len(own) else last, at + LONGEST, last)
            while end < last and inside[end]:
                end += 1
            starts.append(at)
            ends.append(end)
            owners.append(text)
            at = end
    return tuple(np.array(x, np.int64) for x in (starts, ends, owners))


class Slice:
    """Some texts, their chunks and the 128-bit keys of these."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        data, self.bounds = layout(texts)
        self.raw = data.tobytes()
        self.starts, self.ends, self.owners = cuts(data, self.bounds)
        spans = zip(self.starts.tolist(), self.ends.tolist())
        digests = b"".join(xxhash.xxh3_128_digest(self.raw[a:b]) for a, b in spans)
        self.keys = np.frombuffer(digests, "<i8").reshape(-1, 2)
        self._words: tuple | None = None

    def strings(self, spans: Sequence[tuple[int, int]]) -> pa.Array:
        return pa.array([self.raw[a:b] for a, b in spans], pa.binary()).cast(pa.string())

    def chunks(self, numbers: np.ndarray) -> pa.Array:
        return self.strings(list(zip(self.starts[numbers].tolist(), self.ends[numbers].tolist())))

    def different(self) -> np.ndarray:
        """The number of one chunk of each key."""
        return np.unique(self.keys, axis=0, return_index=True)[1]

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the first word of each text."""
        if self._words is None:
            starts, ends, counts = words_of(self.texts)
            self._words = starts, ends, np.concatenate([[0], np.cumsum(counts)])
        return self._words


def _encoded(tokens: Tokens, strings: pa.Array) -> list[np.ndarray]:
    ids, bounds = tokens.encode(strings)
    return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _joins(part: Slice, text: int, inner: list[int], words: int) -> list[tuple]:
    """(start, end, first cut, last cut) of the strings around the cuts of a text, overlaps merged."""
    starts, ends, firsts = part.words
    first, last = int(firsts[text]), int(firsts[text + 1])
    found: list[tuple] = []
    for cut in inner:
        i = int(np.searchsorted(starts[first:last], cut)) + first
        a = int(starts[i - words]) if i - words >= first else int(part.bounds[text])
        j = i + words - 2
        b = int(ends[j]) if j < last else int(part.bounds[text + 1])
        if found and a < found[-1][1]:
            a, _, cut_before, _ = found.pop()
            found.append((a, b, cut_before, cut))
        else:
            found.append((a, b, cut, cut))
    return found


def _first_word(part: Slice, a: int) -> tuple[int, int]:
    starts, ends, _ = part.words
    return a, int(ends[np.searchsorted(starts, a)])


def _last_word(part: Slice, b: int) -> tuple[int, int]:
    starts, ends, _ = part.words
    return int(starts[np.searchsorted(ends, b)]), b


def _ends_with(ids: np.ndarray, end: np.ndarray) -> bool:
    return len(end) <= len(ids) and np.array_equal(ids[len(ids) - len(end) :], end)


def _starts_with(ids: np.ndarray, start: np.ndarray) -> bool:
    return np.array_equal(ids[: len(start)], start)


def _stitched(part: Slice, known: list[np.ndarray], tokens: Tokens, words: int, texts) -> dict:
    """The ids of those of the texts whose joins all agree with the chunks beside them."""
    wanted: dict[tuple[int, int], int] = {}  # the strings to be encoded

    def want(a: int, b: int) -> int:
        return wanted.setdefault((a, b), len(wanted))

    plans = {}
    for text, chunks in texts.items():
        low, high = int(part.bounds[text]), int(part.bounds[text + 1])
        joins = _joins(part, text, [int(part.starts[c]) for c in chunks[1:]], words)
        steps, checks, n = [], [], 0
        for chunk in chunks:
            a, b = int(part.starts[chunk]), int(part.ends[chunk])
            # the joins that reach into this chunk from its front and from its back
            while n < len(joins) and joins[n][1] <= a:
                n += 1
            head = tail = None
            m = n
            if m < len(joins) and joins[m][0] < a:
                head, m = joins[m], m + 1
            if m < len(joins) and joins[m][0] < b:
                tail = joins[m]
            if head and head[1] >= b:
                continue  # inside the join
            if head:
                checks.append(("head", chunk, want(a, head[1])))
            if tail:
                checks.append(("tail", chunk, want(tail[0], b)))
            steps.append((a, "chunk", chunk, want(a, head[1]) if head else None, want(tail[0], b) if tail else None))
        for a, b, first_cut, last_cut in joins:
            own = want(a, b)
            steps.append((a, "join", own, None, None))
            if a > low:
                checks.append(("first", own, want(*_first_word(part, a)), want(a, first_cut)))
            if b < high:
                checks.append(("last", own, want(*_last_word(part, b)), want(last_cut, b)))
        plans[text] = (sorted(steps), checks)
    ids = _encoded(tokens, part.strings(list(wanted)))
    done = {}
    for text, (steps, checks) in plans.items():
        agreed = True
        for kind, one, *others in checks:
            if kind == "head":
                agreed = _starts_with(known[one], ids[others[0]])
            elif kind == "tail":
                agreed = _ends_with(known[one], ids[others[0]])
            elif kind == "first":
                agreed = all(_starts_with(ids[x], ids[others[0]]) for x in (one, others[1]))
            else:
                agreed = all(_ends_with(ids[x], ids[others[0]]) for x in (one, others[1]))
            if not agreed:
                break
        if agreed:
            pieces = []
            for _, kind, number, head, tail in steps:
                if kind == "join":
                    pieces.append(ids[number])
                else:
                    whole = known[number]
                    start = 0 if head is None else len(ids[head])
                    end = len(whole) - (0 if tail is None else len(ids[tail]))
                    pieces.append(whole[start:end])
            done[text] = np.concatenate(pieces)
    return done


def encode_slice(part: Slice, tokens: Tokens, given: list[dict] | None = None) -> list[np.ndarray]:
    """The ids of each text. ``given`` are, per text, the ids of chunks that are known, by key."""
    known: list[np.ndarray | None] = [None] * len(part.starts)
    unknown: dict[tuple, list[int]] = {}
    for n, (key, text) in enumerate(zip(map(tuple, part.keys.tolist()), part.owners.tolist())):
        found = given[text].get(key) if given else None
        if found is None:
            unknown.setdefault(key, []).append(n)
        else:
            known[n] = found
    firsts = np.array([numbers[0] for numbers in unknown.values()], np.int64)
    for numbers, ids in zip(unknown.values(), _encoded(tokens, part.chunks(firsts))):
        for n in numbers:
            known[n] = ids
    out: list = [np.empty(0, np.uint32)] * len(part.texts)
    several: dict[int, list[int]] = {}
    for n, text in enumerate(part.owners.tolist()):
        several.setdefault(text, []).append(n)
    for text in [t for t, chunks in several.items() if len(chunks) == 1]:
        out[text] = known[several.pop(text)[0]]
    words = WORDS
    while several:
        for text, ids in _stitched(part, known, tokens, words, several).items():
            out[text] = ids
            del several[text]
        words *= 2
    return out


class Decoder:
    """What the library's ``decode`` gives, special tokens included."""

    def __init__(self, tokenizer):
        self.tokenizer, self.symbols = tokenizer, None
        if self.tokenizer.decoder is None:  # the tokens' own strings, a space between two
            by_id = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
            if sorted(by_id) == list(range(len(by_id))):
                self.symbols = np.array([by_id[i] for i in range(len(by_id))], object)

    def decode(self, ids: np.ndarray) -> str:
        if self.symbols is None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(self.symbols[ids].tolist())


def _tools(path: str) -> tuple[Tokens, Decoder]:
    tokens = kept_in_process(f"tokens {path}", lambda: Tokens(path))
    return tokens, kept_in_process(f"decoder {path}", lambda: Decoder(tokens.tokenizer))


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(ids: list[np.ndarray], decoder: Decoder) -> list[pa.Array]:
    def sha256(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    return [
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([sha256(x.astype("<u4").tobytes()) for x in ids], pa.string()),
        pa.array([sha256(decoder.decode(x).encode()) for x in ids], pa.string()),
    ]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each chunk occurs in a slice."""
    for batch in slices(batches, 0, SLICE):
        keys, n = np.unique(Slice(text_column(batch, 0)).keys, axis=0, return_counts=True)
        yield pa.record_batch(
            [pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(n.astype(np.int64))],
            names=["a", "b", "n"],
        )


def encode(
    docs: DataFrame,
    tokenizer: str,
    ident: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Per row the id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; with the ids if asked.

    ``ids_sha256`` is that of the ids as little-endian 32-bit integers, ``decoded_sha256`` that of the
    text that the library's ``decode`` gives for them, special tokens included. A null text counts as
    empty and has no ids. Rows stand by themselves, so repeated rows and null ids are encoded like
    others. An empty table gives no rows.
    """
    narrow = docs.select(col(docs, ident).alias("id"), col(docs, text).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    counts = narrow.select("text").mapInArrow(_counted, "a long, b long, n long")
    repeated = counts.groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 1")
    bits = bitmap(settled(repeated.select("a"), "bpe-repeated"), "a")
    shared = narrow.sparkSession.sparkContext.broadcast(bits)
    result = f"id {kind}, {_DIGESTS}, ids array<int>"

    def finished(ids: list[np.ndarray], decoder: Decoder) -> list[pa.Array]:
        lists = pa.nulls(len(ids), pa.list_(pa.int32()))
        if with_ids:
            lists = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
        return [*_digests(ids, decoder), lists]

    names = [part.split()[0] for part in f"{result}, row long, text string".split(", ")]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without a repeated chunk are finished, the others go on."""
        tokens, decoder = _tools(tokenizer)
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 1, SLICE):
            texts = text_column(batch, 1)
            part = Slice(texts)
            waiting = np.zeros(len(texts), bool)
            waiting[part.owners[in_bitmap(shared.value, part.keys[:, 0])]] = True
            del part
            mask = pa.array(waiting)
            alone = texts.filter(pc.invert(mask))
            if len(alone):
                own = finished(encode_slice(Slice(alone), tokens), decoder)
                empty = [pa.nulls(len(alone), pa.int64()), pa.nulls(len(alone), pa.string())]
                ids = batch.column(0).filter(pc.invert(mask))
                yield pa.record_batch([ids, *own, *empty], names=names)
            left = int(waiting.sum())
            if left:
                nothing = [pa.nulls(left, t) for t in (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))]
                rows = pa.array(np.arange(row, row + left))
                row += left
                ids = batch.column(0).filter(mask)
                yield pa.record_batch([ids, *nothing, rows, texts.filter(mask)], names=names)
        tokens.forget()

    table = narrow.mapInArrow(routed, f"{result}, row long, text string")
    table = settled(table, "bpe-routed", "zstd")  # whole texts, the most that is written
    waiting = table.filter("row IS NOT NULL").select("id", "row", "text")

    def offered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, SLICE):
            part = Slice(text_column(batch, 0))
            numbers = part.different()
            numbers = numbers[in_bitmap(shared.value, part.keys[numbers, 0])]
            keys = part.keys[numbers]
            arrays = [pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), part.chunks(numbers)]
            yield pa.record_batch(arrays, names=["a", "b", "chunk"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, _ = _tools(tokenizer)
        for batch in slices(batches, 2, SLICE):
            ids = [x.astype("<u4").tobytes() for x in _encoded(tokens, batch.column(2))]
            arrays = [batch.column(0), batch.column(1), pa.array(ids, pa.binary())]
            yield pa.record_batch(arrays, names=["a", "b", "ids"])
        tokens.forget()

    chunks = waiting.select("text").mapInArrow(offered, "a long, b long, chunk string")
    chunks = chunks.groupBy("a", "b").agg(F.min("chunk").alias("chunk"))
    encoded = settled(chunks.mapInArrow(once, "a long, b long, ids binary"), "bpe-chunks", "zstd")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which rows of a slice hold which chunks."""
        for batch in slices(batches, 1, SLICE):
            part = Slice(text_column(batch, 1))
            rows = batch.column(0).to_numpy()
            chosen = np.flatnonzero(in_bitmap(shared.value, part.keys[:, 0]))
            held: dict[tuple, set] = {}
            for key, text in zip(map(tuple, part.keys[chosen].tolist()), part.owners[chosen].tolist()):
                held.setdefault(key, set()).add(int(rows[text]))
            salt = int(rows[0]) * _MIX >> 32 & 0xFFFF if len(rows) else 0
            keys = np.array(list(held), np.int64).reshape(-1, 2)
            yield pa.record_batch(
                [
                    pa.array(keys[:, 0].copy()),
                    pa.array(keys[:, 1].copy()),
                    pa.array([salt % SALTS] * len(held), pa.int32()),
                    pa.array([sorted(x) for x in held.values()], pa.list_(pa.int64())),
                ],
                names=["a", "b", "salt", "rows"],
            )

    refs = waiting.select("row", "text").mapInArrow(
        asked, "a long, b long, salt int, rows array<long>"
    )
    refs = settled(refs, "bpe-refs")
    places = refs.select("a", "b", "salt").distinct().join(encoded, ["a", "b"])
    found = refs.join(places, ["a", "b", "salt"]).select(F.explode("rows").alias("row"), "a", "b", "ids")
    found = found.groupBy("row").agg(F.collect_list(F.struct("a", "b", "ids")).alias("found"))
    complete = waiting.join(found, "row").select("id", "text", "found")

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, decoder = _tools(tokenizer)
        for batch in slices(batches, 1, SLICE):
            given = [
                {(x["a"], x["b"]): np.frombuffer(x["ids"], "<u4") for x in found}
                for found in batch.column(2).to_pylist()
            ]
            ids = encode_slice(Slice(text_column(batch, 1)), tokens, given)
            yield pa.record_batch([batch.column(0), *finished(ids, decoder)], names=names[:5])
        tokens.forget()
        give_back()

    rest = complete.mapInArrow(assembled, result)
    both = table.filter("row IS NULL").select(*names[:5]).unionByName(rest)
    columns = [F.col("id").alias(ident), "n_tokens", "ids_sha256", "decoded_sha256"]
    return both.select(*columns, *(["ids"] if with_ids else []))
