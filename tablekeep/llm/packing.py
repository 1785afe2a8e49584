"""Packing documents into sequences by minimum bin slack.

A document is its token ids and an end id. Whole sequences are cut from its front; what remains is
shorter than a sequence. The remaining lengths wait in a window of bounded size, as counts per
length. The longest one opens a sequence, a subset-sum over bitsets (bit s is set if some multiset
of waiting lengths adds up to s) finds the fill closest to the capacity, and the multiset is read
back from the bitsets. The same multiset is used as often as the counts allow. If no multiset
fills the sequence, one more waiting piece is cut to close the gap.

Each task packs the documents of its partition: nothing is shuffled, whatever the number of
documents or the commonest length. What is left at the end of a partition, less than one sequence,
is cut into sequences whose lengths are powers of two.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tablekeep.llm.common import (
    Recent,
    col,
    give_back,
    kept_in_process,
    layout,
    slices,
    text_column,
)

CAPACITY = 4096
END_ID = 2
WINDOW_TOKENS = 1 << 20
CARRIED = 16  # sequences' worth of pieces that wait for the next window
CACHED_WORDS = 250_000
TEXT_BYTES = 1 << 20  # of texts encoded together

# fixed values: how the tokenizer file describes white space and word splitting
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# Latin letters, then punctuation that starts neither a contraction nor a special token
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:;=-@\[-`{-~]*)")


def _byte_symbols() -> dict[int, str]:
    """The symbol of each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Tokens:
    """Token ids of whole texts.

    With the word-level file described above, white space ends every token and is dropped, so texts
    are encoded word by word, each different word once; any other file is asked for whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        parts = (described.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = (
            described.get("normalizer") == NORMALIZER
            and parts[0].get("pattern") == {"Regex": SPLIT}
            and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
            and not any(t["lstrip"] or t["rstrip"] for t in described["added_tokens"])
        )
        self.symbols = _byte_symbols()
        # ids as bytes, which take less memory than numbers
        self.words = Recent(CACHED_WORDS, self._word)
        self.runs = Recent(CACHED_WORDS, self._run)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the bounds of each text in them."""
        if not self.by_word:
            found = self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)
            sizes = np.array([len(x.ids) for x in found], np.int64)
            flat = np.fromiter(chain.from_iterable(x.ids for x in found), np.uint32, sizes.sum())
            return flat, np.concatenate([[0], np.cumsum(sizes)])
        plain = _plain_texts(texts)
        if plain.all():
            return self._gather(*_runs(texts), self.runs)
        others = ~plain
        parts = [
            self._gather(*_runs(texts.filter(pa.array(plain))), self.runs),
            self._gather(*_words(texts.filter(pa.array(others))), self.words),
        ]
        ids = np.concatenate([parts[0][0], parts[1][0]])
        begin, sizes = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        for mask, (_, bounds), shift in zip((plain, others), parts, (0, len(parts[0][0]))):
            begin[mask], sizes[mask] = bounds[:-1] + shift, np.diff(bounds)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids[np.repeat(begin - ends[:-1], sizes) + np.arange(ends[-1])], ends

    @staticmethod
    def _gather(units: pa.Array, counts: np.ndarray, known: Recent) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts of ``counts`` units each, every different unit looked up once."""
        units = units.dictionary_encode()
        own = [known[u] for u in units.dictionary.to_pylist()]
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        if not own:
            return np.empty(0, np.uint32), bounds
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat = np.frombuffer(b"".join(own), np.uint32)
        codes = units.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], lengths)
        return flat[at + np.arange(ends[-1])], ends[bounds]

    def forget(self) -> None:
        """Free the memory of the words, as the worker may do other things next."""
        self.words.forget()
        self.runs.forget()
        give_back()

    def _word(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if plain:
            return self.runs[plain[1].lower()] + self.runs[plain[2]]
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _run(self, run: str) -> bytes:
        """The ids of letters only, or of punctuation only."""
        symbols = run.encode().decode("latin-1").translate(self.symbols)
        return _packed([t.id for t in self.tokenizer.model.tokenize(symbols)] if run else [])


# classes of bytes: white space, letter, digit, anything else, and what needs a closer look
_SPACE, _LETTER, _DIGIT, _OTHER, _SPECIAL = range(5)


def _byte_classes() -> np.ndarray:
    classes = np.full(256, _SPECIAL, np.uint8)
    classes[:128] = _OTHER
    classes[[32, *range(9, 14)]] = _SPACE
    classes[ord("0") : ord("9") + 1] = _DIGIT
    for first, last in ("az", "AZ"):
        classes[ord(first) : ord(last) + 1] = _LETTER
    classes[0x80:0xC0] = classes[0xC3] = _LETTER  # in two bytes: the letters from C0 to FF
    classes[[ord("'"), ord("<")]] = _SPECIAL  # contractions, special tokens
    return classes


_CLASSES = _byte_classes()


def _plain_texts(texts: pa.Array) -> np.ndarray:
    """Which texts are of ASCII and the Latin letters up to FF, without contractions and the like."""
    data, bounds = layout(texts)
    classes = _CLASSES[data]
    odd = classes == _SPECIAL
    signs = (data == 0x97) | (data == 0xB7)  # the two signs among those letters
    signs[1:] &= data[:-1] == 0xC3
    at = np.flatnonzero(odd | signs)
    return np.diff(np.searchsorted(at, bounds)) == 0


def _runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters, single digits and runs of other signs of plain texts, in lower case."""
    data, bounds = layout(texts)
    classes = _CLASSES[data]
    solid = classes != _SPACE
    starts = solid.copy()
    starts[1:] &= (classes[1:] != classes[:-1]) | (classes[1:] == _DIGIT)
    firsts = bounds[:-1][bounds[:-1] < len(data)]
    starts[firsts] = solid[firsts]
    capital = (data >= ord("A")) & (data <= ord("Z"))
    wide = (data >= 0x80) & (data <= 0x9E)
    wide[1:] &= data[:-1] == 0xC3
    low = data + np.uint8(32) * (capital | wide)
    at = np.flatnonzero(starts)
    places = np.cumsum(solid) - 1
    offsets = np.append(places[at], places[-1] + 1 if len(places) else 0).astype(np.int32)
    units = pa.StringArray.from_buffers(
        len(at), pa.py_buffer(offsets), pa.py_buffer(low[solid].tobytes())
    )
    return units, np.diff(np.searchsorted(at, bounds))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of any texts, in the case they have."""
    split = pc.ascii_split_whitespace(texts)
    return split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, whose sum is closest below capacity."""
    reach, inside, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left > 0 and not reach >> capacity & 1:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << take * length & inside
            left -= take
            take *= 2
    best, used = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            best -= take * length
            used[length] += take
    return dict(used)


class _Packer:
    """Pieces that wait, as stacks by length, and the sequences made of them."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity = capacity
        self.sequence = first_sequence
        self.waiting: dict[int, list] = defaultdict(list)
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc: object, size: int) -> None:
        """A document of ``size`` ids; ``doc`` is carried along."""
        whole = size - size % self.capacity
        for start in range(0, whole, self.capacity):
            self._close([(doc, start, self.capacity)])
        if size > whole:
            self._wait(doc, whole, size - whole)

    def _wait(self, doc: object, start: int, length: int) -> None:
        self.waiting[length].append((doc, start, length))
        self.tokens += length

    def _take(self, length: int) -> tuple:
        stack = self.waiting[length]
        piece = stack.pop()
        if not stack:
            del self.waiting[length]
        self.tokens -= length
        return piece

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, length in pieces:
            self.rows.append((doc, start, length, self.sequence, offset))
            offset += length
        self.sequence += 1

    def fill(self, keep: int) -> None:
        """Make full sequences until fewer than ``keep`` tokens, and less than a sequence, wait."""
        while self.tokens >= max(keep, self.capacity):
            counts = {length: len(stack) for length, stack in self.waiting.items()}
            longest = max(counts)
            counts[longest] -= 1
            used = closest_fill(counts, self.capacity - longest)
            used[longest] = used.get(longest, 0) + 1
            gap = self.capacity - sum(length * n for length, n in used.items())
            times = min(len(self.waiting[length]) // n for length, n in used.items())
            for _ in range(1 if gap else times):
                pieces = [self._take(length) for length, n in used.items() for _ in range(n)]
                if gap:
                    pieces.append(self._cut(gap))
                self._close(pieces)

    def _cut(self, length: int) -> tuple:
        """A piece of that length off the shortest waiting piece that is longer."""
        doc, start, size = self._take(min(x for x in self.waiting if x > length))
        self._wait(doc, start + length, size - length)
        return doc, start, length

    def finish(self) -> None:
        """The rest, less than a sequence, in sequences of a power of two each."""
        self.fill(0)
        pieces = [p for length in sorted(self.waiting, reverse=True) for p in self.waiting[length]]
        left = sum(p[2] for p in pieces)
        self.waiting.clear()
        self.tokens = 0
        while left:
            size = room = 1 << (left.bit_length() - 1)
            row = []
            while room:
                doc, start, length = pieces.pop(0)
                if length > room:
                    pieces.insert(0, (doc, start + room, length - room))
                    length = room
                row.append((doc, start, length))
                room -= length
            self._close(row)
            left -= size


def pack(
    docs: DataFrame,
    tokenizer: str,
    ident: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: its document, place, check sum, sequence and offset, and its ids if asked.

    ``doc_id`` (the column named by ``ident``), ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``. Every sequence is full but for those at the end of a partition,
    whose lengths are powers of two. A null or empty text is the end id alone. Rows stand by
    themselves, so repeated rows and null ids are packed like others. Sequence ids are unique,
    not gapless. ``docs`` should be read from storage: a task that runs again must see the same rows
    in the same order.
    """
    narrow = docs.select(col(docs, ident).alias("doc_id"), col(docs, text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    extra = ", ids array<int>" if with_ids else ""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept_in_process(f"tokens {tokenizer}", lambda: Tokens(tokenizer))
        packer = _Packer(capacity, TaskContext.get().partitionId() << 40)
        id_type = None
        for batch in slices(batches, 1, TEXT_BYTES):
            id_type = batch.column(0).type
            ids, bounds = tokens.encode(text_column(batch, 1))
            for i, doc in enumerate(batch.column(0).to_pylist()):
                own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id))
                packer.add((doc, own), len(own))
            if packer.tokens >= WINDOW_TOKENS:
                packer.fill(CARRIED * capacity)
            if len(packer.rows):
                yield _pieces(packer.rows, id_type, with_ids)
                packer.rows = []
        packer.finish()
        if packer.rows:
            yield _pieces(packer.rows, id_type, with_ids)
        tokens.forget()

    return narrow.mapInArrow(
        packed,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long,"
        f" sequence_id long, offset long{extra}",
    ).withColumnRenamed("doc_id", ident)


def _pieces(rows: list[tuple], id_type: pa.DataType, with_ids: bool) -> pa.RecordBatch:
    parts = [doc[1][start : start + length] for doc, start, length, _, _ in rows]
    long = pa.int64()
    columns = {
        "doc_id": pa.array([doc[0] for doc, *_ in rows], id_type),
        "start": pa.array([r[1] for r in rows], long),
        "length": pa.array([r[2] for r in rows], long),
        "ids_crc32": pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], long),
        "doc_tokens": pa.array([len(doc[1]) for doc, *_ in rows], long),
        "sequence_id": pa.array([r[3] for r in rows], long),
        "offset": pa.array([r[4] for r in rows], long),
    }
    if with_ids:
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        values = pa.array(np.concatenate(parts).astype(np.int32))
        columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), values)
    return pa.RecordBatch.from_pydict(columns)
