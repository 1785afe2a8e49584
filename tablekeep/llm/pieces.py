"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

A segmentation of a text into pieces is a path through a lattice. For unigram models the path of
the greatest sum of scores is wanted. For BPE models it is the path all of whose neighbouring pieces
stay apart when the two of them are encoded alone: that path exists once and is the encoding, so
allowed neighbours weigh 0 and others minus infinity.

A long text is split into chunks of any length. A state at the start of a chunk is how far the
piece that crosses it reaches in, and (for BPE) which piece that is. A chunk gives a transfer
matrix: the greatest weight from each state at its start to each at its end. Matrices combine by
max-plus products, which are associative; from the best state at the text's end the states at all
chunk bounds follow, and then each chunk is traced back by itself.

Between two characters that no piece has side by side every path passes one state, at word starts
above all. Stretches between such places are therefore encoded once each, and matrices need only the
cut stretches at the ends of a chunk; a chunk within one stretch is passed through the lattice
whole, and states whose further ways are the same merge.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tablekeep.llm.common import (
    Recent,
    col,
    kept_in_process,
    settled,
    slices,
    text_column,
)

CHUNK = 1 << 14  # code points
CACHED = 300_000
MERGED_EVERY = 64
SPACE = "▁"  # what stands for a blank in pieces
UNKNOWN = -1
FREE = 0  # the key of a state in which nothing before matters
UNKNOWN_PENALTY = 10.0

State = tuple[int, int]
Frontier = dict[int, dict[int, float]]  # position, key of the state, weight
Matrix = dict[State, dict[State, float]]


class Lattice:
    """The pieces of a model and the ways through a text."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        trainer, normal = model.trainer_spec, model.normalizer_spec
        kinds = proto.TrainerSpec
        if trainer.model_type not in (kinds.BPE, kinds.UNIGRAM):
            raise ValueError("only BPE and unigram models are encoded")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces:
            raise ValueError("only models that leave the text as it is are encoded")
        self.bpe = trainer.model_type == kinds.BPE
        self.prefix = SPACE if normal.add_dummy_prefix else ""
        self.bytes: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.scores: dict[int, float] = {}
        self.raw: list[bytes] = []  # what each id decodes to
        kind = proto.ModelProto.SentencePiece
        for i, piece in enumerate(model.pieces):
            raw = piece.piece.replace(SPACE, " ").encode()
            if piece.type == kind.NORMAL:
                self.ids[piece.piece] = i
                self.scores[i] = piece.score
            elif piece.type == kind.BYTE:
                value = int(piece.piece[3:5], 16)
                self.bytes[value] = i
                raw = bytes([value])
            elif piece.type == kind.USER_DEFINED:
                raise ValueError("models with user-defined pieces are not encoded")
            elif piece.type == kind.CONTROL:
                raw = b""
            else:
                self.unknown, raw = i, " ⁇ ".encode()
            self.raw.append(raw)
        if len(self.bytes) not in (0, 256):
            raise ValueError("byte pieces are not complete")
        self.reach = max(map(len, self.ids), default=1)
        # every end of a piece, and the id of those that are pieces themselves
        self.suffixes = {p[i:]: -1 for p in self.ids for i in range(len(p))} | self.ids
        self.lowest = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        # two characters that stand side by side in no piece are always apart
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.tree: dict = {}  # by characters; a piece's id stands under the empty string
        for piece, i in self.ids.items():
            node = self.tree
            for character in piece:
                node = node.setdefault(character, {})
            node[""] = i
        self.apart: dict[int, bool] = {}  # by both ids in one number
        self.words = Recent(CACHED, self._word)
        self.spelled = {i: p for p, i in self.ids.items()}

    # neighbours -----------------------------------------------------------------------------

    def _merged(self, text: str) -> list[str]:
        """Plain BPE of a short text: the best pair merges, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                own = self.ids.get(parts[i] + parts[i + 1])
                if own is not None and self.scores[own] > best:
                    best, at = self.scores[own], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _allowed(self, left: int, right: int) -> bool:
        """Whether two pieces stay apart; unknown characters and ``FREE`` touch nothing."""
        if right == UNKNOWN:
            return True
        left = max(left, FREE)
        pair = left << 32 | right
        found = self.apart.get(pair)
        if found is None:
            parts = [self.spelled[i] for i in (left, right) if i != FREE]
            found = self._merged("".join(parts)) == parts
            if len(self.apart) >= 2 * CACHED:
                self.apart.clear()
            self.apart[pair] = found
        return found

    def free(self, text: str, at: int) -> bool:
        """Whether no piece can span this place of a normalised text."""
        return not 0 < at < len(text) or text[at - 1 : at + 1] not in self.joined

    def _edges(self, text: str, end: int) -> list[tuple[int, int]]:
        """(length, id) of the pieces that end at a place, long ones first."""
        found = []
        for size in range(1, min(self.reach, end) + 1):
            part = text[end - size : end]
            own = self.suffixes.get(part)
            if own is None:
                break
            if own >= 0:
                found.append((size, own))
        if not found or found[0][0] != 1:
            found.insert(0, (1, UNKNOWN))
        found.reverse()
        return found

    # ways -----------------------------------------------------------------------------------

    def advance(
        self, text: str, frontier: Frontier, first: int, last: int, limit: int, trace=None
    ) -> None:
        """Extend the frontier to the places ``first`` to ``last`` by pieces that start before
        ``limit`` and at a place of the frontier."""
        bpe = self.bpe
        for end in range(first, last + 1):
            here = frontier.get(end, {})
            free = self.free(text, end)
            for size, own in self._edges(text, end):
                start = end - size
                if start >= limit or start not in frontier:
                    continue
                weight = 0.0 if bpe else self.scores.get(own, self.lowest)
                key = FREE if free or not bpe else own
                for before, value in frontier[start].items():
                    if bpe and not self._allowed(before, own):
                        continue
                    if value + weight > here.get(key, -math.inf):
                        here[key] = value + weight
                        if trace is not None:
                            trace[end, key] = (start, before, own)
            if here:
                frontier[end] = here

    def _trace(self, text: str, start: State, end: State, limit: int) -> list[int]:
        """The pieces of the best way between two states, given as (place, key)."""
        trace: dict = {}
        frontier = {start[0]: {start[1]: 0.0}}
        self.advance(text, frontier, start[0] + 1, end[0], limit, trace)
        found, state = [], end
        while state != start:
            place, before, own = trace[state]
            found.append(self._spell(text, place, own))
            state = (place, before)
        return [i for ids in reversed(found) for i in ids]

    def _spell(self, text: str, place: int, own: int) -> list[int]:
        if own != UNKNOWN:
            return [own]
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in text[place].encode("utf-8", "surrogatepass")]

    def _word(self, word: str) -> bytes:
        """The pieces of a word, from free place to free place; ids as bytes, which take less
        memory than numbers."""
        if not word[1:].isalpha():
            known, joined, parts, start = self.words, self.joined, [], 0
            for at in range(1, len(word)):
                if word[at - 1 : at + 1] not in joined:
                    parts.append(known[word[start:at]])
                    start = at
            if parts:
                parts.append(known[word[start:]])
                return b"".join(parts)
        return self._stretch(word)

    def _stretch(self, text: str) -> bytes:
        """The pieces between two free places, by the only way (BPE) or the best (unigram)."""
        if self.bpe:
            ids = self._only_way(text)
        else:
            ids = self._trace(text, (0, FREE), (len(text), FREE), len(text))
        return array("i", ids).tobytes()

    def _only_way(self, text: str) -> list[int]:
        """The only way of BPE pieces through a stretch, long pieces tried first.

        A beginning of the stretch has one way at most, so a place that once led nowhere is out.
        """
        tree, apart, n = self.tree, self.apart, len(text)
        way: list[tuple[int, int]] = []  # place, piece
        options: list[list[tuple[int, int]]] = []  # what is left to try at each place of the way
        dead: set[int] = set()
        at, before, tried = 0, FREE, None
        while at < n:
            if tried is None:
                tried, node, end = [], tree, at
                while end < n and (node := node.get(text[end])) is not None:
                    end += 1
                    if "" in node:
                        tried.append((end, node[""]))
                if not tried or tried[0][0] > at + 1:
                    tried.insert(0, (at + 1, UNKNOWN))
            while tried:
                end, own = tried.pop()
                if end in dead:
                    continue
                if own == UNKNOWN:
                    allowed = True
                else:
                    allowed = apart.get(before << 32 | own)
                    if allowed is None:
                        allowed = self._allowed(before, own)
                if allowed:
                    way.append((at, own))
                    options.append(tried)
                    at, before, tried = end, max(own, FREE), None
                    break
            else:
                dead.add(at)
                at, _ = way.pop()
                tried = options.pop()
                before = max(way[-1][1], FREE) if way else FREE
        found: list[int] = []
        for place, own in way:
            if own == UNKNOWN:
                found += self._spell(text, place, own)
            else:
                found.append(own)
        return found

    def _weight(self, word: str) -> float:
        """The weight of a word's best way."""
        frontier: Frontier = {0: {FREE: 0.0}}
        self.advance(word, frontier, 1, len(word), len(word))
        return frontier[len(word)][FREE]

    def words_between(self, text: str, start: int, end: int) -> np.ndarray:
        """The pieces between two free places."""
        known = self.words
        words = self.word.findall(text[start:end])
        return np.frombuffer(b"".join([known[w] for w in words]), np.int32)

    def normal(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        text = self.normal(text)
        return self.words_between(text, 0, len(text))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """``decode`` of many: the bytes of all pieces one after the other, cut at the bounds."""
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ids = lists.flatten()
        taken = pa.array(self.raw, pa.large_binary()).take(ids)
        _, offsets, data = taken.buffers()
        cuts = np.frombuffer(offsets, np.int64)[bounds + taken.offset] if len(ids) else bounds
        texts = pa.LargeStringArray.from_buffers(
            len(lists), pa.py_buffer(np.ascontiguousarray(cuts)), data or pa.py_buffer(b"")
        )
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            values = ids.to_numpy(zero_copy_only=False)
            parts = [values[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
            return pa.array([self.decode(part) for part in parts], pa.string())
        if self.prefix:
            first = pc.starts_with(texts, " ")
            texts = pc.if_else(first, pc.utf8_slice_codeunits(texts, 1), texts)
        return texts.cast(pa.string())

    # chunks ---------------------------------------------------------------------------------

    def _free_after(self, text: str, a: int, b: int) -> int | None:
        """The first free place that no piece starting before ``a`` reaches over."""
        return next((i for i in range(a + self.reach, b) if self.free(text, i)), None)

    def _free_before(self, text: str, a: int, b: int) -> int:
        return next(i for i in range(b, a, -1) if self.free(text, i))

    def entries(self, text: str, a: int) -> list[State]:
        """The states at a chunk's start: how far a piece from before reaches in, and which."""
        found = set()
        for over in range(min(self.reach, len(text) - a + 1)):
            if self.free(text, a + over):
                found |= {(over, FREE) for s, _ in self._edges(text, a + over) if s > over}
                break  # nothing reaches over a free place
            found |= {
                (over, own if self.bpe else FREE)
                for size, own in self._edges(text, a + over)
                if size > over
            }
        return sorted(found)

    def _exits(self, text: str, frontier: Frontier, b: int) -> dict[State, float]:
        last = min(len(text), b + self.reach - 1)
        self.advance(text, frontier, b + 1, last, b)
        return {
            (place - b, key): value
            for place, states in frontier.items()
            if place >= b
            for key, value in states.items()
        }

    def transfer(self, text: str, a: int, b: int) -> Matrix:
        """The matrix of the chunk from ``a`` to ``b`` of a text that goes on on both sides as far
        as a piece reaches, or ends there."""
        starts = self.entries(text, a) if a else [(0, FREE)]
        stop = self._free_after(text, a, b)
        if stop is None:
            return self._whole(text, a, b, starts)
        back = self._free_before(text, stop - 1, b)
        between = 0.0
        if not self.bpe:
            between = sum(map(self._weight, self.word.findall(text[stop:back])))
        frontier = {back: {FREE: between}}
        self.advance(text, frontier, back + 1, b, b)
        tail = self._exits(text, frontier, b)
        matrix: Matrix = {}
        for over, key in starts:
            frontier = {a + over: {key: 0.0}}
            self.advance(text, frontier, a + over + 1, stop, stop)
            head = frontier.get(stop, {}).get(FREE)
            if head is not None:
                matrix[over, key] = {state: head + value for state, value in tail.items()}
        return matrix

    def _whole(self, text: str, a: int, b: int, starts: list[State]) -> Matrix:
        """A chunk within one word: all start states side by side, merged where they agree."""
        ways = [({a + over: {key: 0.0}}, {(over, key): 0.0}) for over, key in starts]
        at = a
        while at < b:
            stop = min(b, at + MERGED_EVERY)
            merged: dict[tuple, tuple[Frontier, dict[State, float]]] = {}
            for frontier, members in ways:
                self.advance(text, frontier, at + 1, stop, b)
                live = {p: s for p, s in frontier.items() if p > stop - self.reach}
                if not live:
                    continue  # no way leads on
                top = max(v for s in live.values() for v in s.values())
                live = {p: {k: v - top for k, v in s.items()} for p, s in live.items()}
                known = tuple(sorted((p, k, v) for p, s in live.items() for k, v in s.items()))
                own = merged.setdefault(known, (live, {}))[1]
                own |= {state: value + top for state, value in members.items()}
            ways, at = list(merged.values()), stop
        matrix: Matrix = {}
        for frontier, members in ways:
            exits = self._exits(text, frontier, b)
            for state, value in members.items():
                if exits:
                    matrix[state] = {end: value + own for end, own in exits.items()}
        return matrix

    def trace_chunk(self, text: str, a: int, b: int, entry: State, out: State) -> np.ndarray:
        """The ids of the pieces that start in a chunk, given its states at both ends."""
        start, end = (a + entry[0], entry[1]), (b + out[0], out[1])
        stop = self._free_after(text, a, b)
        if stop is None:
            return np.array(self._trace(text, start, end, b), np.int32)
        back = self._free_before(text, stop - 1, b)
        head = self._trace(text, start, (stop, FREE), stop)
        tail = self._trace(text, (back, FREE), end, b)
        parts = [head, self.words_between(text, stop, back), tail]
        return np.concatenate(parts).astype(np.int32)


def combined(left: Matrix, right: Matrix) -> Matrix:
    """The max-plus product: the matrix of two chunks as one."""
    out: Matrix = {}
    for start, ways in left.items():
        best: dict[State, float] = {}
        for middle, one in ways.items():
            for end, two in right.get(middle, {}).items():
                if one + two > best.get(end, -math.inf):
                    best[end] = one + two
        if best:
            out[start] = best
    return out


def bound_states(matrices: list[Matrix]) -> list[State]:
    """The states at all chunk bounds on the best way through a whole text.

    The chunks are halved again and again: the product of each half gives the best state between
    them, given those at both ends.
    """
    products: dict[tuple[int, int], Matrix] = {}

    def product(a: int, b: int) -> Matrix:
        if (a, b) not in products:
            if b - a == 1:
                products[a, b] = matrices[a]
            else:
                middle = (a + b) // 2
                products[a, b] = combined(product(a, middle), product(middle, b))
        return products[a, b]

    start = (0, FREE)
    ends = product(0, len(matrices))[start]
    states = {0: start, len(matrices): max(ends, key=lambda s: (ends[s], s))}
    open_ranges = [(0, len(matrices))]
    while open_ranges:
        a, b = open_ranges.pop()
        if b - a < 2:
            continue
        middle = (a + b) // 2
        left, right = product(a, middle)[states[a]], product(middle, b)
        end = states[b]
        reached = {s: v + right[s][end] for s, v in left.items() if end in right.get(s, {})}
        states[middle] = max(reached, key=lambda s: (reached[s], s))
        open_ranges += [(a, middle), (middle, b)]
    return [states[i] for i in range(len(matrices) + 1)]


def encode_in_chunks(lattice: Lattice, text: str, chunk: int) -> np.ndarray:
    """What the scan over chunks gives for one text, in one place."""
    text = lattice.normal(text)
    if not text:
        return np.empty(0, np.int32)
    bounds = [(a, min(a + chunk, len(text))) for a in range(0, len(text), chunk)]
    states = bound_states([lattice.transfer(text, a, b) for a, b in bounds])
    found = [
        lattice.trace_chunk(text, a, b, s, e) for (a, b), s, e in zip(bounds, states, states[1:])
    ]
    return np.concatenate(found)


def _lattice(model: str) -> Lattice:
    return kept_in_process(f"lattice {model}", lambda: Lattice(model))


def _matrix_rows(matrix: Matrix) -> list[tuple]:
    return [(*start, *end, value) for start, ways in matrix.items() for end, value in ways.items()]


def _matrix(rows: list) -> Matrix:
    out: Matrix = {}
    for over, key, end_over, end_key, value in rows:
        out.setdefault((over, key), {})[end_over, end_key] = value
    return out


def encode(
    docs: DataFrame, model: str, ident: str = "doc_id", text: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """The id, ``n_chars``, ``n_chunks`` and ``ids`` (array) of each document.

    Documents of at most ``chunk`` code points are encoded where they are read. Longer ones are
    written out, split, and their chunks dealt over all tasks, whatever document they are of. A null
    text counts as empty and has no ids. Rows stand by themselves: repeated rows and null ids are
    encoded like others; other columns are not returned.
    """
    rows = docs.select(
        col(docs, ident).alias("id"), F.coalesce(col(docs, text), F.lit("")).alias("text")
    ).withColumn("n_chars", F.length("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model)
        for batch in slices(batches, 1):
            ids = [lattice.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.empty(0, np.int32), *ids]))
            one = pa.array(np.ones(len(ids), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2).cast(pa.int64()), one, lists],
                ["id", "n_chars", "n_chunks", "ids"],
            )

    short = rows.filter(F.col("n_chars") <= chunk)
    schema = f"id {kind}, n_chars long, n_chunks int, ids array<int>"
    encoded = short.mapInArrow(whole, schema)
    giant = rows.filter(F.col("n_chars") > chunk).withColumn(
        "row", F.monotonically_increasing_id()
    )
    scanned = _scanned(settled(giant, "pieces-giant"), model, chunk)
    return encoded.unionByName(scanned).withColumnRenamed("id", ident)


def _scanned(giant: DataFrame, model: str, chunk: int) -> DataFrame:
    """Giant documents: matrices of their chunks, states at the bounds, then each chunk's ids."""
    # a piece reaches over a bound by less than this; the prefix makes the text longer by one
    beside = 64
    normal = giant.withColumn(
        "chunks", F.ceil((F.col("n_chars") + 1) / F.lit(chunk)).cast("int")
    ).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    begin = F.greatest(F.col("i") * chunk - beside - 1, F.lit(0))
    chunks = normal.select(
        "row",
        "i",
        F.col("chunks").alias("n"),
        F.expr(f"substring(text, cast({'greatest(i * %d - %d, 0)' % (chunk, beside + 1)} as int)"
               f" + 1, {chunk + 2 * beside + 2})").alias("text"),
        begin.alias("begin"),
        F.col("n_chars"),
    ).repartition("row", "i")
    chunks = settled(chunks, "pieces-chunks")

    def place(lattice: Lattice, batch: pa.RecordBatch) -> Iterator[tuple]:
        """Per chunk its row, number, normalised text and bounds in that."""
        if lattice.reach >= beside:
            raise ValueError("pieces are longer than what is known beside a chunk")
        columns = (batch.column(n).to_pylist() for n in ("row", "i", "n", "text", "begin", "n_chars"))
        for row, i, n, text, begin, n_chars in zip(*columns):
            shift = len(lattice.prefix)
            text = text.replace(" ", SPACE)
            if begin == 0:
                text, begin = lattice.prefix + text, -shift
            first = i * chunk - shift - begin
            last = min((i + 1) * chunk, n_chars + shift) - shift - begin
            yield row, i, text, first, max(first, last)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model)
        for batch in slices(batches, 3):
            out = []
            for row, i, text, a, b in place(lattice, batch):
                # an empty last chunk passes on what reaches its start
                found = lattice.transfer(text, a, b) if b > a else {(0, FREE): {(0, FREE): 0.0}}
                for start, key, end, end_key, value in _matrix_rows(found):
                    out.append((row, i, start, key, end, end_key, value))
            names = ["row", "i", "o1", "k1", "o2", "k2", "w"]
            kinds = [pa.int64(), *[pa.int32()] * 5, pa.float64()]
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names
            )

    entries = chunks.mapInArrow(
        matrices, "row long, i int, o1 int, k1 int, o2 int, k2 int, w double"
    )

    def ends(table: pa.Table) -> pa.Table:
        by_chunk: dict[int, list] = {}
        for row in zip(*(table[n].to_pylist() for n in ("i", "o1", "k1", "o2", "k2", "w"))):
            by_chunk.setdefault(row[0], []).append(row[1:])
        states = bound_states([_matrix(by_chunk[i]) for i in range(len(by_chunk))])
        n = len(states) - 1
        return pa.table(
            {
                "row": pa.array([table["row"][0].as_py()] * n, pa.int64()),
                "i": pa.array(range(n), pa.int32()),
                "o1": pa.array([s[0] for s in states[:-1]], pa.int32()),
                "k1": pa.array([s[1] for s in states[:-1]], pa.int32()),
                "o2": pa.array([s[0] for s in states[1:]], pa.int32()),
                "k2": pa.array([s[1] for s in states[1:]], pa.int32()),
            }
        )

    # the matrices of one document: a few numbers for each chunk of a text that fits a row
    states = entries.groupBy("row").applyInArrow(
        ends, "row long, i int, o1 int, k1 int, o2 int, k2 int"
    )
    joined = chunks.join(settled(states, "pieces-states"), ["row", "i"]).select(
        *chunks.columns, "o1", "k1", "o2", "k2"
    )

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model)
        for batch in slices(batches, 3):
            sides = zip(*(batch.column(n).to_pylist() for n in ("o1", "k1", "o2", "k2")))
            out = []
            for (row, i, text, a, b), (o1, k1, o2, k2) in zip(place(lattice, batch), sides):
                found = lattice.trace_chunk(text, a, b, (o1, k1), (o2, k2)) if b > a else _NONE
                out.append((row, i, found))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.int32()),
                    pa.array([x[2] for x in out], pa.list_(pa.int32())),
                ],
                ["row", "i", "part"],
            )

    parts = joined.mapInArrow(traced, "row long, i int, part array<int>")
    texts = parts.groupBy("row").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", "part"))), lambda x: x.part))
        .alias("ids"),
        F.count("*").cast("int").alias("n_chunks"),
    )
    return giant.select("row", "id", "n_chars").join(texts, "row").select(
        "id", F.col("n_chars").cast("long").alias("n_chars"), "n_chunks", "ids"
    )


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded``, the text of their ids, and ``ids_crc32`` (as little-endian
    unsigned 32-bit numbers) instead of the ids. Null ids count as none."""
    encoded = encoded.drop("decoded", "ids_crc32")
    names = [n for n in encoded.columns if n != ids]
    at = len(names)
    rows = encoded.select(*[col(encoded, n) for n in names], col(encoded, ids))
    schema = rows.drop(ids).schema.add("decoded", "string").add("ids_crc32", "long")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model)
        for batch in batches:
            lists = batch.column(at)
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(values[a:b]) for a, b in zip(ends, ends[1:])]
            texts = lattice.decode_all(lists)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], texts, pa.array(sums, pa.int64())],
                [*names, "decoded", "ids_crc32"],
            )

    return rows.mapInArrow(decoded, schema)


_NONE = np.empty(0, np.int32)
