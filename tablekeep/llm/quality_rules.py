"""Quality rules: counts per document, and line frequency across the documents of a host.

A line that many distinct documents of one host share is boilerplate. Lines are normalised
(lower case, digits made 0, punctuation and outer white space dropped) and hashed; per host the
distinct documents of each line are counted, exact copies of a text as one. Lines above the limit
are removed, and documents that lose too many of their words are rejected, as are those that fail
the base rules.

Near copies of one document share lines, too, which are no boilerplate. A document is taken for a
near copy if at least 0.8 of its words are in lines found more than half as often as the limit.
For each of its lines such documents count by a sketch, the smallest hash of their other lines of
that kind, so that a group of them counts as one document or a few, while boilerplate around texts
that differ counts once a document, however thin these are. The limit is a number of documents,
the same for hosts of any size. If the frequent lines outgrow a broadcast, they are joined to the
lines of the distinct documents by host and line, salted, and each document gets those of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tablekeep.llm.common import (
    col,
    free_name,
    layout,
    numbered,
    per_text,
    settled,
    slices,
    text_column,
    words_of,
)

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
SYMBOLS = b"#*$%&|<>"

LIMIT = 10  # documents of a host that may share a line
MIN_LEFT = 0.5  # of a document's words, after its frequent lines are gone
BROADCAST_BYTES = 8 << 20
NEAR_COPY = 0.8  # of a document's words, in lines that others have
SALTS = 64  # parts that the documents of one line are dealt into

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*COUNTS, "removed_words", "base_failed", "kept", "clean_text")

_DIGITS = re.compile(r"\d")
_OTHER = re.compile(r"[^\w\s]+")


def normal_line(line: str) -> str:
    """What two lines must have in common to count as one; empty for lines without a word."""
    return " ".join(_OTHER.sub("", _DIGITS.sub("0", line.lower())).split())


def _hash(text: str) -> int:
    """A signed 64-bit hash."""
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


class _Lines:
    """The lines of a slice of texts: code of each, the distinct lines, and the owner of each."""

    def __init__(self, texts: pa.Array):
        parts = pc.split_pattern(texts, "\n")
        encoded = parts.flatten().dictionary_encode()
        self.codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = encoded.dictionary.to_pylist()
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        self.owner = np.repeat(np.arange(len(texts)), counts)
        words = words_of(encoded.dictionary)[2] if self.distinct else np.empty(0, np.int64)
        self.words = words[self.codes] if len(words) else np.empty(0, np.int64)

    def hashes(self) -> np.ndarray:
        """The hash of each line's normal form; lines whose normal form is empty have 0."""
        normal = [normal_line(x) for x in self.distinct]
        own = np.array([_hash(x) if x else 0 for x in normal], np.int64)
        return own[self.codes] if len(own) else np.empty(0, np.int64)


def document_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text of a string array without nulls."""
    data, bounds = layout(texts)
    n = len(texts)
    _, _, n_words = words_of(texts)
    solid = (data != 32) & ((data < 9) | (data > 13))
    heads = solid & ((data & 0xC0) != 0x80)
    symbols = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))

    def within(marks: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(marks), bounds))

    lines = _Lines(texts)
    own = numbered(lines.owner * max(1, len(lines.distinct)) + lines.codes)[0]
    again = own < np.arange(len(own))  # a first one has the next free number
    again[1:] = own[1:] <= np.maximum.accumulate(own)[:-1]
    dup_lines = per_text(again & (lines.words > 0), lines.owner, n)
    return {
        "n_words": n_words,
        "word_chars": within(heads),
        "n_symbols": within(symbols),
        "n_dup_lines": dup_lines,
        "n_repeat_words": _repeated_words(texts, n_words),
    }


def _repeated_words(texts: pa.Array, n_words: np.ndarray) -> np.ndarray:
    """Per text the words that lie in a window of three words found at least twice in it."""
    words = pc.ascii_split_whitespace(texts).flatten()
    words = words.filter(pc.not_equal(pc.binary_length(words), 0))
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    total = len(codes)
    if total < 3:
        return np.zeros(len(texts), np.int64)
    owner = np.repeat(np.arange(len(texts)), n_words)
    # numbers for pairs, then for triples, then for triples of one text: all exact
    pairs = numbered(codes[:-1] * (codes.max() + 1) + codes[1:])[0]
    triples = numbered(pairs[:-1] * (codes.max() + 1) + codes[2:])[0]
    own = numbered(triples * len(texts) + owner[:-2])[0]
    inside = owner[:-2] == owner[2:]
    twice = inside & (np.bincount(own, weights=inside)[own] > 1)
    marked = np.zeros(total, bool)
    for shift in range(3):
        marked[shift : total - 2 + shift] |= twice
    return per_text(marked, owner, len(texts))


def _keys(docs: DataFrame, text: str, host: str) -> tuple[Column, Column]:
    """The host of a document and the hash of its text; a null text is an empty one."""
    kind = docs.schema[text].dataType
    whole = F.xxhash64(F.coalesce(col(docs, text), F.lit("").cast(kind)))
    return col(docs, host).cast("string"), whole


def line_table(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``h``, ``line``, ``doc`` and ``words``: the hashed lines of each host's distinct texts.

    Line 0 stands for the document itself, with all of its words.
    """
    name, whole = _keys(docs, text, host)
    narrow = docs.select(col(docs, text).alias("t"), name.alias("h"), whole.alias("doc"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            texts = text_column(batch, 0)
            found = _Lines(texts)
            total = per_text(found.words, found.owner, len(texts))
            hashes = found.hashes()
            some = hashes != 0
            number, different = numbered(hashes[some])
            pair, pairs = numbered(number * len(texts) + found.owner[some])
            own = np.bincount(pair, weights=found.words[some], minlength=len(pairs)).astype(np.int64)
            owner = np.concatenate([pairs % len(texts), np.arange(len(texts))])
            line = np.concatenate([different[pairs // len(texts)], np.zeros(len(texts), np.int64)])
            words = np.concatenate([own, total])
            rows = pa.array(owner)
            yield pa.record_batch(
                [batch.column(1).take(rows), pa.array(line), batch.column(2).take(rows), pa.array(words)],
                names=["h", "line", "doc", "words"],
            )

    found = narrow.mapInArrow(lines, "h string, line long, doc long, words long")
    return settled(found.distinct(), "lines")


def frequent_lines(lines: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``h`` and ``line``: the lines of each host (a null host is one too) above the limit.

    A line is above it if more than ``limit`` documents of the host have it. Documents with equal
    texts count as one, and so do near copies with the same sketch.
    """
    counted = lines.filter("line != 0").groupBy("h", "line").agg(F.count("*").alias("n"))
    shared = settled(counted.filter(2 * F.col("n") > limit), "shared-lines")
    members = _members(lines, shared)
    whole = lines.filter("line = 0").withColumn("n", F.lit(None).cast("long"))
    own = F.col("line") != 0
    per_doc = (
        members.unionByName(whole)
        .groupBy("h", "doc")
        .agg(
            F.sum(F.when(~own, F.col("words"))).alias("total"),
            F.sum(F.when(own, F.col("words"))).alias("common"),
            F.array_sort(F.collect_list(F.when(own, F.struct("line", "n")))).alias("found"),
        )
    )
    near = F.col("common") >= NEAR_COPY * F.col("total")
    first = F.expr("try_element_at(found, 1).line").alias("first")
    second = F.expr("try_element_at(found, 2).line").alias("second")
    votes = per_doc.select("h", "doc", near.alias("near"), first, second, F.inline("found"))
    other = F.when(F.col("line") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    voter = F.when(F.col("near"), F.coalesce(other, "line")).otherwise(F.col("doc"))
    votes = votes.filter(F.col("n") > limit).select("h", "line", "near", voter.alias("voter"))
    votes = votes.distinct().groupBy("h", "line").agg(F.count("*").alias("votes"))
    return votes.filter(F.col("votes") > limit).select("h", "line")


def _bytes(lines: DataFrame) -> int:
    """The size of a settled list of hosts and lines."""
    return lines.agg(F.sum(F.coalesce(F.octet_length("h"), F.lit(0)) + 16)).first()[0] or 0


def _members(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose host and line are in ``chosen``, with its other columns."""
    wanted = chosen.withColumnsRenamed({"h": "h1", "line": "l1"})
    same = F.col("h").eqNullSafe(F.col("h1")) & (F.col("line") == F.col("l1"))
    if _bytes(chosen) <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted.withColumn("salt", F.lit(0)))
    else:  # not to be broadcast: its size is underrated
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        wanted = wanted.withColumn("salt", salts).hint("merge")
        same &= F.pmod("doc", F.lit(SALTS)) == F.col("salt")
    return lines.filter("line != 0").join(wanted, same).drop("h1", "l1", "salt")


def _listed(lines: DataFrame, docs: DataFrame, text: str, host: str, chosen: DataFrame, name: str) -> DataFrame:
    """The documents with a last column ``name``: which of the chosen lines each has."""
    own = _members(lines, chosen).groupBy("h", "doc").agg(F.collect_set("line").alias(name))
    hosts, whole = _keys(docs, text, host)
    on_host, on_doc = free_name(docs, "frequent_host"), free_name(docs, "frequent_doc")
    own = own.toDF(on_host, on_doc, name)
    same = hosts.eqNullSafe(own[on_host]) & (whole == own[on_doc])
    # Spark splits the copies of one text
    return docs.join(own, same, "left").drop(on_host, on_doc)


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    limit: int = LIMIT,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """The documents with their counts, the verdict and the text without its frequent lines.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows of
    three words. ``kept``: base rules passed, and at least ``min_left`` of the words stay when the
    host's frequent lines go. ``clean_text`` is the text without these lines (null for a null text,
    which counts as empty). Columns of the input that have the name of an added one are replaced.
    Rows stand by themselves: repeated rows and repeated or null ids are all judged.
    """
    docs = docs.drop(*[n for n in ADDED if n.lower() not in (text.lower(), host.lower())])
    lines = line_table(docs, text, host)
    common = settled(frequent_lines(lines, limit), "frequent-lines")
    names = docs.columns
    listed = free_name(docs, "frequent_lines")
    by_host: dict[str | None, np.ndarray] = {}
    broadcast = _bytes(common) <= BROADCAST_BYTES
    if broadcast:
        found: dict[str | None, list[int]] = {}
        for row in common.collect():
            found.setdefault(row.h, []).append(row.line)
        by_host = {h: np.sort(np.array(x, np.int64)) for h, x in found.items()}
        joined = docs.withColumn(listed, col(docs, host).cast("string"))
    else:
        joined = _listed(lines, docs, text, host, common, listed)

    def frequent(column: pa.Array) -> list[np.ndarray | None]:
        if broadcast:
            return [by_host.get(h) for h in column.to_pylist()]
        return [x and np.sort(np.array(x, np.int64)) for x in column.to_pylist()]

    kinds = [*docs.schema.fields]
    schema = ", ".join(
        [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kinds]
        + [f"{n} long" for n in (*COUNTS, "removed_words")]
        + ["base_failed boolean", "kept boolean", "clean_text string"]
    )
    at = names.index(text)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts = text_column(batch, at)
            counts = document_counts(texts)
            removed, clean = _without(texts, frequent(batch.column(len(names))))
            n = counts["n_words"]
            failed = (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED * n)
            kept = ~failed & (n - removed >= min_left * n)
            if batch.column(at).null_count:
                clean = pc.if_else(batch.column(at).is_null(), pa.scalar(None, pa.string()), clean)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(names)],
                    *[pa.array(counts[c]) for c in COUNTS],
                    pa.array(removed),
                    pa.array(failed),
                    pa.array(kept),
                    clean,
                ],
                names=[*names, *ADDED],
            )

    return joined.mapInArrow(judged, schema)


def _without(texts: pa.Array, frequent: list[np.ndarray | None]) -> tuple[np.ndarray, pa.Array]:
    """Words lost by each text with its frequent lines (sorted hashes), and the texts without them."""
    removed = np.zeros(len(texts), np.int64)
    if all(x is None for x in frequent):
        return removed, texts.cast(pa.string())
    lines = _Lines(texts)
    own = lines.hashes()
    marked = np.zeros(len(own), bool)
    bounds = np.searchsorted(lines.owner, np.arange(len(texts) + 1))
    for i, known in enumerate(frequent):
        if known is not None:
            part = own[bounds[i] : bounds[i + 1]]
            at = np.minimum(np.searchsorted(known, part), len(known) - 1)
            marked[bounds[i] : bounds[i + 1]] = known[at] == part
    gone = np.flatnonzero(marked)
    if not len(gone):
        return removed, texts.cast(pa.string())
    np.add.at(removed, lines.owner[gone], lines.words[gone])
    changed = texts.to_pylist()
    for i in np.unique(lines.owner[gone]).tolist():
        a, b = bounds[i], bounds[i + 1]
        kept = [lines.distinct[c] for c, m in zip(lines.codes[a:b], marked[a:b]) if not m]
        changed[i] = "\n".join(kept)
    return removed, pa.array(changed, pa.string())
