"""Quality classifier: a factorisation machine over hashed words, structure and lengths of a text.

The score of a feature vector x is a logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

whose last term, the sum of all pairwise interactions <v_i, v_j> x_i x_j, takes time linear in the
number of features. Features: words (lower case, hashed, weighted by the logarithm of their count,
of length 1 together), structure statistics, and lengths, all taken from the text alone.

The model is fitted on a bounded sample of the labelled documents (``SAMPLE`` of each class at
most, those of the smallest seeded hashes). Scoring is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from tablekeep.llm.common import (
    col,
    layout,
    numbered,
    per_text,
    quoted,
    slices,
    text_column,
    words_of,
)
from tablekeep.llm.quality_rules import document_counts

SAMPLE = 3000  # labelled documents of each class, at most, that the model is fitted on
THRESHOLD = 0.7
BUCKETS = 1 << 13
FACTORS = 8
EPOCHS = 30
BATCH = 256
RATE = 0.02
DECAY = 1e-5
SEED = 42
HELD_OUT = 2  # remainder of crc32(id) by 4 whose labels are never learnt from

STRUCTURE = (
    "symbols",
    "capitals",
    "digits",
    "full stops and commas",
    "exclamations",
    "words without letters",
    "repeated lines",
    "repeated words",
    "different words",
    "log length of words",
    "log words per line",
    "log words",
    "log bytes",
)


@dataclass
class Rows:
    """Sparse feature rows: for each entry its row, its feature and its value."""

    row: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    structure: np.ndarray  # row, statistic

    def __len__(self) -> int:
        return len(self.structure)


def features(texts: pa.Array) -> Rows:
    """The features of a string array without nulls; an empty text has statistics of zero."""
    data, bounds = layout(texts)
    n = len(texts)
    counts = document_counts(texts)
    starts, ends, n_words = words_of(texts)
    words = np.maximum(1, n_words)
    size = np.maximum(1, np.diff(bounds))

    def of(marks: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(marks), bounds))

    capital = (data >= 65) & (data <= 90)
    capital[1:] |= (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)
    letter = capital | ((data >= 97) & (data <= 122)) | (data >= 0xC3)
    before = np.concatenate([[0], np.cumsum(letter)])
    owner = np.repeat(np.arange(n), n_words)
    bare = per_text(before[ends] == before[starts], owner, n)
    lines = of(data == 10) + 1

    low = pc.ascii_lower(texts)
    units = pc.ascii_split_whitespace(low).flatten()
    units = units.filter(pc.not_equal(pc.binary_length(units), 0)).dictionary_encode()
    hashed = np.fromiter(
        (xxhash.xxh32_intdigest(w.as_buffer(), SEED) & (BUCKETS - 1) for w in units.dictionary),
        np.int64,
        len(units.dictionary),
    )
    codes = units.indices.to_numpy(zero_copy_only=False)
    keys = owner * BUCKETS + (hashed[codes] if len(codes) else np.empty(0, np.int64))
    place, found = numbered(keys)
    times = np.bincount(place, minlength=len(found))
    row, feature = found // BUCKETS, found % BUCKETS
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=n))
    value = (value / norm[row]).astype(np.float32)
    different = np.bincount(row, minlength=n)

    structure = np.column_stack(
        [
            counts["n_symbols"] / size,
            of(capital) / np.maximum(1, of(letter)),
            of((data >= 48) & (data <= 57)) / size,
            of((data == 46) | (data == 44)) / words,
            of((data == 33) | (data == 63)) / words,
            bare / words,
            counts["n_dup_lines"] / lines,
            counts["n_repeat_words"] / words,
            different / words,
            np.log1p(counts["word_chars"] / words),
            np.log1p(n_words / lines),
            np.log1p(n_words),
            np.log1p(np.diff(bounds)),
        ]
    )
    return Rows(row, feature, value, structure)


@dataclass
class FactorisationMachine:
    """Weights of the hashed words, then of the statistics, which are centred and scaled first."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def scaled(self, rows: Rows) -> np.ndarray:
        return np.clip((rows.structure - self.centre) / self.scale, -4, 4) / 2

    def raw(self, rows: Rows) -> np.ndarray:
        """The score before the logistic, in time linear in the entries."""
        n, dense = len(rows), self.scaled(rows)
        w, v = rows.feature, rows.value
        result = self.bias + dense @ self.linear[BUCKETS:]
        result += np.bincount(rows.row, weights=self.linear[w] * v, minlength=n)
        for f in range(self.factors.shape[1]):
            own = self.factors[w, f] * v
            tail = dense * self.factors[BUCKETS:, f]
            total = np.bincount(rows.row, weights=own, minlength=n) + tail.sum(axis=1)
            squares = np.bincount(rows.row, weights=own * own, minlength=n)
            result += 0.5 * (total * total - squares - (tail * tail).sum(axis=1))
        return result

    def score(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def fit(rows: Rows, labels: np.ndarray, seed: int = SEED) -> FactorisationMachine:
    """Logistic loss, classes weighted alike, by Adam over mini-batches."""
    random = np.random.default_rng(seed)
    n, stats = len(rows), rows.structure.shape[1]
    size = BUCKETS + stats
    centre = rows.structure.mean(axis=0) if n else np.zeros(stats)
    scale = (rows.structure.std(axis=0) if n else np.ones(stats)) + 1e-6
    model = FactorisationMachine(
        0.0, np.zeros(size), random.normal(0, 0.05, (size, FACTORS)), centre, scale
    )
    positive = float(labels.mean()) if n else 0.5
    if positive in (0.0, 1.0) or not n:  # nothing to tell apart
        model.bias = 2.0 if positive == 1.0 else -2.0 if n else 0.0
        model.factors[:] = 0
        return model
    weight = np.where(labels == 1, 0.5 / positive, 0.5 / (1 - positive))
    dense = model.scaled(rows)
    order = np.argsort(rows.row, kind="stable")
    bounds = np.searchsorted(rows.row[order], np.arange(n + 1))
    table = np.zeros((size, 1 + FACTORS))  # linear weight and factors side by side
    table[:, 1:] = model.factors
    first, second = np.zeros_like(table), np.zeros_like(table)
    bias = bias_first = bias_second = 0.0
    step = 0
    tail = np.arange(BUCKETS, size)
    for _ in range(EPOCHS):
        mixed = random.permutation(n)
        for start in range(0, n, BATCH):
            chosen = mixed[start : start + BATCH]
            at = np.concatenate([order[bounds[i] : bounds[i + 1]] for i in chosen])
            lengths = bounds[chosen + 1] - bounds[chosen]
            row = np.concatenate(
                [np.repeat(np.arange(len(chosen)), lengths), np.repeat(np.arange(len(chosen)), stats)]
            )
            feature = np.concatenate([rows.feature[at], np.tile(tail, len(chosen))])
            value = np.concatenate([rows.value[at], dense[chosen].ravel()])
            seen, local = np.unique(feature, return_inverse=True)
            part = table[feature] * value[:, None]
            by_row = np.zeros((len(chosen), 1 + FACTORS))
            np.add.at(by_row, row, part)
            squares = np.bincount(row, weights=(part[:, 1:] ** 2).sum(axis=1))
            raw = bias + by_row[:, 0] + 0.5 * ((by_row[:, 1:] ** 2).sum(axis=1) - squares)
            off = (1 / (1 + np.exp(-raw)) - labels[chosen]) * weight[chosen] / len(chosen)
            slope = np.empty_like(part)
            slope[:, 0] = off[row] * value
            slope[:, 1:] = (off[row] * value)[:, None] * (by_row[row, 1:] - part[:, 1:])
            gradient = DECAY * table[seen]
            np.add.at(gradient, local, slope)
            step += 1
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            first[seen] = 0.9 * first[seen] + 0.1 * gradient
            second[seen] = 0.999 * second[seen] + 0.001 * gradient**2
            table[seen] -= rate * first[seen] / (np.sqrt(second[seen]) + 1e-8)
            bias_first = 0.9 * bias_first + 0.1 * off.sum()
            bias_second = 0.999 * bias_second + 0.001 * off.sum() ** 2
            bias -= rate * bias_first / (np.sqrt(bias_second) + 1e-8)
    model.bias, model.linear, model.factors = float(bias), table[:, 0], table[:, 1:]
    return model


def held_out(ident) -> object:
    """Whether a document's label is kept for testing: crc32 of the id as text is 2 modulo 4."""
    return F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(4)) == HELD_OUT


def train(
    docs: DataFrame,
    labels: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE,
    seed: int = SEED,
) -> FactorisationMachine:
    """Fit on at most ``sample`` documents of each class that are not held out.

    Documents without a label, with a null one or with labels that contradict each other are left
    out. The sample's feature rows, of a bounded number and size, come to the driver.
    """
    known = labels.select(col(labels, ident).alias("id"), col(labels, label).alias("y"))
    known = known.filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z")
    known = known.withColumn("h", F.xxhash64(F.lit(seed), "id"))
    picked = None
    for value in (0, 1):
        one = known.filter(F.col("y") == value).orderBy("h", "id").limit(sample)
        picked = one if picked is None else picked.unionByName(one)
    narrow = docs.select(col(docs, ident).alias("id"), col(docs, text).alias("t"))
    # two longs for each of 2 * sample rows at most: a proven bound
    joined = narrow.join(F.broadcast(picked.select("id", "y", "h")), "id").select("y", "h", "t")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            rows = features(text_column(batch, 2))
            order = np.argsort(rows.row, kind="stable")
            ends = np.cumsum(np.bincount(rows.row, minlength=len(rows)))
            ends = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            dense = pa.array(rows.structure.ravel())
            step = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.structure.shape[1])
            yield pa.record_batch(
                [
                    batch.column(0).cast(pa.int32()),
                    batch.column(1),
                    pa.ListArray.from_arrays(ends, pa.array(rows.feature[order].astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(rows.value[order])),
                    pa.ListArray.from_arrays(step, dense),
                ],
                names=["y", "h", "feature", "value", "structure"],
            )

    found = joined.mapInArrow(
        extracted,
        "y int, h long, feature array<int>, value array<float>, structure array<double>",
    )
    # rows of equal ids could be any number; the sample is bounded all the same
    found = found.orderBy("h", "y", F.hash("structure")).limit(2 * sample).toArrow()
    found = found.combine_chunks()
    lengths = pc.list_value_length(found["feature"]).to_numpy()
    rows = Rows(
        np.repeat(np.arange(len(found)), lengths),
        np.concatenate([np.empty(0, np.int64), *_flat(found["feature"])]).astype(np.int64),
        np.concatenate([np.empty(0, np.float32), *_flat(found["value"])]),
        np.concatenate([np.empty(0), *_flat(found["structure"])]).reshape(-1, len(STRUCTURE)),
    )
    return fit(rows, found["y"].to_numpy().astype(float), seed)


def _flat(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in column.chunks]


def score(
    docs: DataFrame, model: FactorisationMachine, text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The documents with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on).

    A null text is scored as an empty one. Columns of these names in the input are replaced.
    """
    docs = docs.drop("score", "predicted")
    names = docs.columns
    at = names.index(text)
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            values = model.score(features(text_column(batch, at)))
            predicted = (values >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values), pa.array(predicted)],
                names=[*names, "score", "predicted"],
            )

    return docs.mapInArrow(scored, f"{schema}, score double, predicted int")
