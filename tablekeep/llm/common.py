"""What the operators of this package share: tables, scratch tables and slices of Arrow batches."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tablekeep.session import scratch_folder

SLICE_BYTES = 2 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settled(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """The frame as a written table below the shared folder: cuts lineage and survives executors."""
    spark = df.sparkSession
    path = scratch_folder(spark, f"llm-{label}")
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, compared as Spark does by default."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(df: DataFrame, name: str):
    """The column of exactly that name, dots and back quotes included."""
    return df[quoted(name)]


def text_column(batch: pa.RecordBatch, index: int) -> pa.Array:
    """A column of strings or bytes with nulls as empty ones."""
    column = batch.column(index)
    empty = b"" if pa.types.is_binary(column.type) else ""
    return column.fill_null(empty) if column.null_count else column


def layout(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array one after the other, and the bounds of each text in them."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if len(texts) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1]
    bounds = bounds.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(
    batches: Iterable[pa.RecordBatch], index: int, size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of one slice stay near ``size`` bytes.

    A single longer text is a slice of its own. Free memory is given back after each batch.
    """
    for batch in batches:
        _, bounds = layout(text_column(batch, index))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[start] + size, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
        del batch, bounds
        give_back()


def give_back() -> None:
    """Give the memory that Arrow and the C library keep for later back to the system, as several
    workers, idle ones too, share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``layout(texts)``, and how many words each text has.

    A word is a run of bytes that are none of 20, 09 to 0D (hexadecimal).
    """
    data, bounds = layout(texts)
    solid = (data != 32) & ((data < 9) | (data > 13))
    before = np.empty(len(data), bool)
    before[1:] = solid[:-1]
    firsts = bounds[:-1][bounds[:-1] < len(data)]
    if len(data):
        before[firsts] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(data), bool)
    after[:-1] = solid[1:]
    if len(data):
        lasts = bounds[1:][bounds[1:] > 0] - 1
        after[lasts] = False
    ends = np.flatnonzero(solid & ~after) + 1
    counts = np.diff(np.searchsorted(starts, bounds))
    return starts, ends, counts


def per_text(values: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """The sum of ``values`` of each text."""
    return np.bincount(owner, weights=values, minlength=texts).astype(np.int64)


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each value, equal ones alike, in order of first appearance; and the values."""
    found = pa.array(values).dictionary_encode()
    numbers = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return numbers, found.dictionary.to_numpy(zero_copy_only=False)


class Recent(dict):
    """A dictionary of bounded size that forgets what was not asked for lately.

    ``self[key]`` is computed if it is not known. Half of the room is for what is new or was asked
    for since the other half was filled.
    """

    def __init__(self, size: int, compute: Callable):
        super().__init__()
        self.half, self.compute, self.older = size // 2, compute, {}

    def forget(self) -> None:
        """Let go of everything."""
        self.clear()
        self.older = {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.compute(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


def kept_in_process(name: str, make: Callable):
    """What ``make`` gave the first time, for as long as the Python worker lives."""
    store = sys.modules.setdefault("tablekeep_llm_kept", types.ModuleType("tablekeep_llm_kept"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)
