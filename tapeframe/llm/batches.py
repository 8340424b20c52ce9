"""Arrow batches of texts, and hashes of their words.

Every Python step of the operators maps Arrow batches to Arrow batches
(``mapInArrow``): Spark deals the rows out, a lost executor only repeats its tasks,
and memory is bounded by a batch.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SPACES = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 19


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def add_columns(df: DataFrame, fields: dict[str, T.DataType], compute: Callable[[pa.RecordBatch], list[pa.Array]], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without ``drop``, and the columns that ``compute`` makes of each of its batches."""
    keep = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType([*keep, *(T.StructField(n, t) for n, t in fields.items())])
    places = [i for i, f in enumerate(df.schema.fields) if f.name not in drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *compute(part)], names=schema.names)

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, schema: str | T.StructType, compute: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """The rows that ``compute`` makes of each batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                yield compute(part)

    return df.mapInArrow(run, schema)


def byte_slices(batch: pa.RecordBatch, limit: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes, at least a row each."""
    if batch.nbytes <= limit or batch.num_rows < 2:
        yield batch
        return
    half = batch.num_rows // 2
    yield from byte_slices(batch.slice(0, half), limit)
    yield from byte_slices(batch.slice(half), limit)


BUILT: dict[str, object] = {}


class Shared:
    """A broadcast of bounded data; calling it in a task gives what ``build`` makes of it, once in each Python worker."""

    def __init__(self, spark: SparkSession, value: object, build: Callable = lambda x: x) -> None:
        self.key, self.data, self.build = uuid.uuid4().hex, spark.sparkContext.broadcast(value), build

    def __call__(self):
        if self.key not in BUILT:
            while len(BUILT) > 1:
                BUILT.pop(next(iter(BUILT)))
            BUILT[self.key] = self.build(self.data.value)
        return BUILT[self.key]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows; null is empty."""
    array = array.fill_null("") if array.null_count else array
    array = array.cast(pa.large_binary())
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of many texts at once.

    A word is a maximal run of bytes that ``word`` marks; ``fold`` maps each byte first.
    Its hash takes in eight bytes at a time, each followed by a mixing of the whole state, so
    no pattern of letters makes unequal words meet: words of one length up to eight bytes
    never do, others by chance only, one pair in 2**64.  Words beyond ``LONG`` bytes are
    hashed by blake2b.
    """

    KEY = np.uint64(0x9E3779B97F4A7C15)
    LONG = 1 << 10

    def __init__(self, word: np.ndarray, fold: np.ndarray) -> None:
        self.word, self.fold = word[fold], fold

    def hashes(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        padded = np.zeros(len(data) + 8, np.uint8)
        np.take(self.fold, data, out=padded[:-8])
        eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        size = end - first
        out = mix(size.astype(np.uint64) * self.KEY + np.uint64(1))
        at, place = np.arange(len(first)), 0
        while len(at):
            left = size[at] - place
            unused = np.uint64(8) * np.maximum(8 - left, 0).astype(np.uint64)
            out[at] = mix(out[at] ^ (eight[first[at] + place] & (~np.uint64(0) >> unused)))
            place += 8
            at = at[(left > 8) & (size[at] <= self.LONG)]
        for i in np.flatnonzero(size > self.LONG).tolist():
            digest = hashlib.blake2b(padded[first[i] : end[i]].tobytes(), digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little")
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all words, the n + 1 offsets of the rows among them, and each word's first byte and end."""
        n = len(data)
        if n == 0:
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
        inside = self.word[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        start = inside & cut[:n]
        start[1:] |= inside[1:] & ~inside[:-1]
        stop = inside & cut[1:]
        stop[:-1] |= inside[:-1] & ~inside[1:]
        first, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
        hashes = self.hashes(data, first, end)
        return hashes, np.searchsorted(first, offsets).astype(np.int64), first, end


def space_words(lower: bool) -> WordHasher:
    """Words between white space; with ``lower``, A-Z count as a-z."""
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    word = np.ones(256, bool)
    word[list(SPACES)] = False
    return WordHasher(word, fold)


def list_array(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))

