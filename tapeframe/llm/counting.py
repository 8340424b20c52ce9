"""Counting Bloom sketches over the hashes of a table, merged, and tested in slices.

A hash belongs to a slice by its high bits and has ``PROBES`` cells within the slice.  Each
task counts the cells of its hashes and hands the counts on by block of cells; merging adds
them up, one block at a time.  A hash one of whose cells has a count of 1 occurs once for
certain.  There are so many slices that each cell is meant for few hashes, whatever the
size of the table, and the broadcast is one slice of ``SLICE_CELLS`` bits (count of 2 or
more) at a time, tested only against the rows of its own slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.llm.batches import Shared, add_columns, column, mix
from tapeframe.session import cut_lineage

SLICE_CELLS = 1 << 28
CELLS_PER_HASH = 8
PROBES = 2
BLOCK = 1 << 16
FLUSH = 1 << 20


def cells(hashes: np.ndarray, size: int) -> np.ndarray:
    """Positions of the hashes within their slice of ``size`` cells: one row a probe."""
    mask, first, step = np.uint64(size - 1), mix(hashes), mix(hashes + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    return np.stack([(first + np.uint64(i) * step) & mask for i in range(PROBES)])


def counted(places: np.ndarray) -> pa.RecordBatch:
    """Counts of the cells ``places`` (the slice in their high bits), by block."""
    cell, count = np.unique(places, return_counts=True)
    block, offset = (cell >> np.uint64(16)).astype(np.int64), (cell & np.uint64(BLOCK - 1)).astype("<u2")
    heads = np.flatnonzero(np.diff(block, prepend=-1))
    ends, count = np.append(heads[1:], len(block)), np.minimum(count, 255).astype(np.uint8)
    binary = [pa.array([x[a:b].tobytes() for a, b in zip(heads, ends)], pa.binary()) for x in (offset, count)]
    return pa.RecordBatch.from_arrays([pa.array(block[heads]), *binary], names=["block", "offsets", "counts"])


def sketch(rows: DataFrame, size: int) -> DataFrame:
    """(block, bits): the cells whose merged count is 2 or more; ``rows`` has hash and slice."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            hashes, slices = column(batch, "hash").to_numpy().view(np.uint64), column(batch, "slice").to_numpy().astype(np.uint64)
            held.append((cells(hashes, size) + slices * np.uint64(size)).ravel())
            count += len(held[-1])
            if count >= FLUSH:
                yield counted(np.concatenate(held))
                held, count = [], 0
        if count:
            yield counted(np.concatenate(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(BLOCK, np.uint8)

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([np.packbits(total >= 2, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for block, offsets, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if block != key:
                    if key is not None and (total >= 2).any():
                        yield close()
                    key, total = block, np.zeros(BLOCK, np.uint8)
                at = np.frombuffer(offsets, "<u2")
                total[at] = np.minimum(total[at] + np.minimum(np.frombuffer(counts, np.uint8), 2), 2)
        if key is not None and (total >= 2).any():
            yield close()

    partial = rows.select("hash", "slice").mapInArrow(mark, "block long, offsets binary, counts binary")
    return partial.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, bits binary")


def possible_repeats(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (which has a long column hash) and ``maybe``: false where the hash occurs once for certain.

    ``rows`` must be stored: it is read twice.
    """
    n = rows.count()
    slices = max(1, math.ceil(n * CELLS_PER_HASH / SLICE_CELLS))
    size = 1 << max(16, min(SLICE_CELLS, CELLS_PER_HASH * max(n, 1)).bit_length() - 1)
    of = F.pmod(F.shiftrightunsigned("hash", 33), F.lit(slices)).cast("int")
    dealt = rows.withColumn("slice", of)
    if slices > 1:
        # rows of a slice together, so that each broadcast meets only its own rows
        dealt = cut_lineage(dealt.repartitionByRange("slice", "hash"), f"{name}-sliced")
    merged = cut_lineage(sketch(dealt, size), f"{name}-sketch")
    per, out = size // BLOCK, []
    for s in range(slices):
        bits = np.zeros(size // 8, np.uint8)
        for block, part in merged.filter(F.col("block").between(s * per, (s + 1) * per - 1)).toLocalIterator():
            at = (block - s * per) * (BLOCK // 8)
            bits[at : at + BLOCK // 8] = np.frombuffer(bytes(part), np.uint8)
        shared = Shared(rows.sparkSession, bits.tobytes(), lambda b: np.frombuffer(b, np.uint8))

        def test(batch: pa.RecordBatch, shared: Shared = shared) -> list[pa.Array]:
            at = cells(column(batch, "hash").to_numpy().view(np.uint64), size)
            found = shared()[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
            return [pa.array(found.all(axis=0))]

        own = dealt.filter(F.col("slice") == s) if slices > 1 else dealt
        out.append(cut_lineage(add_columns(own, {"maybe": T.BooleanType()}, test, ("slice",)), f"{name}-tested"))
        shared.data.unpersist()
    tested = out[0]
    for more in out[1:]:
        tested = tested.union(more)
    return tested
