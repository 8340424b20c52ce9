"""Two Bloom filters over all rows of a table: hashes seen once, and hashes seen at least twice.

Each task marks the cells of its hashes in its own pair of filters and sends the marked
cells by block.  Blocks meet where they are dealt to: a cell that is marked in two
partial filters, or twice in one, goes into the second filter.  Both filters of a block
live only in the task that merges it.  The merged second filter is all that later passes
need: a hash that occurs twice has all its cells there.  It has ``CELLS_PER_HASH`` cells
for each hash up to ``MOST_CELLS`` in all, so the broadcast is bounded; beyond that more
hashes that occur once are suspected, and nothing is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapeframe.llm.batches import Shared, byte_slices

CELLS_PER_HASH = 16
MOST_CELLS = 1 << 28
BLOCK = 1 << 16
FLUSH = 1 << 20


def cells(hashes: np.ndarray, mask: int, probes: int) -> np.ndarray:
    """Positions of the hashes in the filter: ``probes`` rows."""
    step = (hashes >> np.uint64(33)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(mask) for i in range(probes)])


def marked(places: np.ndarray) -> pa.RecordBatch:
    """Cells by block: those marked, and those marked more than once."""
    cell, count = np.unique(places, return_counts=True)
    block = (cell >> np.uint64(16)).astype(np.int32)
    offset = (cell & np.uint64(BLOCK - 1)).astype("<u2")
    heads = np.flatnonzero(np.diff(block, prepend=-1))
    ends = np.append(heads[1:], len(block))
    more = count > 1
    once = [offset[a:b].tobytes() for a, b in zip(heads, ends)]
    twice = [offset[a:b][more[a:b]].tobytes() for a, b in zip(heads, ends)]
    return pa.RecordBatch.from_arrays([pa.array(block[heads]), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["block", "once", "twice"])


def seen_twice(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], expected: int, probes: int = 2) -> Shared:
    """The second filter over the hashes that ``hashes`` yields for the batches of ``rows``; about ``expected`` in all."""
    size = 1 << max(16, min(MOST_CELLS, CELLS_PER_HASH * max(expected, 1)).bit_length() - 1)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for part in byte_slices(batch):
                for found in hashes(part):
                    held.append(cells(found, size - 1, probes).ravel())
                    count += len(held[-1])
                    if count >= FLUSH:
                        yield marked(np.concatenate(held))
                        held, count = [], 0
        if count:
            yield marked(np.concatenate(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, first, more in zip(*(c.to_pylist() for c in batch.columns)):
                if block not in once:
                    once[block], twice[block] = np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)
                first, more = np.frombuffer(first, "<u2"), np.frombuffer(more, "<u2")
                twice[block][first] |= once[block][first]
                once[block][first] = True
                twice[block][more] = True
        for block, bits in twice.items():
            if bits.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    partial = rows.mapInArrow(mark, "block int, once binary, twice binary")
    merged = partial.repartition("block").mapInArrow(merge, "block int, bits binary")
    bits = np.zeros(size // 8, np.uint8)
    for block, part in merged.toLocalIterator():
        bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(bytes(part), np.uint8)
    data = bits.tobytes()
    return Shared(rows.sparkSession, data, lambda b: Suspects(b, size, probes))


class Suspects:
    """Tells which hashes may occur twice."""

    def __init__(self, bits: bytes, size: int, probes: int) -> None:
        self.bits, self.mask, self.probes = np.frombuffer(bits, np.uint8), size - 1, probes

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = cells(hashes, self.mask, self.probes)
        bit = self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
        return bit.all(axis=0)
