"""Near-duplicate documents by min-max hashing.

1. **Sets.** A document's set holds the hashes of its distinct shingles of ``words`` words.
   Documents with equal sets are one class, so copies are never compared.
2. **Signatures.** Each permutation gives two values, the minimum and the maximum of the
   permuted set: half the evaluations for as many values.  Four values, of two
   permutations, make a band; there are so many bands that a pair at the threshold shares
   none with a chance of ``miss`` at most.
3. **Candidates.** Classes that share a band key are joined to the least of them, and the
   connected components of these joins are the clusters within which links are sought.
4. **Links.** Full sets are compared within clusters.  A cluster is dealt in blocks of about
   ``BLOCK`` classes (up to ``LARGE_BLOCK`` in clusters of very many), and each pair of blocks meets in one place: no group grows with its
   cluster, all pairs are judged exactly, and a spanning forest of the links is emitted.
5. **Components** of the links give each document its class.

A null or empty text has no words, an empty set and no links.  A null doc_id counts as the
smallest id.  Rows that repeat a doc_id are judged each by its own text.  Empty tables give
empty results; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.llm.batches import Shared, WordHasher, byte_slices, column, fresh, map_batches, mix, row_slices, space_words, text_bytes
from tapeframe.llm.components import components
from tapeframe.session import cut_lineage

NULL_ID = -(1 << 63)
BAND_PERMUTATIONS = 2
BLOCK, LARGE_BLOCK, FEW_BLOCKS = 96, 1024, 32
COLUMNS = 1 << 13
OUT_BYTES = 1 << 22


def shingle_sets(hasher: WordHasher, texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text; fewer words than ``words`` are one shingle."""
    data, offsets = text_bytes(texts)
    factors = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    for lo, hi in row_slices(offsets):
        hashes, rows, _, _ = hasher(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        n = max(0, len(hashes) - words + 1)
        joined = np.zeros(n, np.uint64)
        for i in range(words):
            joined += hashes[i : i + n] * factors[i]
        joined = mix(joined)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if b - a >= words:
                yield np.unique(joined[a : b - words + 1])
            elif b > a:
                yield mix(np.sum(hashes[a:b] * factors[: b - a], keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def band_count(percent: int, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** (2 * BAND_PERMUTATIONS)))


class Signer:
    """Band keys of shingle sets."""

    def __init__(self, options: dict) -> None:
        rng = np.random.default_rng(options["seed"])
        n = options["bands"] * BAND_PERMUTATIONS
        self.bands = options["bands"]
        self.factor = rng.integers(1, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, n, np.uint64)
        self.weight = rng.integers(1, 1 << 63, 2 * BAND_PERMUTATIONS, np.uint64) | np.uint64(1)
        self.hasher = space_words(lower=True)

    def keys(self, sets: np.ndarray) -> np.ndarray:
        low, high = np.full(len(self.factor), ~np.uint64(0)), np.zeros(len(self.factor), np.uint64)
        for i in range(0, len(sets), 4096):
            values = sets[i : i + 4096, None] * self.factor + self.shift
            np.minimum(low, values.min(axis=0), out=low)
            np.maximum(high, values.max(axis=0), out=high)
        values = np.concatenate([low.reshape(self.bands, -1), high.reshape(self.bands, -1)], axis=1)
        return mix((mix(values) * self.weight).sum(axis=1) + np.arange(self.bands, dtype=np.uint64)).astype(np.int64)


def signatures(rows: DataFrame, words: int, signer: Shared) -> DataFrame:
    """(doc, n_shingles, digest, bands) of rows with doc and text."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool, sizes, digests, bands = signer(), [], [], []
        for s in shingle_sets(tool.hasher, column(batch, "text"), words):
            sizes.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            bands.append(tool.keys(s) if len(s) else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)), pa.array(np.concatenate([*bands, np.zeros(0, np.int64)])))
        return pa.RecordBatch.from_arrays([column(batch, "doc"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], names=["doc", "n_shingles", "digest", "bands"])

    return map_batches(rows, "doc long, n_shingles long, digest binary, bands array<long>", sign)


def links_of(sets: list[np.ndarray], percent: int, split: int) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs among ``sets``; with ``split``, of pairs across it only.

    Intersections are products of incidence matrices, some columns at a time; shingles of
    one set only are left out.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    counts = np.diff(np.append(heads, len(values)))
    place = np.cumsum(counts > 1) - 1
    shared = np.repeat(counts > 1, counts)
    column_of, owner = np.repeat(place, counts)[shared], owner[shared]
    common = np.zeros((n, n), np.float32)
    total = np.zeros((n, n), np.int64)
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(column_of, [lo, lo + COLUMNS])
        held = np.zeros((n, COLUMNS), np.float32)
        held[owner[a:b], column_of[a:b] - lo] = 1
        np.matmul(held, held.T, out=common)
        total += common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - total
    linked = np.triu(100 * total >= percent * union, 1)
    if split:
        linked[:split, :split] = linked[split:, split:] = False
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            forest.append((i, j))
    return forest


def links(rows: DataFrame, clusters: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): enough links between classes of one cluster to join all that are linked.

    ``rows`` has doc and text of the classes, ``clusters`` has doc, cluster and the number of blocks.
    """
    fields = "cluster long, one int, two int, side int, doc long, shingles binary"
    names = ["cluster", "one", "two", "side", "doc", "shingles"]

    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, out, size = space_words(lower=True), [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            for part in byte_slices(batch):
                sets = shingle_sets(hasher, column(part, "text"), words)
                for doc, cluster, blocks, s in zip(*(column(part, c).to_pylist() for c in ("doc", "cluster", "blocks")), sets):
                    own, data = int(mix(np.array([doc % (1 << 64)], np.uint64))[0] % np.uint64(blocks)), s.tobytes()
                    for other in range(blocks):
                        out.append((cluster, min(own, other), max(own, other), int(other < own), doc, data))
                        size += len(data) + 64
                        if size >= OUT_BYTES:  # a set goes to every block, so a few texts can be many bytes
                            yield flush()
                            out, size = [], 0
        if out:
            yield flush()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, sets, split = None, [], [], 0

        def close() -> pa.RecordBatch:
            found = links_of(sets, percent, split if key[1] != key[2] else 0) if len(sets) > 1 and (key[1] == key[2] or 0 < split < len(sets)) else []
            return pa.RecordBatch.from_arrays([pa.array([docs[i] for i, _ in found], pa.int64()), pa.array([docs[j] for _, j in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for part in byte_slices(batch):
                for cluster, one, two, side, doc, data in zip(*(c.to_pylist() for c in part.columns)):
                    if key != (cluster, one, two):
                        if key is not None:
                            yield close()
                        key, docs, sets, split = (cluster, one, two), [], [], 0
                    docs.append(doc)
                    sets.append(np.frombuffer(data, np.uint64))
                    split += side == 0
        if key is not None:
            yield close()

    # always a shuffle by document: the members of clusters grow with the input
    meeting = rows.join(clusters.hint("merge"), "doc").select("doc", "text", "cluster", "blocks").mapInArrow(dealt, fields)
    meeting = meeting.repartition("cluster", "one", "two").sortWithinPartitions("cluster", "one", "two", "side", "doc")
    return meeting.mapInArrow(judged, "a long, b long")


def classes(rows: DataFrame, words: int, percent: int, miss: float, seed: int) -> DataFrame:
    """(doc, n_shingles, component) of rows with doc and text."""
    signer = Shared(rows.sparkSession, {"bands": band_count(percent, miss), "seed": seed}, Signer)
    signed = cut_lineage(signatures(rows, words, signer), "near-signatures")
    sets = signed.filter("n_shingles > 0")
    first = cut_lineage(sets.groupBy("digest").agg(F.min("doc").alias("rep"), F.min_by("bands", "doc").alias("bands")), "near-classes")
    keyed = first.select("rep", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least < most")
    joined = keyed.join(cut_lineage(buckets.select("key", "least"), "near-buckets"), "key").filter("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    stars = components(joined)
    members = stars.union(stars.select("b", "b").distinct()).toDF("doc", "cluster")
    # small blocks spread small clusters; in large ones larger blocks keep the copies of each set few
    size = F.count(F.lit(1))
    blocks = F.least(F.ceil(size / BLOCK), F.greatest(F.lit(FEW_BLOCKS), F.ceil(size / LARGE_BLOCK)))
    sizes = members.groupBy("cluster").agg(blocks.cast("int").alias("blocks"))
    clusters = members.join(sizes, "cluster").select("doc", "cluster", "blocks")
    found = components(links(rows, clusters, words, percent))
    named = first.select("digest", "rep").join(found.select(F.col("a").alias("rep"), F.col("b").alias("least")), "rep", "left")
    named = named.select("digest", F.coalesce("least", "rep").alias("component"))
    placed = signed.select("doc", "n_shingles", "digest").join(named, "digest", "left")
    return placed.select("doc", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc")).alias("component"))


def near_report(docs: DataFrame, words: int = 3, percent: int = 85, miss: float = 1e-6, seed: int = 11) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), "text")
    found = classes(rows, words, percent, miss, seed)
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(real("doc").alias("doc_id"), "n_shingles", real("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-6, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` whose document has the least id of its component."""
    (key,) = fresh(docs, "doc")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    found = classes(keyed.select(F.col(key).alias("doc"), "text"), words, percent, miss, seed)
    kept = found.filter("doc = component").select(F.col("doc").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").select(*docs.columns)
