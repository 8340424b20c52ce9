"""Vector code compression: product codes by a lexicographic trie over distinct parts.

A vector's integers floor(256 * x) are cut into equal consecutive parts, and each part is
coded by the nearest entry of its position's codebook.  A batch of vectors keeps each
distinct part once, in lexicographic order, which is a trie: parts that share their first
dimensions share a path.  Going down it, a node's distances to all entries are its
parent's plus one dimension's; leaves take the argmin and add their values, times how
often they stand there, to the entry's sums.  Large nodes are walked depth first, and a
subtree of at most ``FRONTIER`` leaves one level at a time, so no more than that many
distance vectors are held.

A round is one pass over the vectors without a shuffle of them: a task hands on one row for
each part and entry.  Only codebooks, ``entries`` integers a dimension, reach the driver.

Rows whose vector is null or empty or holds a null or non-finite component are dropped, and
so are those whose length is not the most frequent one among multiples of ``parts`` (the
longer of equals).  A null vec_id counts as the smallest; rows that repeat a vec_id are rows
of their own, in the order of their vectors.  With fewer rows than ``entries`` a codebook has
as many entries.  Components beyond 2**62 after scaling count as 2**62, and errors beyond
the largest long as that; in between, large integers are exact.  Null labels are one label.
Empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.llm.batches import Shared, byte_slices, column
from tapeframe.session import cut_lineage

FRONTIER = 4096
LARGEST = 1 << 62
# differences below this, squared and added over a part, stay within 64 bits
PLAIN = 1 << 24
LONGEST = (1 << 63) - 1
SUMS = "part int, entry int, place int, n long, total decimal(38,0)"


def integer_vectors(embeddings: DataFrame, parts: int = 16) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, their components as integers."""
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("x"))
    kept = kept.filter(f"size(x) > 0 AND size(x) % {parts} = 0 AND forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity'))")
    whole = F.expr(f"transform(x, v -> least(greatest(floor(v * 256), {-LARGEST}L), {LARGEST}L))")
    stored = cut_lineage(kept.select("vec_id", "label", whole.alias("vector")), "code-vectors")
    width = stored.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return stored.filter(F.size("vector") == (width.width if width else 0))


class Trie:
    """Distinct rows of ``values`` in lexicographic order."""

    def __init__(self, values: np.ndarray) -> None:
        order = np.lexsort(values.T[::-1])
        rows = values[order]
        n, self.depth = rows.shape
        differs = np.ones((n, self.depth), bool)
        differs[1:] = rows[1:] != rows[:-1]
        heads = np.flatnonzero(differs.any(axis=1))
        self.rows = rows[heads]
        # the first dimension in which a row leaves the path of the row before
        self.branch = differs[heads].argmax(axis=1)
        self.counts = np.diff(np.append(heads, n))
        self.place = np.empty(n, np.int64)
        self.place[order] = np.repeat(np.arange(len(heads)), self.counts)

    def nearest(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct row the least entry at the least squared distance, and that distance."""
        plain = max(_most(self.rows), _most(book)) <= PLAIN
        rows, book = (self.rows, book.astype(np.int64)) if plain else (self.rows.astype(object), book.astype(object))
        codes, errors = np.zeros(len(rows), np.int64), np.zeros(len(rows), rows.dtype)
        stack = [(0, len(rows), 0, np.zeros(len(book), rows.dtype))]
        while stack:
            lo, hi, depth, total = stack.pop()
            if hi - lo > FRONTIER and depth < self.depth - 1:
                heads = lo + np.flatnonzero(np.append(True, self.branch[lo + 1 : hi] <= depth))
                below = total + (rows[heads, depth][:, None] - book[:, depth]) ** 2
                stack += zip(heads.tolist(), np.append(heads[1:], hi).tolist(), [depth + 1] * len(heads), below)
                continue
            for a in range(lo, hi, FRONTIER):
                b = min(hi, a + FRONTIER)
                above, level = np.array([a]), total[None, :]
                for d in range(depth, self.depth):
                    heads = a + np.flatnonzero(np.append(True, self.branch[a + 1 : b] <= d))
                    level = level[np.searchsorted(above, heads, "right") - 1] + (rows[heads, d][:, None] - book[:, d]) ** 2
                    above = heads
                codes[a:b] = level.argmin(axis=1)
                errors[a:b] = level[np.arange(b - a), codes[a:b]]
        return codes, errors


def _most(values: np.ndarray) -> int:
    return max(int(values.max()), -int(values.min())) if values.size else 0


def matrices(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of bounded bytes, and their vectors as rows by part by place."""
    for batch in batches:
        for piece in byte_slices(batch):
            if piece.num_rows:
                yield piece, column(piece, "vector").flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, parts, -1)


def improved(vectors: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks after one round; ``book`` is part by entry by place."""
    parts, entries, width = book.shape
    shared = Shared(vectors.sparkSession, book)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, n, total = shared(), np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for _, values in matrices(batches, parts):
            for p in range(parts):
                trie = Trie(values[:, p])
                codes, _ = trie.nearest(books[p])
                weight = trie.counts if _most(trie.rows) <= PLAIN else trie.counts.astype(object)
                sums = np.zeros((entries, width), weight.dtype)
                np.add.at(sums, codes, trie.rows * weight[:, None])
                np.add.at(n[p], codes, trie.counts)
                total[p] += sums
        p, e, i = (x.ravel() for x in np.indices((parts, entries, width)))
        used = n[p, e] > 0
        p, e, i = p[used], e[used], i[used]
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(i, pa.int32()), pa.array(n[p, e])]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([Decimal(int(t)) for t in total[p, e, i]], pa.decimal128(38, 0))], names=["part", "entry", "place", "n", "total"])

    out = book.copy()
    sums = vectors.select("vector").mapInArrow(added, SUMS).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for r in sums.collect():
        out[r.part, r.entry, r.place] = int(r.total) // r.n
    return out


def coded(vectors: DataFrame, book: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of all vectors by the codebooks ``book``."""
    shared, parts = Shared(vectors.sparkSession, book), len(book)
    label = vectors.schema["label"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared()
        for piece, values in matrices(batches, parts):
            codes, errors = np.zeros((len(values), parts), np.uint8), np.zeros(len(values), object)
            for p in range(parts):
                trie = Trie(values[:, p])
                own, off = trie.nearest(books[p])
                codes[:, p] = own[trie.place]
                errors = errors + off[trie.place]
            texts = [c.tobytes().hex() for c in codes]
            totals = [min(int(e), LONGEST) for e in errors]
            yield pa.RecordBatch.from_arrays([column(piece, "vec_id"), column(piece, "label"), pa.array(texts, pa.string()), pa.array(totals, pa.int64())], names=["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(assign, f"vec_id long, label {label.dataType.simpleString()}, code string, error long")


def train(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray | None:
    """Codebooks, part by entry by place; None without vectors.  At most 256 entries fit a code."""
    first = vectors.orderBy("vec_id", "vector").limit(entries).select("vector").collect()
    if not first:
        return None
    book = np.array([r.vector for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        book = improved(vectors, book)
    return book


def code_report(embeddings: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, code, error, the error of all rows of its label, and the digest of the codebooks."""
    vectors = integer_vectors(embeddings, parts)
    book = train(vectors, parts, entries, rounds)
    if book is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    rows = cut_lineage(coded(vectors, book), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    # stored, so that Spark knows its size and splits a join that a frequent label skews
    sums = cut_lineage(rows.groupBy("label").agg(total.alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
