"""Repeated passages by recompression.

A window is ``span`` consecutive words of one document; a word goes if some window over it
also starts in a document with a smaller id.

1. **Whole documents.** A document's last symbol names its whole word sequence.  Documents
   that share it with a smaller one lose all their words (if they hold a window at all) and
   leave the search.
2. **Recompression.** In rounds, runs of equal symbols and then pairs get names.  A coin of
   the symbol and the round says left or right; a left symbol and a right one after it make
   a pair.  A name is a 64-bit hash of what it stands for, so names are global without a
   table of names to shuffle.  Each symbol carries its context: the words that fix where it
   starts and ends.  Wherever these words occur, the same symbol stands there.
3. **Reveal.** Two Bloom filters over all symbols with contexts of at most a window
   (``twice``) tell which may occur twice.  A window is suspected unless a symbol whose
   context it holds occurs once.  Equal windows hold equal symbols, so none is missed.
4. **Verify.** Suspected windows, as 96 bits of two independent hashes, are counted exactly: the least document of
   each, aggregated before the shuffle, meets the documents that hold it, and each learns
   which of its windows are covered.  Passages that very many documents share are skewed
   keys of that join, which Spark splits.

A null or empty text has no words.  A null doc_id counts as the smallest.  Rows of one
doc_id are one document and cover nothing of each other.  Empty tables give empty results;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.llm.batches import add_columns, byte_slices, column, fresh, map_batches, mix, row_slices, space_words, text_bytes
from tapeframe.llm.twice import seen_twice
from tapeframe.session import cut_lineage

NULL_ID = -(1 << 63)
ROUNDS = 2
SYMBOLS_PER_WORD = 0.6


@dataclass
class Symbols:
    """Symbols of many texts in order: name, words of their context, text, and whether the context ends at a text's edge."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    open: np.ndarray

    def take(self, at: np.ndarray) -> Symbols:
        return Symbols(self.name[at], self.start[at], self.end[at], self.row[at], self.open[at])

    def with_neighbour(self, at: np.ndarray, near: np.ndarray, wanted: np.ndarray) -> Symbols:
        """The symbols ``at``, their contexts widened to those of the symbols ``near`` where ``wanted``."""
        own = self.take(at)
        inside = (near >= 0) & (near < len(self.name))
        near = np.where(inside, near, at)
        same = inside & (self.row[near] == own.row)
        use = wanted & same
        return replace(
            own,
            start=np.where(use, np.minimum(own.start, self.start[near]), own.start),
            end=np.where(use, np.maximum(own.end, self.end[near]), own.end),
            open=own.open | (wanted & ~same) | (use & self.open[near]),
        )


def run_round(s: Symbols) -> Symbols:
    """Names maximal runs; that a run ends shows in its neighbours."""
    n = len(s.name)
    head = np.ones(n, bool)
    head[1:] = (s.name[1:] != s.name[:-1]) | (s.row[1:] != s.row[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], n) - 1
    every = np.ones(len(first), bool)
    left, right = s.with_neighbour(first, first - 1, every), s.with_neighbour(last, last + 1, every)
    size = (last - first + 1).astype(np.uint64)
    name = np.where(size > 1, mix(s.name[first] * np.uint64(0x9E6C63D0876A9A47) + size), s.name[first])
    return Symbols(name, left.start, right.end, left.row, left.open | right.open)


def pair_round(s: Symbols, turn: int) -> Symbols:
    """Names pairs of a left symbol and a right one; a symbol that stays alone shows in one neighbour."""
    n = len(s.name)
    right = (mix(s.name + np.uint64(turn + 1)) & np.uint64(1)).astype(bool)
    paired = np.zeros(n, bool)
    paired[:-1] = ~right[:-1] & right[1:] & (s.row[:-1] == s.row[1:])
    second = np.zeros(n, bool)
    second[1:] = paired[:-1]
    at = np.flatnonzero(~second)
    both = paired[at]
    out = s.with_neighbour(at, np.where(right[at], at - 1, at + 1), np.ones(len(at), bool))
    follower = np.minimum(at + 1, n - 1)
    name = np.where(both, mix(s.name[at] * np.uint64(0xD6E8FEB86659FD93) + s.name[follower] * np.uint64(0xA0761D6478BD642F) + np.uint64(turn)), s.name[at])
    return replace(out, name=name)


def recompress(words: np.ndarray, rows: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    """Symbols of the texts whose word hashes are ``words``, with offsets ``rows``."""
    n = len(words)
    place = np.arange(n)
    s = Symbols(words, place, place + 1, np.repeat(np.arange(len(rows) - 1), np.diff(rows)), np.zeros(n, bool))
    for turn in range(rounds if n else 0):
        s = pair_round(run_round(s), turn)
    return s


class Passages:
    """Window hashes and symbols of the texts of a batch."""

    BASE = 0xC2B2AE3D27D4EB4F

    def __init__(self, span: int) -> None:
        self.span, self.hasher = span, space_words(lower=False)
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) < n:
            size = 1 << n.bit_length()
            for name, base in (("power", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Rows from, rows to, word hashes and their offsets."""
        data, offsets = text_bytes(texts)
        for lo, hi in row_slices(offsets):
            words, rows, _, _ = self.hasher(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield lo, hi, words, rows

    def hashes(self, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences from ``start`` to ``end``."""
        self.grow(len(words) + 1)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.power[: len(words)], out=sums[1:])
        return mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def windows(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window at each word, and whether it lies in one text."""
        n = max(0, len(words) - self.span + 1)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        whole = row[:n] == row[self.span - 1 : self.span - 1 + n]
        start = np.arange(n)
        return self.hashes(words, start, start + self.span), whole

    def anchors(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and word ranges of the contexts of all symbols that a window can hold."""
        s = recompress(words, rows)
        fits = ~s.open & (s.end - s.start <= self.span)
        start, end = s.start[fits], s.end[fits]
        return self.hashes(words, start, end), start, end

    def second(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """32-bit hashes of the windows at ``at``, independent of the first ones: each word is mixed with its place."""
        out = np.zeros(len(at), np.uint64)
        for i in range(self.span):
            out += mix(words[at + i] ^ mix(np.array([i + 1], np.uint64)))
        return (mix(out) >> np.uint64(32)).astype(np.uint32)

    def suspected(self, words: np.ndarray, rows: np.ndarray, test) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and both hashes of the windows that hold no symbol that occurs once."""
        hashes, whole = self.windows(words, rows)
        keys, start, end = self.anchors(words, rows)
        once = ~test(keys)
        lo, hi = np.maximum(end[once] - self.span, 0), start[once] + 1
        change = np.zeros(len(words) + 2, np.int64)
        np.add.at(change, lo, 1)
        np.add.at(change, np.maximum(hi, lo), -1)
        at = np.flatnonzero(whole & (np.cumsum(change)[: len(whole)] == 0))
        return at, hashes[at], self.second(words, at)


def whole_documents(rows: DataFrame) -> DataFrame:
    """(doc, n_words, name): the last symbol of each document, that of all its words."""

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, names = [], []
        for text in column(batch, "text").fill_null("").cast(pa.binary()).to_pylist():
            words = text.split()
            counts.append(len(words))
            names.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
        return pa.RecordBatch.from_arrays([column(batch, "doc"), pa.array(counts, pa.int64()), pa.array(names, pa.binary())], names=["doc", "n_words", "name"])

    return map_batches(rows, "doc long, n_words long, name binary", named)


def covered(rows: DataFrame, n_words: int, span: int) -> DataFrame:
    """(doc, windows): hashes of the windows of each document that a smaller one also holds."""

    def symbols(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        tool = Passages(span)
        for _, _, words, offsets in tool.slices(column(batch, "text")):
            yield tool.anchors(words, offsets)[0]

    seen = seen_twice(rows, symbols, int(SYMBOLS_PER_WORD * n_words), probes=1)

    def reveal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, test = Passages(span), seen()
        for batch in batches:
            for part in byte_slices(batch):
                docs = column(part, "doc").to_numpy()
                for lo, _, words, offsets in tool.slices(column(part, "text")):
                    at, hashes, second = tool.suspected(words, offsets, test)
                    owner = docs[lo + np.searchsorted(offsets, at, "right") - 1] if len(at) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(second.view(np.int32)), pa.array(owner, pa.int64())], names=["win", "second", "doc"])

    suspects = cut_lineage(rows.mapInArrow(reveal, "win long, second int, doc long"), "suspect-windows")
    key = ["win", "second"]
    shared = suspects.groupBy(*key).agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most")
    shared = cut_lineage(shared.select(*key, "least"), "shared-windows")  # a join of two plain shuffles is split where a window is skewed
    repeats = suspects.join(shared, key).filter("doc > least")
    return repeats.groupBy("doc").agg(F.collect_set("win").alias("windows"))


def dedup_passages(docs: DataFrame, span: int = 13, text_digest: bool = False) -> tuple[DataFrame, list[str]]:
    """``docs`` without ``text``, and three more columns, with their names: words, removed words, the kept words or their SHA-256."""
    key, gone, whole = fresh(docs, "doc", "windows", "whole")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    rows = keyed.select(F.col(key).alias("doc"), "text")
    named = cut_lineage(whole_documents(rows).filter(F.col("n_words") >= span), "passage-documents")
    firsts = named.groupBy("name").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most")
    firsts = cut_lineage(firsts.select("name", "least"), "passage-firsts")
    copies = cut_lineage(named.join(firsts, "name").filter("doc > least").select("doc").distinct(), "passage-copies")
    n_words = named.agg(F.sum("n_words")).first()[0] or 0
    found = covered(rows.join(copies, "doc", "left_anti"), n_words, span).select("doc", "windows", F.lit(False).alias("whole"))
    found = found.union(copies.select("doc", F.array().cast("array<bigint>"), F.lit(True)))
    joined = keyed.join(found.toDF(key, gone, whole), key, "left").drop(key)
    names = fresh(joined, "n_words", "n_removed", "kept")

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        tool, counts, removed, kept = Passages(span), [], [], []
        texts = column(batch, "text").fill_null("").cast(pa.binary()).to_pylist()
        lists, wholes = column(batch, gone), column(batch, whole).to_pylist()
        for lo, hi, words, offsets in tool.slices(column(batch, "text")):
            hashes, _ = tool.windows(words, offsets)
            for r in range(lo, hi):
                a, b = int(offsets[r - lo]), int(offsets[r - lo + 1])
                own = texts[r].split()
                counts.append(b - a)
                hit = np.zeros(b - a, bool)
                if wholes[r]:
                    hit[:] = True
                elif wholes[r] is False and b - a >= span:
                    wanted = lists[r].values.to_numpy().view(np.uint64)
                    at = np.flatnonzero(np.isin(hashes[a : b - span + 1], wanted))
                    change = np.zeros(b - a + 1, np.int64)
                    change[at] += 1
                    change[at + span] -= 1
                    hit = np.cumsum(change[:-1]) > 0
                removed.append(int(hit.sum()))
                left = b" ".join(w for w, h in zip(own, hit.tolist()) if not h) if hit.any() else b" ".join(own)
                kept.append(hashlib.sha256(left).hexdigest() if text_digest else left)
        out = pa.array(kept, pa.string() if text_digest else pa.binary()).cast(pa.string())
        return [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), out]

    kinds = dict(zip(names, (T.LongType(), T.LongType(), T.StringType())))
    return add_columns(joined, kinds, cut, ("text", gone, whole)), names


def passage_report(docs: DataFrame, span: int = 13) -> DataFrame:
    """Words, removed words and the digest of the kept ones of every row."""
    found, (words, removed, kept) = dedup_passages(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), span, text_digest=True)
    return found.select("doc_id", F.col(words).alias("n_words"), F.col(removed).alias("n_removed"), F.col(kept).alias("kept_sha256"))
