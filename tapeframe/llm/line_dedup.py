"""Line deduplication by two Bloom filters.

A line's key is the line without white space at its ends, A-Z lower-cased.  Keys of at
least ``min_chars`` code points that at least ``min_docs`` documents hold lose their
lines everywhere but in the document with the largest id.

1. Two filters over all keys (``twice``) tell which may occur in two documents.
2. Only those are shuffled, as 128-bit digests: their documents are counted exactly, and
   the one that keeps its lines is chosen.  Counts are summed before the shuffle, so a
   line that a third of all documents hold is a few rows a task.
3. The digests to drop meet their texts in one join by document.

Rows of one doc_id are one document; a null doc_id counts as the smallest.  A null or
empty text is one empty line.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.llm.batches import SPACES, add_columns, column, fresh
from tapeframe.llm.twice import seen_twice
from tapeframe.session import cut_lineage

NULL_ID = -(1 << 63)


def digest(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(SPACES).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode(errors="replace")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def texts(batch: pa.RecordBatch) -> list[bytes]:
    return column(batch, "text").fill_null("").cast(pa.binary()).to_pylist()


def keys(text: bytes, min_chars: int) -> set[bytes]:
    found = {digest(line, min_chars) for line in text.split(b"\n")}
    found.discard(None)
    return found


def repeated(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc, drop): the digests of the lines that each document loses."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), "text")
    expected = rows.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0

    def first_words(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for text in texts(batch):
            yield np.frombuffer(b"".join(keys(text, min_chars)), "<u8")[::2]

    suspects = seen_twice(rows, first_words, expected)

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = suspects()
        for batch in batches:
            docs, found = [], []
            for doc, text in zip(column(batch, "doc").to_pylist(), texts(batch)):
                own = list(keys(text, min_chars))
                hit = test(np.frombuffer(b"".join(own), "<u8")[::2]) if own else ()
                found += [d for d, h in zip(own, hit) if h]
                docs += [doc] * (len(found) - len(docs))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.binary())], names=["doc", "line"])

    lines = cut_lineage(rows.mapInArrow(suspected, "doc long, line binary").distinct(), "suspect-lines")
    common = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keeper")).filter(F.col("n") >= min_docs)
    common = cut_lineage(common.select("line", "keeper"), "common-lines")  # a join of two plain shuffles is split where a line is skewed
    lost = lines.join(common, "line").filter(F.col("doc") < F.col("keeper"))
    return lost.groupBy("doc").agg(F.collect_list("line").alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, text_digest: bool = False) -> tuple[DataFrame, list[str]]:
    """``docs`` without ``text``, and three more columns, with their names: lines, dropped lines, the kept text or its SHA-256."""
    key, drop = fresh(docs, "doc", "drop")
    lost = repeated(docs, min_chars, min_docs).select(F.col("doc").alias(key), F.col("drop").alias(drop))
    joined = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).join(lost, key, "left").drop(key)
    names = fresh(joined, "n_lines", "n_dropped", "kept")

    def kept(batch: pa.RecordBatch) -> list[pa.Array]:
        counts, dropped, out = [], [], []
        for text, gone in zip(texts(batch), column(batch, drop).to_pylist()):
            lines = left = text.split(b"\n")
            if gone:
                gone = set(gone)
                left = [line for line in lines if digest(line, min_chars) not in gone]
                text = b"\n".join(left)
            counts.append(len(lines))
            dropped.append(len(lines) - len(left))
            out.append(hashlib.sha256(text).hexdigest() if text_digest else text)
        out = pa.array(out, pa.string() if text_digest else pa.binary())
        return [pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), out.cast(pa.string())]

    kinds = dict(zip(names, (T.LongType(), T.LongType(), T.StringType())))
    return add_columns(joined, kinds, kept, ("text", drop)), names


def line_report(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Lines, dropped lines and the digest of the kept text of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, (lines, dropped, kept) = dedup_lines(rows, min_chars, min_docs, text_digest=True)
    return found.select("doc_id", F.col(lines).alias("n_lines"), F.col(dropped).alias("n_dropped"), F.col(kept).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the kept lines as ``text``; a text that was null stays null."""
    (was_null,) = fresh(docs, "was_null")
    found, (_, _, kept) = dedup_lines(docs.withColumn(was_null, F.col("text").isNull()), min_chars, min_docs)
    text = F.when(F.col(was_null), None).otherwise(F.col(kept)).alias("text")
    return found.select(*(text if c == "text" else F.col(c) for c in docs.columns))
