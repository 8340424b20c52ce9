"""Filter interaction audit: what each of five filters removes, in every order of them.

1. **Flags.** One pass over the texts judges the filters that need one text only and writes
   a short row: document, part, flags, and the length and SHA-256 of the text, which stand
   for the whole text from here on.  No text is shuffled or read again.
2. **Prepass.** Merged counting Bloom sketches (``counting``) clear the texts that occur
   once.  Only possible repeats are shuffled, for the exact least document of each text.
3. **Masks.** The flags of a document are a mask of five bits.  Masks are counted by part,
   with good and toxic documents; all 120 orders are sums of these counts, since what a
   filter removes depends only on the set of filters before it.  A filter's share over all
   orders is 120 / (failed filters) for each document failing it.

A null text is empty, and equal to other empty ones; an empty text fails the first filter
only, and the last where a smaller document is empty too.  A null lang is the part "".  A
null doc_id counts as the smallest and has no labels.  Rows that repeat a doc_id count each,
and are no duplicates of each other.  A document is good (toxic) if one of its rows in
``labels`` says so.  An empty table has no parts and gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.llm.batches import SPACES, column, map_batches, text_bytes
from tapeframe.llm.counting import possible_repeats
from tapeframe.session import cut_lineage

NULL_ID = -(1 << 63)
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
CHUNK = 1 << 22


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words; long texts are taken in pieces that end at white space."""
    if len(text) <= CHUNK:
        words = text.split()
        return len(words), len(set(words))
    n, seen, lo = 0, set(), 0
    while lo < len(text):
        hi = min(len(text), lo + CHUNK)
        while hi < len(text) and text[hi] not in SPACES:
            hi += 1
        words = text[lo:hi].split()
        n += len(words)
        seen.update(words)
        lo = hi
    return n, len(seen)


def text_flags(docs: DataFrame) -> DataFrame:
    """(doc, part, mask, n_bytes, digest, hash): the flags that need one text only."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    names = ["doc", "part", "mask", "n_bytes", "digest", "hash"]
    marks = np.zeros(256, bool)
    marks[list(b"#$%&*|")] = True

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(column(batch, "text"))

        def per_text(hit: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(data) + 1, np.int64)
            np.cumsum(hit, out=sums[1:])
            return sums[offsets[1:]] - sums[offsets[:-1]]

        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        words = np.array([word_counts(t) for t in texts], np.int64).reshape(-1, 2)
        fails = [
            words[:, 0] < 200,
            100 * words[:, 1] < 50 * words[:, 0],
            100 * per_text((data >= 65) & (data <= 90)) > 3 * per_text((data & 0xC0) != 0x80),
            per_text(marks[data]) > 0,
        ]
        mask = sum((f.astype(np.int32) << i for i, f in enumerate(fails)), np.zeros(len(texts), np.int32))
        digests = [hashlib.sha256(t).digest() for t in texts]
        hashes = np.frombuffer(b"".join(d[:8] for d in digests), "<i8")
        return pa.RecordBatch.from_arrays([column(batch, "doc"), column(batch, "part"), pa.array(mask, pa.int32()), pa.array(np.diff(offsets)), pa.array(digests, pa.binary()), pa.array(hashes)], names=names)

    return map_batches(rows, "doc long, part string, mask int, n_bytes long, digest binary, hash long", judge)


def masks(docs: DataFrame) -> DataFrame:
    """(doc, part, mask): the failed filters of every row of ``docs``, the first in the lowest bit."""
    flags = cut_lineage(text_flags(docs), "audit-flags")
    tested = possible_repeats(flags, "audit").drop("hash")
    suspects = tested.filter("maybe")
    same = ["digest", "n_bytes"]
    firsts = suspects.groupBy(*same).agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select(*same, "least")
    # stored, so that Spark splits the join where one text is very frequent
    firsts = cut_lineage(firsts, "audit-firsts")
    copy = F.when(F.col("doc") > F.col("least"), F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask"))
    exact = suspects.join(firsts, same, "left").select("doc", "part", copy.alias("mask"))
    return exact.union(tested.filter("NOT maybe").select("doc", "part", "mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic)."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    told = told.filter("doc IS NOT NULL AND (good OR toxic)").groupBy("doc").agg(F.max(F.coalesce("good", F.lit(False))).alias("good"), F.max(F.coalesce("toxic", F.lit(False))).alias("toxic"))
    told = cut_lineage(told.filter(F.col("doc") != NULL_ID), "audit-labels")
    sums = [F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(c) for c in ("good", "toxic")]
    return masks(docs).join(told, "doc", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *sums)


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bit of the step's filter, bits of those before it)."""
    out = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    counts = cut_lineage(mask_counts(docs, labels), "audit-counts")
    bits = F.explode(F.array(*(F.lit(1 << i) for i in range(len(FILTERS))))).alias("bit")
    spread = counts.select("*", bits).select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("before")).filter("before & bit = 0")
    fails, earlier = "mask & bit <> 0", "mask & before <> 0"
    total = lambda value, cond: F.sum(F.when(F.expr(cond), F.expr(value)).otherwise(0)).cast("long")
    sums = spread.groupBy("part", "bit", "before").agg(
        total("n", "mask & (before | bit) = 0").alias("kept"),
        total("n", f"{fails} AND NOT {earlier}").alias("removed"),
        total("n", f"{fails} AND {earlier}").alias("redundant"),
        total("n", "mask = bit").alias("unique_fails"),
        total("good", f"{fails} AND NOT {earlier}").alias("good_lost"),
        total("toxic", f"{fails} AND NOT {earlier}").alias("toxic_lost"),
        total("n * 120 div bit_count(mask)", fails).alias("shapley"),
    )
    steps = docs.sparkSession.createDataFrame(orders(), "filter_order string, step int, bit int, before int")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sums.join(F.broadcast(steps), ["bit", "before"]).select(*columns)  # 600 rows, whatever the data
