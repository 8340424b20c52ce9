"""Benchmark decontamination by a broadcast hash set of test n-grams.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  Every
``n`` consecutive words of a benchmark item are a window; an item with fewer words is one
window.  The windows are broadcast as a set of bounded size: ``limit`` pairs of a window
and an item at a time.  A larger benchmark is scanned in several passes over the stored
texts, one after the other; each stores its hits before the next slice is broadcast.  A text's words become numbers of the benchmark's vocabulary; a
window is looked up only where no word is foreign, and its words are compared themselves.
With one slice no rows are shuffled; with more, the rows that are hit join the texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.llm.batches import Shared, WordHasher, add_columns, column, fresh, row_slices, text_bytes
from tapeframe.session import cut_lineage

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
HITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def item_words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x00-/:-`{-\x7f]+", (text or "").encode().lower())


def window_sets(benchmark: DataFrame, n: int, limit: int) -> Iterator[dict[bytes, set[str]]]:
    """Windows (their words joined by a space) and the items that hold them, at most ``limit`` such pairs at a time."""
    part: dict[bytes, set[str]] = {}
    size = 0
    for item, text in benchmark.toLocalIterator():
        words, name = item_words(text), str(item)
        for i in range(max(1, len(words) - n + 1) if words else 0):
            own = part.setdefault(b" ".join(words[i : i + n]), set())
            if name not in own:
                own.add(name)
                size += 1
            if size >= limit:
                yield part
                part, size = {}, 0
    if part:
        yield part


class Scanner:
    """Finds the windows of one set in many texts."""

    def __init__(self, windows: dict[bytes, set[str]]) -> None:
        self.hash = WordHasher(WORD, FOLD)
        words = sorted({w for key in windows for w in key.split(b" ")})
        found = self.hash(*text_bytes(pa.array(words, pa.binary())))[0]
        order = np.argsort(found, kind="stable")
        self.hashes, self.words = found[order], [words[i] for i in order]
        self.windows, self.lengths = windows, sorted({key.count(b" ") + 1 for key in windows})

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """Number of words, hit spans of words and items of each text."""
        hashes, rows, first, end = self.hash(data, offsets)
        if not len(self.hashes):
            yield from ((count, [], set()) for count in np.diff(rows).tolist())
            return
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
        sums = np.concatenate([[0], np.cumsum(known)])
        hits: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for size in self.lengths:
            if len(hashes) < size:
                break
            whole = (sums[size:] - sums[:-size] == size) & (row[: len(row) - size + 1] == row[size - 1 :])
            for i in np.flatnonzero(whole).tolist():
                key = b" ".join(self.folded(data, first[j], end[j]) for j in range(i, i + size))
                if key in self.windows:
                    r = int(row[i])
                    hits.setdefault(r, []).append((i - int(rows[r]), i - int(rows[r]) + size))
                    items.setdefault(r, set()).update(self.windows[key])
        for r, count in enumerate(np.diff(rows).tolist()):
            yield count, hits.get(r, []), items.get(r, set())

    @staticmethod
    def folded(data: np.ndarray, lo: int, hi: int) -> bytes:
        return FOLD[data[lo:hi]].tobytes()


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, limit: int = 200_000, keep_text: bool = True) -> tuple[DataFrame, list[str]]:
    """``docs`` with three more columns, and their names: words, hit spans of words, items as strings.

    ``docs`` needs ``text``, ``benchmark`` needs ``item_id`` and ``text``.  Null and empty
    texts have no words; items without words have no window; items and rows that repeat
    change nothing; items without an id are one item named None; with an empty benchmark
    nothing is hit.
    """
    names = fresh(docs, "n_words", "hits", "items", "key", "at", "others")
    words, hits, items, key, at, others = names
    kinds = {words: T.LongType(), hits: HITS, items: T.ArrayType(T.StringType())}
    more = window_sets(benchmark.select("item_id", "text"), n, limit)
    windows, following = next(more, {}), next(more, None)
    keyed = docs if following is None else cut_lineage(docs.withColumn(key, F.monotonically_increasing_id()), "texts")
    stored = []
    while following is not None:
        part = Shared(docs.sparkSession, windows, Scanner)
        found = add_columns(keyed.select(key, "text"), kinds, looking(part), ("text",))
        stored.append(cut_lineage(found.filter(F.size(hits) > 0).select(key, F.col(hits).alias("h"), F.col(items).alias("i")), "hits"))
        part.data.unpersist()
        windows, following = following, next(more, None)
    rows = add_columns(keyed, kinds, looking(Shared(docs.sparkSession, windows, Scanner)), () if keep_text else ("text",))
    if stored:
        rest = reduce(DataFrame.unionByName, stored).groupBy(F.col(key).alias(at)).agg(F.flatten(F.collect_list("h")).alias("h"), F.flatten(F.collect_list("i")).alias("i"))
        every = lambda own, rest: F.array_distinct(F.concat(own, F.coalesce(rest, F.array().cast(kinds[own])))).alias(own)
        kept = [c for c in rows.columns if c not in names]
        rows = rows.join(rest.select(at, F.struct("h", "i").alias(others)), F.col(key) == F.col(at), "left").select(
            *kept, words, every(hits, F.col(others)["h"]), every(items, F.col(others)["i"])
        )
    return rows, names[:3]


def looking(part):
    def look(batch: pa.RecordBatch) -> list[pa.Array]:
        scanner = part()
        data, offsets = text_bytes(column(batch, "text"))
        counts, hits, items = [], [], []
        for lo, hi in row_slices(offsets):
            for count, spans, found in scanner(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                counts.append(count)
                hits.append([{"start": a, "end": b} for a, b in united(spans)])
                items.append(sorted(found))
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(span)), pa.array(items, pa.list_(pa.string()))]

    return look


def n_hit(hits: str) -> F.Column:
    """Words inside any span; spans of several passes may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("upto"))
    step = lambda s, x: F.struct((s.words + F.greatest(x.end - F.greatest(x.start, s.upto), F.lit(0))).alias("words"), F.greatest(s.upto, x.end).alias("upto"))
    return F.aggregate(F.array_sort(hits), start, step, lambda s: s.words)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, limit: int = 200_000) -> DataFrame:
    """Hit words and items of every row, as the operator's report."""
    found, (words, hits, items) = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, n, limit, keep_text=False)
    return found.select(
        "doc_id", F.col(words).alias("n_words"), n_hit(hits).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(items)).cast("binary"), 256).alias("items_sha256"), (F.size(hits) > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, limit: int = 200_000) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark."""
    found, (_, hits, _) = scan(docs, benchmark, n, limit)
    return found.filter(F.size(hits) == 0).select(*docs.columns)


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, limit: int = 200_000) -> DataFrame:
    """All rows of ``docs``; in texts, each hit span goes, from its first word to its last."""
    found, (_, hits, _) = scan(docs, benchmark, n, limit)
    word = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for text, spans in zip(column(batch, "text").to_pylist(), column(batch, hits).to_pylist()):
            if spans:
                places, kept, at = [m.span() for m in word.finditer(text)], [], 0
                for lo, hi in united([(s["start"], s["end"]) for s in spans]):
                    kept.append(text[at : places[lo][0]])
                    at = places[hi - 1][1]
                text = "".join([*kept, text[at:]])
            out.append(text)
        return [pa.array(out, pa.string())]

    (new,) = fresh(found, "text_without")
    cleaned = add_columns(found, {new: T.StringType()}, cut)
    return cleaned.select(*(F.col(new).alias(c) if c == "text" else F.col(c) for c in docs.columns))
