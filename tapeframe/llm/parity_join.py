"""N-gram Jaccard join by parity sketches.

Two sets are linked when 100 * intersection >= percent * union, that is when they differ in
at most (100 - percent) / (100 + percent) of their summed sizes.

1. **Sets.** A document's set holds the hashes of its distinct shingles of ``words`` words;
   with fewer words, the whole sequence is one.  Equal sets are one class.
2. **Sketches.** In the wide sketch of a size band, a token flips bits of one piece only, the
   one that its high bits name: the piece is the XOR of its tokens.  So the pieces in which
   two sketches differ, their Hamming distance over pieces, are at most the tokens in which
   the sets differ.  In the narrow sketch a token flips a single bit, and the Hamming distance
   over bits is at most that too.
3. **Pigeonhole.** A linked partner of a set of size s differs in at most
   s * (100 - percent) / percent tokens, hence in as many pieces.  Bands hold sizes within a
   factor of ``STEP`` and have so many pieces that a set has more pieces with tokens than
   that.  In a common order of pieces, rarest first, both sets then hold their first common
   piece among their first allowance + 1: only these are joined.  A set that leaves too many
   pieces empty (rare, small sets) offers all its pieces, the empty ones too.  A set whose
   partners may fall into the next band offers pieces of that band's sketch as well.
4. **Order.** Keys that fill some share of a task's flush are counted on and the ``HOT`` most
   frequent are broadcast: they come last in the order, their buckets are never brought
   together, and each has a leader known beforehand.  Rarer keys meet in a window.
5. **Verify.** Pairs of a bucket's leader and its members are tested by narrow sketches, the
   rest on full sets.  Then a bucket is settled unless its other members lie in several
   components; in those left, members of different components are compared by narrow
   sketches in blocks, and what these leave is verified too.  So no link is lost, and members
   of large groups meet their leader only.
6. **Components** of the links give each document its class.

A null or empty text has no words, an empty set and no links.  A null doc_id counts as the
smallest id.  Rows that repeat a doc_id have each the set of its own text; the document is
linked wherever one of its texts is.  Empty tables give empty results; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.llm.batches import Shared, byte_slices, column, map_batches, mix, space_words
from tapeframe.llm.components import components
from tapeframe.llm.near_dedup import shingle_sets
from tapeframe.session import cut_lineage

NULL_ID = -(1 << 63)
PIECES, STEP = 16, 4
FLUSH, OFTEN, HOT = 1 << 20, 4, 1 << 18
CHUNK, BLOCK, OUT_BYTES = 64, 512, 1 << 22
BUCKETS = 1 << 16


class Sketcher:
    """Wide and narrow parity sketches of sets, for links at ``percent`` or more."""

    def __init__(self, words: int, percent: int) -> None:
        spare = (100 - percent) / percent * 4 / 3
        if not 0 <= spare < 1 or percent > 100:
            raise ValueError("percent must be above 57 and at most 100")
        # tokens a piece at most: a third more pieces have tokens than may differ
        lo, hi = 1e-9, 4.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if -math.expm1(-mid) / mid > spare else (lo, mid)
        self.words, self.percent, self.load, self.hasher = words, percent, lo, space_words(lower=True)

    def allowance(self, size: int) -> int:
        """Tokens in which a linked partner may differ at most."""
        return size * (100 - self.percent) // self.percent

    def band(self, size: int) -> int:
        k = 0
        while size > self.load * PIECES * STEP**k:
            k += 1
        return k

    def keys(self, tokens: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """For each band: keys of the pieces, and how many of the rarest must be offered; ``tokens`` are sorted."""
        size, out = len(tokens), []
        allowed = self.allowance(size)
        if not allowed:
            return out  # only equal sets link
        for band in range(self.band(size), self.band(size * 100 // self.percent) + 1):
            bits = (PIECES * STEP**band).bit_length() - 1
            piece = tokens >> np.uint64(64 - bits)
            heads = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            held, place = np.bitwise_xor.reduceat(tokens, heads), piece[heads]
            held, place = held[held != 0], place[held != 0]
            need = allowed + 1
            if len(held) < need:
                whole = np.zeros(1 << bits, np.uint64)
                whole[place] = held
                held, place, need = whole, np.arange(1 << bits, dtype=np.uint64), 1 << bits
            out.append((mix(held ^ mix(place + np.uint64(band + 1 << 40))), need))
        return out

    def narrow(self, tokens: np.ndarray) -> bytes:
        """One bit flipped a token, eight bits a piece."""
        bits = 8 * PIECES * STEP ** self.band(len(tokens))
        flips = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
        return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()

    def may_link(self, distance: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether sets of these summed sizes that differ in ``distance`` tokens at least may be linked."""
        return (100 + self.percent) * distance <= (100 - self.percent) * sizes


def folded(sketch: np.ndarray, length: int) -> np.ndarray:
    """A narrow sketch of fewer bytes: parity of the bits that fall together."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, length), axis=0)


def distances(sketches: list[bytes], columns: int = 1 << 12) -> np.ndarray:
    """Hamming distances between narrow sketches, all folded to the shortest."""
    length = min(map(len, sketches))
    table = np.stack([folded(np.frombuffer(s, np.uint8), length) for s in sketches])
    common = np.zeros((len(table),) * 2, np.float32)
    ones = np.zeros(len(table), np.float32)
    for lo in range(0, length, columns):
        bits = np.unpackbits(table[:, lo : lo + columns], axis=1).astype(np.float32)
        common += bits @ bits.T
        ones += bits.sum(axis=1)
    return (ones[:, None] + ones[None, :] - 2 * common).astype(np.int64)


def signed_sets(rows: DataFrame, tool: Shared) -> DataFrame:
    """Of rows with doc and text: (doc, n_shingles, digest, sketch), and (doc, key, times) of keys that are often met."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, keys, owners, held = tool(), [], [], 0

        def often() -> pa.RecordBatch:
            key, first, times = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
            many = times >= OFTEN
            owner = np.repeat(np.array([d for d, _ in owners], np.int64), [n for _, n in owners])
            none = [pa.nulls(int(many.sum()), t) for t in (pa.int64(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(owner[first[many]]), *none, pa.array(key[many].view(np.int64)), pa.array(times[many])], names=names)

        for batch in batches:
            for part in byte_slices(batch):
                sizes, digests, sketches = [], [], []
                for doc, tokens in zip(column(part, "doc").to_pylist(), shingle_sets(sketcher.hasher, column(part, "text"), sketcher.words)):
                    sizes.append(len(tokens))
                    digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                    sketches.append(sketcher.narrow(tokens) if len(tokens) else b"")
                    for own, _ in sketcher.keys(tokens):
                        keys.append(own)
                        owners.append((doc, len(own)))
                        held += len(own)
                none = [pa.nulls(len(sizes), pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([column(part, "doc"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), *none], names=names)
                if held >= FLUSH:
                    yield often()
                    keys, owners, held = [], [], 0
        if held:
            yield often()

    names = ["doc", "n_shingles", "digest", "sketch", "key", "times"]
    return rows.mapInArrow(sign, "doc long, n_shingles long, digest binary, sketch binary, key long, times long")


class HotKeys:
    """Frequent keys with their counts and leaders."""

    def __init__(self, columns: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.key, self.times, self.leader = columns

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is hot, its count (0 if not) and its leader."""
        if not len(self.key):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        hot = self.key[at] == keys
        return hot, np.where(hot, self.times[at], 0), self.leader[at]


def hot_keys(signed: DataFrame) -> Shared:
    """At most ``HOT`` keys, the most frequent ones; they only set the order of keys and who leads a bucket."""
    often = signed.filter("times IS NOT NULL").groupBy("key").agg(F.sum("times").alias("times"), F.min("doc").alias("leader"))
    table = often.orderBy(F.desc("times"), "key").limit(HOT).toArrow()
    key, times, leader = (table[c].to_numpy() for c in ("key", "times", "leader"))
    order = np.argsort(key.view(np.uint64))
    return Shared(signed.sparkSession, (key.view(np.uint64)[order], times[order], leader[order]), HotKeys)


def buckets(rows: DataFrame, tool: Shared, hot: Shared) -> DataFrame:
    """(key, doc, leader): offered keys that several documents hold, and the document that leads each."""

    def offer(batch: pa.RecordBatch) -> pa.RecordBatch:
        sketcher, known, out = tool(), hot(), ([], [], [], [])
        for doc, tokens in zip(column(batch, "doc").to_pylist(), shingle_sets(sketcher.hasher, column(batch, "text"), sketcher.words)):
            for keys, need in sketcher.keys(tokens):
                is_hot, times, leader = known(keys)
                first = np.lexsort((keys, times))[:need]
                for values, own in zip(out, (keys[first], np.full(len(first), doc, np.int64), leader[first], is_hot[first])):
                    values.append(own)
        key, doc, leader, is_hot = (np.concatenate([*x, np.zeros(0, t)]) for x, t in zip(out, (np.uint64, np.int64, np.int64, bool)))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(leader, pa.int64(), mask=~is_hot.astype(bool))], names=["key", "doc", "leader"])

    offered = map_batches(rows, "key long, doc long, leader long", offer)
    # a hot key needs no meeting: its rows are dealt by document
    own = Window.partitionBy("key", "salt")
    offered = offered.withColumn("salt", F.when(F.col("leader").isNotNull(), F.col("doc")))
    met = offered.withColumn("least", F.min("doc").over(own)).withColumn("most", F.max("doc").over(own))
    return met.filter("leader IS NOT NULL OR least < most").select("key", "doc", F.coalesce("leader", "least").alias("leader"))


def near_pairs(pairs: DataFrame, sketches: DataFrame, tool: Shared) -> DataFrame:
    """The pairs (a, b) that narrow sketches do not rule out."""
    side = lambda c: sketches.select(F.col("doc").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def test(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = column(batch, "n_a").to_numpy() + column(batch, "n_b").to_numpy()
        apart = np.zeros(len(sizes), np.int64)
        for i, (x, y) in enumerate(zip(column(batch, "s_a").to_pylist(), column(batch, "s_b").to_pylist())):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            length = min(len(x), len(y))
            apart[i] = int.from_bytes((folded(x, length) ^ folded(y, length)).tobytes(), "little").bit_count()
        return batch.filter(pa.array(tool().may_link(apart, sizes))).select(["a", "b"])

    return map_batches(pairs.join(side("a"), "a").join(side("b"), "b"), "a long, b long", test)


def verified(pairs: DataFrame, rows: DataFrame, tool: Shared) -> DataFrame:
    """The linked ones of ``pairs``, by full sets.

    The partners of a document are dealt in chunks and its set goes to each of them.
    """
    sizes = cut_lineage(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "parity-chunks")
    dealt = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "b")
    asked = dealt.select(F.col("b").alias("doc"), "a", "chunk", F.lit(1).alias("side"))
    asked = cut_lineage(asked.union(dealt.select(F.col("a").alias("doc"), "a", "chunk", F.lit(0).alias("side")).distinct()), "parity-asked")
    # texts that share no hash bucket with a wanted document stay where they are; at most BUCKETS rows
    of = F.pmod(F.xxhash64("doc"), F.lit(BUCKETS)).alias("of")
    wanted = cut_lineage(asked.select(of).distinct(), "parity-wanted")
    texts = rows.withColumn("of", of).join(F.broadcast(wanted), "of", "left_semi").select("doc", "text")
    names = ["a", "chunk", "side", "doc", "tokens"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = tool()
        for batch in batches:
            for part in byte_slices(batch):
                data, done, size = [], 0, 0
                rest = [column(part, c) for c in ("a", "chunk", "side", "doc")]
                for i, tokens in enumerate(shingle_sets(sketcher.hasher, column(part, "text"), sketcher.words), 1):
                    data.append(tokens.tobytes())
                    size += len(data[-1])
                    if size >= OUT_BYTES or i == part.num_rows:
                        yield pa.RecordBatch.from_arrays([*(c.slice(done, i - done) for c in rest), pa.array(data, pa.binary())], names=names)
                        data, done, size = [], i, 0

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, owns, percent = None, [], tool().percent
        for batch in batches:
            found = []
            for a, chunk, side, doc, data in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = np.frombuffer(data, np.uint64)
                if key != (a, chunk):
                    key, owns = (a, chunk), []
                if side == 0:
                    owns += [tokens] if len(tokens) else []
                    continue
                for own in owns if len(tokens) else []:
                    common = int((own[np.minimum(np.searchsorted(own, tokens), len(own) - 1)] == tokens).sum())
                    if 100 * common >= percent * (len(own) + len(tokens) - common):
                        found.append((a, doc))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    # always a shuffle by document: wanted documents grow with the input
    sent = texts.join(asked.hint("merge"), "doc").select("a", "chunk", "side", "doc", "text").mapInArrow(send, "a long, chunk int, side int, doc long, tokens binary")
    return sent.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "side").mapInArrow(judge, "a long, b long")


def unsettled(met: DataFrame, sketches: DataFrame, tool: Shared) -> DataFrame:
    """Near pairs (a, b) of different components in buckets; ``met`` has key, doc (of a class) and component."""
    several = met.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    several = cut_lineage(several, "parity-unsettled")
    members = cut_lineage(met.join(several, "key").distinct(), "parity-members")
    sizes = cut_lineage(members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "parity-blocks")
    spread = members.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "doc", "component")
    spread = spread.join(sketches, "doc").select("key", "one", "two", "own", "doc", "component", "n_shingles", "sketch")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, sketcher = None, [], tool()

        def close() -> pa.RecordBatch:
            own, docs, part, sizes = (np.array([r[i] for r in rows], np.int64) for i in range(4))
            near = sketcher.may_link(distances([r[4] for r in rows]), sizes[:, None] + sizes) & (part[:, None] != part)
            if key[1] != key[2]:
                near &= own[:, None] != own
            a, b = np.nonzero(near & (docs[:, None] < docs))
            return pa.RecordBatch.from_arrays([pa.array(docs[a]), pa.array(docs[b])], names=["a", "b"])

        for batch in batches:
            for part in byte_slices(batch):
                for k, one, two, *row in zip(*(c.to_pylist() for c in part.columns)):
                    if key != (k, one, two):
                        if key is not None:
                            yield close()
                        key, rows = (k, one, two), []
                    rows.append(row)
        if key is not None:
            yield close()

    dealt = spread.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    return dealt.mapInArrow(judge, "a long, b long").distinct()


def joined(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc, n_shingles, component) of rows with doc and text."""
    settings = (words, percent)
    tool = Shared(rows.sparkSession, settings, lambda s: Sketcher(*s))
    signed = cut_lineage(signed_sets(rows, tool), "parity-signed")
    sets = signed.filter("times IS NULL").select("doc", "n_shingles", "digest", "sketch")
    filled = sets.filter("n_shingles > 0")
    first = cut_lineage(filled.groupBy("digest").agg(F.min("doc").alias("rep")), "parity-classes")
    named = cut_lineage(filled.select("doc", "digest").join(first, "digest").select("doc", "rep"), "parity-named")
    spans = named.groupBy("doc").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")).filter("doc <> rep OR rep < last")
    spans = cut_lineage(spans, "parity-copies")
    # a document of one text stands behind the least one that has it; one of several texts stays, with links to the least of each
    copies = spans.filter("rep = last").select("doc", "rep")
    several = named.join(spans.filter("rep < last").select("doc"), "doc").select(F.col("doc").alias("a"), F.col("rep").alias("b"))

    def behind(df: DataFrame, name: str) -> DataFrame:
        moved = df.join(copies.toDF(name, "rep"), name, "left").withColumn(name, F.coalesce("rep", name))
        return moved.drop("rep")

    met = cut_lineage(behind(behind(buckets(rows, tool, hot_keys(signed)), "doc"), "leader").filter("doc <> leader"), "parity-buckets")
    pairs = met.select(F.least("doc", "leader").alias("a"), F.greatest("doc", "leader").alias("b")).distinct()
    led = cut_lineage(pairs, "parity-pairs")
    sketches = sets.filter("n_shingles > 0").select("doc", "n_shingles", "sketch")
    links = cut_lineage(verified(cut_lineage(near_pairs(led, sketches, tool), "parity-near"), rows, tool).union(several), "parity-links")
    part = components(links)
    placed = met.select("key", "doc").join(part.toDF("doc", "component"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    rest = unsettled(placed, sketches, tool).join(led, ["a", "b"], "left_anti")
    more = verified(cut_lineage(rest, "parity-rest"), rows, tool)
    found = components(links.union(more)).toDF("rep", "component")
    owner = cut_lineage(first.join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")), "parity-owners")
    out = sets.select("doc", "n_shingles", "digest").join(owner, "digest", "left")
    return out.select("doc", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc")).alias("component"))


def join_report(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), "text")
    found = joined(rows, words, percent)
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(real("doc").alias("doc_id"), "n_shingles", real("component").alias("component_id"))
