"""Token counts by a finite-state machine compiled from a byte-pair vocabulary.

**Pieces.** The tokenizer cuts a text into pieces (words with their leading space,
digits, signs, white space) and never merges across them; a special token is a piece
of one token.

**Transducer.** Within a piece the machine reads bytes.  Its state holds, for every
vocabulary prefix that ends at the present byte, the trie node, the last token before it
and the tokens so far relative to now.  That suffices: the last token of any prefix of a
piece is the one vocabulary suffix that forms a stable pair with the last token before
it.  States are interned and transitions compiled on first use; each carries the change
in emitted tokens.  A piece starts in the start state, so its whole path is kept as one
macro transition while memory allows.

**Chunks.** Before white space that follows anything else a piece ends whatever stands
around it.  So a chunk's map of machine states is (head, tokens, tail): ``head`` completes
the state that enters, ``tail`` leads from the start state to the one that leaves.  The
maps form a monoid.  Texts beyond ``chunk`` characters are dealt out in chunks and their
maps composed pairwise in rounds; a text holds at most 2 GB, so a group is at most some
ten thousand short maps.
"""

from __future__ import annotations

import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.llm.batches import Shared, column, map_batches

CHUNK = 1 << 16
# The white space of the Unicode property and the piece patterns of the vocabulary's library.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
FIRST_CUT = regex.compile(rf"(?<=[^{WHITE}])[{WHITE}]")
LAST_CUT = regex.compile(rf"(?r)(?<=[^{WHITE}])[{WHITE}]")


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary file: printable ones for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    others = [b for b in range(256) if chr(b) not in letters]
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


def load(path: str) -> dict:
    """What the machine needs of a tokenizer file: merges as pairs of bytes, and special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or before["type"] != "ByteLevel" or spec["normalizer"] or before["add_prefix_space"] or model.get("ignore_merges"):
        raise ValueError("a byte-level pair vocabulary without a normaliser is needed")
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("special tokens must match plainly")
    return {"merges": [(raw(a), raw(b)) for a, b in pairs], "special": [t["content"] for t in spec["added_tokens"]]}


class Macros(dict):
    """Tokens of whole pieces, by their path from the start state."""

    def __init__(self, run) -> None:
        self.run = run

    def __missing__(self, piece: str) -> int:
        count = self.run(piece.encode())
        if len(piece) <= 64:
            self[piece] = count
        return count


class Transducer:
    """Counts the tokens of pieces; ``states`` and ``macros`` bound what is compiled at a time."""

    def __init__(self, merges: list[tuple[bytes, bytes]], special: list[str], states: int = 250_000, macros: int = 500_000) -> None:
        self.max_states, self.max_macros = states, macros
        self.token = {bytes([b]): b for b in range(256)}
        self.merge: dict[tuple[int, int], int] = {}
        self.halves = [(b, b) for b in range(256)]
        for a, b in merges:
            pair = (self.token[a], self.token[b])
            if self.token.setdefault(a + b, len(self.token)) == len(self.halves):
                self.halves.append(pair)
                self.merge[pair] = self.token[a + b]
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.inner: list[bool] = [True]
        for text, token in self.token.items():
            node = 0
            for byte in text:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                self.inner[node] = True
                node = self.child[key]
            self.ends[node] = token
        self.special = frozenset(special)
        marks = "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))
        self.marks = regex.compile(f"({marks})") if special else None
        self.pieces = regex.compile(PIECES)
        self.macros = Macros(self.run)
        self.forget()

    def forget(self) -> None:
        start = ((), -1)
        self.state, self.moves, self.known = [start], {}, {start: 0}

    def is_stable(self, left: int, right: int) -> bool:
        """Whether the two tokens stay two when their bytes are merged by rank.

        Undoes the merges next to their border, the latest first, and asks each time
        whether the pair at the border would have been merged before.
        """
        limit = len(self.halves)
        while True:
            if self.merge.get((left, right), limit) < limit:
                return False
            if max(left, right) < 256:
                return True
            if left > right:
                limit, left = left, self.halves[left][1]
            else:
                limit, right = right + 1, self.halves[right][0]

    def compile(self, at: int, byte: int) -> tuple[int, int]:
        chain, last = self.state[at]
        grown = [(self.child[n << 8 | byte], before, count) for n, before, count in chain if n << 8 | byte in self.child]
        grown.append((self.child[byte], last, 0))
        for node, before, count in grown:
            token = self.ends[node]
            if token >= 0 and (before < 0 or self.is_stable(before, token)):
                break
        else:
            raise AssertionError("every byte is a token")
        change = count + 1
        target = (tuple((n, b, c - change) for n, b, c in grown if self.inner[n]), token)
        if target not in self.known:
            self.known[target] = len(self.state)
            self.state.append(target)
        move = self.moves[at << 8 | byte] = (self.known[target], change)
        return move

    def run(self, piece: bytes) -> int:
        if len(self.state) > self.max_states:
            self.forget()
        at = count = 0
        get, make = self.moves.get, self.compile
        for byte in piece:
            at, change = get(at << 8 | byte) or make(at, byte)
            count += change
        return count

    def plain(self, text: str) -> int:
        if len(self.macros) > self.max_macros:
            self.macros.clear()
        return sum(map(self.macros.__getitem__, self.pieces.findall(text)))

    def count(self, text: str) -> int:
        if self.marks is None or not self.marks.search(text):
            return self.plain(text)
        return sum(1 if part in self.special else self.plain(part) for part in self.marks.split(text))

    def chunk_map(self, text: str) -> tuple[str, int, str | None]:
        """(head, tokens, tail); tail is None where no cut is certain."""
        first = FIRST_CUT.search(text)
        if first is None:
            return text, 0, None
        lo, hi = first.start(), LAST_CUT.search(text).start()
        return text[:lo], self.count(text[lo:hi]), text[hi:]

    def compose(self, maps: list[tuple[str, int, str | None]]) -> tuple[str, int, str | None]:
        """Composes neighbours in rounds, as a prefix scan does."""
        while len(maps) > 1:
            maps = [self.join(*maps[i : i + 2]) for i in range(0, len(maps), 2)]
        return maps[0]

    def join(self, a: tuple, b: tuple | None = None) -> tuple[str, int, str | None]:
        if b is None:
            return a
        (head, n, tail), (head2, n2, tail2) = a, b
        if tail is None and tail2 is None:
            return self.chunk_map(head + head2)
        if tail is None:
            first, count, rest = self.chunk_map(head + head2)
            return (first, n2, tail2) if rest is None else (first, count + self.count(rest) + n2, tail2)
        if tail2 is None:
            first, count, rest = self.chunk_map(tail + head2)
            return (head, n, first) if rest is None else (head, n + self.count(first) + count, rest)
        return head, n + self.count(tail + head2) + n2, tail2

    def finish(self, m: tuple[str, int, str | None]) -> int:
        return self.count(m[0]) + m[1] + self.count(m[2] or "")


def token_counts(docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; ``path`` names the tokenizer file.

    A null or empty text has no bytes and no tokens; a null doc_id stays null; repeated
    rows give repeated results; other columns of ``docs`` are not looked at.
    """
    machine = Shared(docs.sparkSession, load(path), lambda parts: Transducer(**parts))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, texts = machine(), column(batch, "text")
        return pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), pa.array([len(t.as_buffer()) for t in texts], pa.int64()), pa.array([m.count(t) for t in texts.to_pylist()], pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"],
        )

    counts = map_batches(rows.filter(F.length("text") <= chunk), "doc_id long, n_bytes long, n_tokens long", whole)
    counts = counts.unionByName(chunked(rows.filter(F.length("text") > chunk), machine, chunk))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def chunked(rows: DataFrame, machine, chunk: int) -> DataFrame:
    """Counts of long texts from the maps of their chunks; equal rows are counted once and laid out again."""
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int"))
    parts = rows.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text", F.posexplode(starts).alias("pos", "k")
    ).select("doc_id", "n_bytes", "digest", "pos", F.substring("text", F.col("k") * chunk + 1, F.lit(chunk)).alias("part"))
    fields = "doc_id long, n_bytes long, digest string, pos int, head string, n long, tail string"

    def mapped(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = machine()
        maps = [m.chunk_map(t) for t in column(batch, "part").to_pylist()]
        head, n, tail = (zip(*maps)) if maps else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(head, pa.string()), pa.array(n, pa.int64()), pa.array(tail, pa.string())],
            names=["doc_id", "n_bytes", "digest", "pos", "head", "n", "tail"],
        )

    maps = map_batches(parts, fields, mapped).groupBy("doc_id", "n_bytes", "digest", "pos").agg(
        F.first(F.struct("head", "n", "tail")).alias("map"), F.count(F.lit(1)).alias("copies")
    )
    texts = maps.groupBy("doc_id", "n_bytes", "digest").agg(F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("pos", "map"))).alias("maps"))

    def composed(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = machine()
        lists = [[(x["map"]["head"], x["map"]["n"], x["map"]["tail"]) for x in maps] for maps in column(batch, "maps").to_pylist()]
        counts = pa.array([m.finish(m.compose(x)) for x in lists], pa.int64())
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), counts, column(batch, "copies")], names=["doc_id", "n_bytes", "n_tokens", "copies"])

    done = map_batches(texts, "doc_id long, n_bytes long, n_tokens long, copies long", composed)
    return done.select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")
