"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is parsed
greedily: a phrase is the longest piece from here on that occurs in the labelled text.
Phrases times log2 of the labelled length, per symbol, estimate the entropy of the text
relative to the language; the least wins.

The labelled text of a language is a bounded sample: ``sample_docs`` documents chosen by
a hash of their ids and texts, exact copies once, at most ``sample_chars`` characters of each.  Every label is learned
and everything else covers all rows and whole texts: ``at_once`` languages at a time are
broadcast, and where there are more, each slice of them reads the texts again and stores
the two least entropies it finds, a small row a text; one aggregation then takes the least.

Every letter of the samples, in lower case, is a symbol of its own; letters that no sample
holds share one, and so does anything else.  The rows of an automaton lie displaced over
each other in one array of about two cells a transition, whatever the alphabet, and each
task parses thousands of blocks at a time, a symbol of each per step.  Texts are parsed in
blocks of ``BLOCK`` symbols: a phrase ends where its block ends, for every language alike.
With one slice no rows are shuffled but the labels' counts.

A text that is null or holds no letter is ``und`` with score 0, and so is every text if
no row is labelled; ``letter`` tells them apart.  A label ``und`` is one like others.  Ties go to the smaller label.  A null doc_id is not held out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.llm.batches import Shared, add_columns, column, fresh
from tapeframe.session import cut_lineage

BLOCK = 256
LANES = 8192
GAP, OTHER, END, LETTERS = 0, 1, 2, 3
TRIES = 64


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def samples(docs: DataFrame, sample_docs: int, sample_chars: int, at_once: int) -> Iterator[dict[str, list[str]]]:
    """Labelled texts by language, ``at_once`` languages at a time; at most ``sample_docs`` of ``sample_chars`` characters each."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    rows = rows.withColumn("unit", F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(9)), 11) / float(1 << 53))
    rates = rows.groupBy("lang").agg(F.min("unit").alias("least"), F.approx_count_distinct("unit", 0.02).alias("n"))
    # stored, so that Spark knows its size when it plans the join
    rates = cut_lineage(rates.select("lang", "least", (2.0 * sample_docs / F.col("n")).alias("rate")), "languages")
    drawn = rows.select("lang", "unit", F.substring("text", 1, sample_chars).alias("text")).join(rates, "lang").filter("unit < rate OR unit = least")
    texts: dict[str, list[str]] = {}
    for row in drawn.select("lang", "unit", "text").distinct().orderBy("lang", "unit", "text").toLocalIterator():
        if row.lang not in texts and len(texts) == at_once:
            yield texts
            texts = {}
        own = texts.setdefault(row.lang, [])
        if len(own) < sample_docs:
            own.append(row.text)
    if texts:
        yield texts


@cache
def lower_letters() -> np.ndarray:
    """The lower case of each code point that is a letter, 0 for others."""
    lower = np.zeros(0x110000, np.int32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            small = char.lower()
            lower[code] = ord(small) if len(small) == 1 else code
    return lower


def symbol_table(texts: dict[str, list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each code point, and whether it is a letter."""
    lower = lower_letters()
    counts = np.zeros(0x110000, np.int64)
    for own in texts.values():
        codes, times = np.unique(lower[Parser.codes("".join(own))], return_counts=True)
        counts[codes] += times
    counts[0] = 0
    seen = np.flatnonzero(counts)
    place = np.full(0x110000, OTHER, np.int32)
    place[seen[np.argsort(-counts[seen], kind="stable")]] = LETTERS + np.arange(len(seen))
    return np.where(lower > 0, place[lower], GAP).astype(np.int32), lower > 0


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; every state is final."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new, at = len(moves), last
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        while at >= 0 and s not in moves[at]:
            moves[at][s] = new
            at = link[at]
        if at >= 0:
            old = moves[at][s]
            if length[old] == length[at] + 1:
                link[new] = old
            else:
                twin = len(moves)
                moves.append(dict(moves[old]))
                link.append(link[old])
                length.append(length[at] + 1)
                while at >= 0 and moves[at].get(s) == old:
                    moves[at][s] = twin
                    at = link[at]
                link[old] = link[new] = twin
        last = new
    return moves


def displaced(moves: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The place of each state but the first, and their cells.

    The move of a state by a symbol is the cell at the sum of its place and the symbol; it
    holds the places of this state and the next.  Places differ, and 0 is nobody's.  A
    state that finds no free cells in ``TRIES`` places goes to the end.
    """
    width = max((max(m) for m in moves if m), default=0) + 1
    room = 2 * sum(map(len, moves)) + 2
    used, taken = bytearray(room + width), bytearray(room)
    taken[0] = 1
    places, at = np.zeros(len(moves), np.int64), 1
    for state in sorted(range(1, len(moves)), key=lambda i: -len(moves[i])):
        own = list(moves[state])
        for _ in range(TRIES):
            at = (at * 1103515245 + 12345) & 0x7FFFFFFF
            place = at % room
            if not taken[place]:
                for s in own:
                    if used[place + s]:
                        break
                else:
                    break
        else:
            place = room + width
            used.extend(bytes(2 * width + 1))
            taken.extend(bytes(place + width + 1 - room))
            room = place + width + 1
        taken[place] = 1
        places[state] = place
        for s in own:
            used[place + s] = 1
    cells = np.full(len(used), -1, np.int64)
    for state in range(1, len(moves)):
        place = int(places[state])
        for s, to in moves[state].items():
            cells[place + s] = place << 32 | int(places[to])
    return places, cells


def parse_table(symbols: list[int], n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the automaton of a sequence, and where a phrase that starts with each symbol leads.

    A cell that names another state than the present one means that a new phrase starts.
    State 0 stands before any phrase and after a symbol that the sequence lacks.
    """
    moves = automaton(symbols)
    places, cells = displaced(moves)
    root = np.zeros(n_symbols, np.int64)
    for s, to in moves[0].items():
        root[s] = places[to]
    return np.concatenate([cells, np.full(n_symbols, -1, np.int64)]), root


class Parser:
    """Counts the phrases of many texts in every language."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.symbols, self.letters = symbol_table(texts)
        self.languages = sorted(texts)
        self.tables, self.bits, n_symbols = [], [], max(LETTERS, int(self.symbols.max()) + 1)
        for lang in self.languages:
            joined = self.symbols[self.codes("\n".join(texts[lang]))].tolist()
            self.tables.append(parse_table(joined, n_symbols))
            self.bits.append(np.log2(max(2, len(joined))))

    @staticmethod
    def codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by language and text, symbols and letters by text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        codes = self.codes("".join(texts))
        symbols = self.symbols[codes]
        ends = np.cumsum(sizes)
        sums = np.concatenate([[0], np.cumsum(self.letters[codes])])
        letters = sums[ends] - sums[ends - sizes]
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        first = (ends - sizes)[owner] + turn * BLOCK
        length = np.minimum(BLOCK, ends[owner] - first)
        padded = np.concatenate([symbols, np.full(BLOCK, END, np.int32)])
        counts = np.zeros((len(self.tables), len(texts)), np.int64)
        for lo in range(0, len(first), LANES):
            at, size = first[lo : lo + LANES], length[lo : lo + LANES]
            lanes = padded[at[None, :] + np.arange(BLOCK)[:, None]]
            lanes[np.arange(BLOCK)[:, None] >= size[None, :]] = END
            steps = lanes[: size.max()]
            for k, (cells, root) in enumerate(self.tables):
                # an end starts no phrase, but always leads to state 0 like one
                state, found = np.zeros(len(at), np.int64), size - len(steps)
                for step in steps:
                    cell = cells[state + step]
                    new = cell >> 32 != state
                    found += new
                    state = np.where(new, root[step], cell & 0xFFFFFFFF)
                counts[k] += np.bincount(owner[lo : lo + LANES], found, len(texts)).astype(np.int64)
        return counts, sizes, letters

    def __call__(self, texts: list[str]) -> tuple[list[str | None], list[float], list[float], list[bool]]:
        """The language of the least entropy, this and the second least entropy, and whether there is a letter, by text."""
        if not self.languages or not texts:
            letters = [any(c.isalpha() for c in t) for t in texts]
            return [None] * len(texts), [math.inf] * len(texts), [math.inf] * len(texts), letters
        counts, sizes, letters = self.phrases(texts)
        entropy = counts * np.array(self.bits)[:, None] / np.maximum(sizes, 1)
        order = np.argsort(entropy, axis=0, kind="stable")
        best = np.take_along_axis(entropy, order[:1], 0)[0]
        second = np.take_along_axis(entropy, order[1:2], 0)[0] if len(self.languages) > 1 else np.full(len(texts), math.inf)
        return [self.languages[i] for i in order[0]], best.tolist(), second.tolist(), (letters > 0).tolist()


def parsed(docs: DataFrame, parser: Shared, names: list[str], drop: tuple[str, ...]) -> DataFrame:
    """``docs`` with the columns ``names``: what the parser finds for each text."""

    def predict(batch: pa.RecordBatch) -> list[pa.Array]:
        found, group, size = ([], [], [], []), [], 0
        read = parser()
        for text in [*column(batch, "text").fill_null("").to_pylist(), None]:
            if text is not None:
                group.append(text)
                size += len(text)
            if text is None or size >= LANES * BLOCK:
                for own, new in zip(found, read(group)):
                    own.extend(new)
                group, size = [], 0
        return [pa.array(x, k) for x, k in zip(found, (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]

    return add_columns(docs, dict(zip(names, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()))), predict, drop)


def identify(docs: DataFrame, sample_docs: int = 40, sample_chars: int = 1000, at_once: int = 32, keep_text: bool = True) -> tuple[DataFrame, list[str]]:
    """``docs`` with the predicted language, its score and whether the text holds a letter, and the names of these columns; needs doc_id, text and lang.

    Only the sample sees lang and doc_id; predictions see the text alone.
    """
    spark, drop = docs.sparkSession, () if keep_text else ("text",)
    lang, score, best, second, letter, key, slices = names = fresh(docs, "lang_pred", "score", "best", "second", "letter", "key", "slices")
    found = names[:1] + names[2:5]
    more = samples(docs, sample_docs, sample_chars, at_once)
    part, following = next(more, {}), next(more, None)
    if following is None:
        rows = parsed(docs, Shared(spark, part, Parser), found, drop)
    else:
        keyed = cut_lineage(docs.withColumn(key, F.monotonically_increasing_id()), "texts")
        stored = []
        while part is not None:
            parser = Shared(spark, part, Parser)
            stored.append(cut_lineage(parsed(keyed.select(key, "text"), parser, found, ("text",)), "entropies"))
            parser.data.unpersist()
            part, following = following, next(more, None)
        entropies = reduce(DataFrame.unionByName, stored)
        own = F.col(slices)
        least = entropies.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(best, lang, second, letter))).alias(slices)).select(
            key, own[0][lang].alias(lang), own[0][best].alias(best), F.least(own[0][second], own[1][best]).alias(second), own[0][letter].alias(letter)
        )
        rows = keyed.drop(*drop).join(least, key).drop(key)
    sure = F.when(F.col(second) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col(best) / F.col(second)))).otherwise(0.0)
    known = F.col(letter) & F.col(lang).isNotNull()
    others = [c for c in docs.columns if c not in drop]
    return rows.select(*others, F.when(known, F.col(lang)).otherwise("und").alias(lang), F.when(known, sure).otherwise(0.0).alias(score), letter), [lang, score, letter]


def language_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    parser_rows, (lang, score, _) = identify(rows, keep_text=False, **options)
    return parser_rows.select("doc_id", held_out().alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def in_known_language(docs: DataFrame, languages: Sequence[str] | None = None, **options) -> DataFrame:
    """The rows of ``docs`` whose text is in some language, that is holds a letter; a null lang becomes the predicted one.

    With ``languages``, only texts predicted to be in one of them stay; where nothing is
    labelled there are no predictions, lang stays null and all texts with a letter stay.
    """
    found, (lang, _, letter) = identify(docs, **options)
    named = F.when(F.col(lang) != "und", F.col(lang))
    kept = found.filter(F.col(letter))
    if languages is not None:
        kept = kept.filter(named.isNull() | named.isin(list(languages)))
    kind = docs.schema["lang"].dataType
    return kept.select(*[F.coalesce("lang", named.cast(kind)).alias("lang") if c == "lang" else c for c in docs.columns])
