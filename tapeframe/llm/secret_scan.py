"""Secret scans: fixed patterns, and values that would take many guesses.

The patterns find assignments, access keys and long hexadecimal runs.  Beside them, every
value in a credential context (a word such as "passphrase" or "auth", a sign, a value) is
weighed by the cheapest way to guess it: dynamic programming over its characters finds the
segmentation into words (listed ones, and letters that read like one), dates, repeats,
keyboard walks and brute force with the fewest guesses.  A value of at least ``least`` decimal digits of guesses is a secret; names,
dates, placeholders and keyboard rows are not.

Every text is scanned whole in its own task; cheap searches for literals decide whether
the patterns run at all.  A null or empty text has no spans, repeated rows give repeated
results, other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.llm.batches import column, map_batches

# Common passwords and parts of them, the most common first.
WORDS = (
    "password 123456 qwerty admin welcome letmein login secret changeme default test guest master monkey dragon football baseball "
    "iloveyou sunshine princess shadow michael superman batman trustno1 hello freedom whatever ninja mustang access flower passw0rd "
    "hunter summer winter spring autumn love money computer internet server root user example sample placeholder required optional "
    "none null undefined true false your here token value string insert replace enter please the and for with key api auth bearer basic "
    "name email account office company house family friend music cheese coffee orange purple silver golden black white green blue red "
    "killer soccer hockey george jordan thomas robert daniel charlie andrew jessica michelle jennifer ashley london paris berlin monday "
    "friday sunday january february march april june july august september october november december"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("013457@$!", "oieastasi")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
HEX_TEXT = re.compile(r"[0-9a-f]{24,}")
# the stem is a word of its own or a part of a name like DB_PASSWORD or auth-token2
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|auth(?:[_-]?token)?|credentials?|login|private[_-]?key)(?:[_-][A-Za-z0-9]{1,16}|\d{1,4}){0,3}"""
    r"""["']?\s{0,4}(?:=>|[:=])\s{0,4}["']?([^\s"'<>]+)""",
    re.ASCII | re.IGNORECASE,
)
# Letters that read like a word: a vowel at least every fifth letter.  They cost as much as a dictionary of LEXICON words.
WORDLIKE = re.compile(r"(?:[b-df-hj-np-tv-xz]{0,4}[aeiouy])+[b-df-hj-np-tv-xz]{0,4}")
LEXICON = 100_000
STEMS = (b"pass", b"pwd", b"secret", b"token", b"api", b"auth", b"credential", b"login", b"private")
DAY, MONTH = r"(?:3[01]|[12]\d|0?[1-9])", r"(?:1[0-2]|0?[1-9])"
DATE = re.compile(rf"(?:19|20)\d\d[-/.]?{MONTH}[-/.]?{DAY}|{DAY}[-/.]{MONTH}[-/.](?:19|20)?\d\d|(?:19|20)\d\d")
KINDS = ("assign", "access", "hex", "guess")


def beside() -> dict[tuple[str, str], tuple[int, int]]:
    """Direction from each key to each one next to it; a row is shifted by half a key."""
    place = {key: (x, y) for y, row in enumerate(ROWS) for x, key in enumerate(row)}
    steps = ((-1, 0), (1, 0), (0, -1), (1, -1), (-1, 1), (0, 1))
    return {(a, b): (u - x, v - y) for a, (x, y) in place.items() for b, (u, v) in place.items() if (u - x, v - y) in steps}


class GuessCost:
    """log10 of the guesses that the cheapest segmentation of a value takes."""

    def __init__(self, words: tuple[str, ...] | list[str] = WORDS) -> None:
        self.rank = {w: math.log10(i + 2) for i, w in reversed(list(enumerate(words)))}
        self.longest = max(map(len, self.rank), default=0)
        self.near = beside()

    @staticmethod
    def brute(char: str) -> float:
        if char.isdigit():
            return 1.0
        return math.log10(26) if char.isascii() and char.isalpha() else math.log10(33 if char.isascii() else 100)

    def __call__(self, value: str) -> float:
        n, low = len(value), value.lower()
        low = low if len(low) == n else value
        plain = low.translate(LEET)
        best = [0.0] + [math.inf] * n
        dates: dict[int, list[int]] = {}
        for i in range(n):
            if value[i].isdigit():
                m = DATE.match(value, i)
                if m:
                    dates.setdefault(m.end(), []).append(i)
        prose: dict[int, int] = {}
        for m in re.finditer(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}", value):
            if WORDLIKE.fullmatch(low, m.start(), m.end()):
                prose[m.end()] = m.start()
        walk = turns = 0
        way = None
        same = [0] * 5
        for i in range(1, n + 1):
            part = 0.3  # a guesser must also choose where segments end
            cost = best[i - 1] + self.brute(value[i - 1])
            for j in range(max(0, i - self.longest), i - 2):
                rank = self.rank.get(low[j:i])
                extra = 0.0
                if rank is None:
                    rank, extra = self.rank.get(plain[j:i]), 0.6
                if rank is not None:
                    upper = sum(c.isupper() for c in value[j:i])
                    case = 0.3 * min(upper, i - j - upper) + (0.3 if upper else 0.0)
                    cost = min(cost, best[j] + part + rank + extra + case)
            if i in prose:
                cost = min(cost, best[prose[i]] + part + math.log10(LEXICON))
            for j in dates.get(i, ()):
                cost = min(cost, best[j] + part + (math.log10(365 * 120) if i - j > 4 else math.log10(120)))
            step = self.near.get((low[i - 2], low[i - 1])) if i > 1 else None
            if step:
                turns += way is not None and step != way
                walk += 1
                if walk >= 3:
                    cost = min(cost, best[i - 1 - walk] + part + math.log10(47 * (walk + 1)) + 0.4 * turns)
            else:
                walk = turns = 0
            way = step
            for p in range(1, 5):
                same[p] = same[p] + 1 if i > p and value[i - 1] == value[i - 1 - p] else 0
                times = same[p] // p + 1
                if times >= 3:
                    j = i - times * p
                    unit = sum(map(self.brute, value[j : j + p]))
                    cost = min(cost, best[j] + part + unit + math.log10(times))
            best[i] = cost
        return best[n]


class Finder:
    def __init__(self, words: list[str], least: float, shortest: int) -> None:
        self.cost, self.least, self.shortest = GuessCost(words), least, shortest

    def __call__(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, kind, end) of all spans, in order."""
        low = data.lower()
        credential, key, run = any(s in low for s in STEMS), b"AKIA" in data, HEX.search(data)
        if not (credential or key or run):
            return []
        text, found = data.decode(errors="replace"), []
        if credential:
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
            for m in CONTEXT.finditer(text):
                if len(m[1]) >= self.shortest and self.cost(m[1]) >= self.least:
                    found.append((m.start(1), 3, m.end(1)))
        if key:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        if run:
            found += [(m.start(), 2, m.end()) for m in HEX_TEXT.finditer(text)]
        return sorted(found)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame, words: list[str] = WORDS, least: float = 10.0, shortest: int = 8) -> DataFrame:
    """doc_id, counts of the fixed kinds, the digest of their spans, and all spans of every row; offsets are code points."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        finder = Finder(words, least, shortest)
        counts, digests, spans = ([], [], []), [], []
        for data in column(batch, "text").fill_null("").cast(pa.binary()).to_pylist():
            found = finder(data)
            base = [x for x in found if x[1] < 3]
            for kind, out in enumerate(counts):
                out.append(sum(x[1] == kind for x in base))
            digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
            spans.append(listed(found))
        longs = [pa.array(c, pa.int64()) for c in counts]
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), *longs, pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    return map_batches(rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", scan)


def redact(docs: DataFrame, mark: str = "[secret]", **options) -> DataFrame:
    """``docs`` with the found spans of ``text`` replaced by ``mark``; null texts stay null."""
    finder = Finder(options.get("words", WORDS), options.get("least", 10.0), options.get("shortest", 8))

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for data in column(batch, "text").cast(pa.binary()).to_pylist():
            spans = finder(data) if data else []
            text, at, kept = (data.decode(errors="replace") if data is not None else None), 0, []
            for start, _, end in spans:
                if start >= at:
                    kept += [text[at:start], mark]
                at = max(at, end)
            out.append("".join([*kept, text[at:]]) if spans else text)
        i = batch.schema.get_field_index("text")
        return batch.set_column(i, "text", pa.array(out, pa.string()))

    return map_batches(docs, docs.schema, clean)
