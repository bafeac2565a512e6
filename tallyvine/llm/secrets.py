"""Secret scans: fixed patterns, and guess costs of values in a credential's context.

Base patterns (kinds assign, access, hex) are matched leftmost without overlaps, and matches of the wrong length fall.
Beyond them a value that follows a credential word and a separator is a secret (kind guess) if an attacker who knows
words, dates, repeats and keyboard walks needs GUESS_BITS bits of guesses or more: dynamic programming finds the
cheapest segmentation of the whole value. Every value in a credential's context is costed, also those inside base
spans. Word ranks come from a public tokenizer's vocabulary file (VOCABULARY, a parameter); a missing file is an error.

The attacker's grammar, each segment at one bit for its place but brute force: a character (log2 10 bits); a word of
the list (its rank; a bit for a capital or all capitals, a bit a letter for other mixtures); a year, or a date of 4 to
10 characters; three or more equal characters; three or more steps on the keyboard; a block of 2 to PERIOD characters
twice or more in a row (the cheapest segmentation of the block and the number of times). Repeats, walks, counts of
blocks and words may have any length.

Defined results: null and empty texts have no spans; spans are in code points, end exclusive; guess spans that overlap
base spans fall; repeated rows are rows like any other; further columns are never read.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Kinds in the order of ties, their patterns and least lengths (of group 2 for assign).
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
#: Words before a value, and the literals of which every one of them has one.
CONTEXT = re.compile(r"""(?<![a-z])(?:pass(?:word|wd|phrase|code)?|passwort|pwd|login|credentials?|contraseña|clave|secret|token|(?:api|access|private)[_-]?key|auth(?:orization)?|bearer)["']?\s{0,4}(?::=|=>|->|[:=]|\bis\b)\s{0,4}["'`]?([^\s"'`<>]{6,})""", re.I)
NEAR = ("pass", "pwd", "login", "credential", "contrase", "clave", "secret", "token", "key", "auth", "bearer")
#: 10**10 guesses: beyond what an offline attack on a slow hash tries first.
GUESS_BITS = 33.2
COMMON = "password 123456 12345678 qwerty letmein admin welcome login abc123 monkey dragon master football iloveyou sunshine princess secret root test guest changeme default example sample required optional null none true false user username your value string".split()
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890")
PERIOD = 32
_YEAR = re.compile(r"(?:19|20)\d\d")
_DATE = re.compile(r"\d{1,2}([./-]?)\d{1,2}\1(?:19|20)?\d\d|(?:19|20)\d\d([./-]?)\d{1,2}\2\d{1,2}")
_BRUTE = math.log2(10)
_YEAR_BITS, _DATE_BITS, _WALK_BITS = math.log2(120) + 1, math.log2(366 * 120) + 1, math.log2(40) + 1
_steps: set[tuple[str, str]] = {(a, b) for row in KEYBOARD for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))} | {(a, b) for up, down in zip(KEYBOARD[:2], KEYBOARD[1:3]) for i, b in enumerate(down) for a in (up[i], up[min(i + 1, len(up) - 1)])} | {(b, a) for up, down in zip(KEYBOARD[:2], KEYBOARD[1:3]) for i, b in enumerate(down) for a in (up[i], up[min(i + 1, len(up) - 1)])}


def word_bits(path: str = VOCABULARY) -> dict[str, float]:
    """Bits of the rank of each word of three letters or more: common passwords, then the vocabulary in its order."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = COMMON + [w for w in (x.removesuffix("</w>").lower() for x in sorted(vocabulary, key=vocabulary.get)) if len(w) > 2 and w.isalpha()]
    return {w: math.log2(k + 2) for k, w in enumerate(dict.fromkeys(words))}


class _Starts:
    """Starts a of a run, of which best() finds min(bits[a] + log2((i - a) / unit) + slope * (i - a)).

    Between two starts the older one's disadvantage only shrinks as i grows, down to what bits and slope leave. So a
    newer start that is no cheaper now never will be, and an older one that is dearer without the logarithm always is:
    both are dropped, and few starts remain in any run.
    """

    def __init__(self, unit: int = 1, slope: float = 0.0) -> None:
        self.unit, self.slope, self.held = unit, slope, []

    def best(self, i: int, bits: list[float], new: int) -> float:
        held, slope = self.held, self.slope
        while held and bits[held[-1]] - slope * held[-1] >= bits[new] - slope * new:
            held.pop()
        least, kept = math.inf, []
        for a in (*held, new):
            cost = bits[a] + math.log2((i - a) // self.unit) + slope * (i - a)
            if cost < least:
                least = cost
                kept.append(a)
        self.held = kept
        return least


def guess_bits(value: str, words: dict[str, float], longest: int | None = None) -> float:
    """Bits of guesses of the cheapest segmentation of the whole value. longest: the length of the longest word."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a few letters change their length
        low = value
    longest = max(map(len, words), default=0) if longest is None else longest
    best = [0.0] + [math.inf] * n
    same, walk = 0, 0  # equal pairs and steps that end here
    repeats, walks = _Starts(), _Starts(slope=0.5)
    periods = range(2, min(PERIOD, n // 2) + 1)
    equal = [0] * (len(periods) + 2)
    blocks: dict[tuple[int, int], _Starts] = {}
    inner: dict[str, float] = {}
    for i in range(1, n + 1):
        c = value[i - 1]
        cost = best[i - 1] + _BRUTE
        for a in range(max(0, i - longest), i):
            bits = words.get(low[a:i])
            if bits is not None:
                part = value[a:i]
                cased = 0.0 if part.islower() else 1.0 if part.istitle() or part.isupper() else float(i - a)
                cost = min(cost, best[a] + bits + cased + 1)
        if c.isdigit():
            for a in range(max(0, i - 10), i - 3):
                if low[a].isdigit():
                    if i - a == 4 and _YEAR.fullmatch(low, a, i):
                        cost = min(cost, best[a] + _YEAR_BITS)
                    if _DATE.fullmatch(low, a, i):
                        cost = min(cost, best[a] + _DATE_BITS)
        if i > 1:
            if c == value[i - 2]:
                same += 1
            else:
                same, repeats.held = 0, []
            if same >= 2:
                cost = min(cost, repeats.best(i, best, i - 3) + _BRUTE + 1)
            if (low[i - 2], low[i - 1]) in _steps:
                walk += 1
            else:
                walk, walks.held = 0, []
            if walk >= 2:
                cost = min(cost, walks.best(i, best, i - 3) + _WALK_BITS)
        for p in periods:
            if i <= p or c != value[i - 1 - p]:
                if equal[p]:
                    for r in range(p):
                        blocks.pop((p, r), None)
                equal[p] = 0
                continue
            equal[p] += 1
            if equal[p] >= p:
                block = value[i - p : i]
                if block not in inner:
                    inner[block] = guess_bits(block, words, longest)
                starts = blocks.setdefault((p, i % p), _Starts(p))
                cost = min(cost, starts.best(i, best, i - 2 * p) + inner[block] + 1)
        best[i] = cost
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    low = text.lower()
    out = []
    if "pass" in low or "secret" in low or "token" in low or "key" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def context_values(text: str) -> list[tuple[int, int]]:
    """Spans of the values in a credential's context: after a credential word, and those of the assign pattern."""
    low = text.lower()
    if not any(k in low for k in NEAR):
        return []
    out = set()
    for m in CONTEXT.finditer(text):
        a = m.start(1)
        b = a + len(m[1].rstrip(".,;:!?)]}"))
        if b - a >= ASSIGN_LEAST:
            out.add((a, b))
    out |= {m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST}
    return sorted(out)


def costed(text: str, base: list[tuple[int, int, int]], words: dict[str, float], longest: int | None = None) -> tuple[list[tuple[int, int, float]], list[tuple[int, int, int, float]]]:
    """(start, end, bits) of all values in context, and spans (start, kind, end, bits) of those among them that are hard
    to guess and overlap no base span nor each other."""
    values = [(a, b, guess_bits(text[a:b], words, longest)) for a, b in context_values(text)]
    out, at, last = [], 0, 0
    for a, b, bits in values:
        while at < len(base) and base[at][2] <= a:
            at += 1
        if bits >= GUESS_BITS and a >= last and not any(x < b and y > a for x, _, y in base[max(0, at - 3) : at + 4]):
            out.append((a, 3, b, bits))
            last = b
    return values, out


def named(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


def redacted(text: str, spans: list[tuple], mark: str = "[SECRET]") -> str:
    """text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for s in spans:
        if s[0] >= at:
            out += [text[at : s[0]], mark]
        at = max(at, s[2])
    return "".join([*out, text[at:]])


def _found(text: str, words: dict[str, float], longest: int) -> tuple[list, list, list]:
    """Base spans, values in context, and all spans of a text."""
    base = base_spans(text)
    values, more = costed(text, base, words, longest)
    return base, values, sorted([*base, *more])


def secrets(docs: DataFrame, words: dict[str, float] | None = None) -> DataFrame:
    """doc_id, counts by kind, base digest, all spans, the bits of every value in a credential's context (start:end:bits,
    comma-joined), and the text with all spans redacted."""
    words = word_bits() if words is None else words
    sent, longest = docs.sparkSession.sparkContext.broadcast(words), max(map(len, words), default=0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 1000):
                part = b.slice(first, 1000)
                made = []
                for text in part.column(1).to_pylist():
                    base, values, spans = _found(text or "", sent.value, longest)
                    costs = ",".join(f"{x}:{y}:{bits:.2f}" for x, y, bits in values)
                    made.append((*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(named(base).encode()).hexdigest(), named(spans), len(spans) - len(base), max((v[2] for v in values), default=None), costs, redacted(text, spans) if text else text))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, t) for v, t in zip(zip(*made), types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "most_bits", "value_bits", "redacted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(rows), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, most_bits double, value_bits string, redacted string")


def without_secrets(docs: DataFrame, words: dict[str, float] | None = None) -> DataFrame:
    """docs with all spans of text redacted and n_chars, if there is one, counted anew where the text changed."""
    words = word_bits() if words is None else words
    sent, longest = docs.sparkSession.sparkContext.broadcast(words), max(map(len, words), default=0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, size = b.schema.get_field_index("text"), b.schema.get_field_index("n_chars")
            for first in range(0, b.num_rows, 1000):
                part = b.slice(first, 1000)
                texts = []
                for text in part.column(at).to_pylist():
                    spans = _found(text or "", sent.value, longest)[2]
                    texts.append(redacted(text, spans) if spans else text)
                columns = list(part.columns)
                if size >= 0:
                    counts = [n if new == old else len(new) for n, new, old in zip(columns[size].to_pylist(), texts, columns[at].to_pylist())]
                    columns[size] = pa.array(counts, b.schema.field(size).type)
                columns[at] = pa.array(texts, b.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(lean(rows), docs.schema)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """secrets() of all documents without the redacted text. Null and empty texts have counts of 0 and empty spans;
    repeated rows give a row each; an empty table gives none."""
    return secrets(table(spark, sf_dir, "documents")).drop("redacted")
