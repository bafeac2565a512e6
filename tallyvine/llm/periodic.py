"""Periodic runs of words: maximal stretches that repeat one block of words four times or more.

A run is a stretch of words with smallest period q (words q apart are equal) and a length of max(6, 4 q) or more that
no neighbouring word extends. Method: harmonic grid probing. For a period p only the words at multiples of p are
compared, n / p of them, so all periods together take n log n probes. Any 4 p words in a row hold four neighbouring
grid words, so a run shows as three equal neighbours on the grid; such a survivor is extended both ways by comparing
chunks of doubling size. Periods ascend, and grid words inside a run that was found are skipped: two overlapping
periods p > q that share 3 p + 1 words share a divisor of both as period (Fine and Wilf), so p would not be smallest.

All documents of a batch stand in one array, the longest first, each followed by a word of its own that equals no
other: a grid over the array serves all of them, and for period p only documents of 4 p words or more are probed.

Words are `[^\\x20\\x09-\\x0D]+`, equal when their bytes are. Null texts have no words; a null id plants nothing;
repeated rows are rows like any other; an empty table gives no rows; further columns are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table, text_views

#: A run repeats its period so often at least, and has so many words at least.
TIMES, SHORTEST = 4, 6
#: Text whose words stand in one array; a longer text stands alone.
VIEW_BYTES = 1 << 20

Run = tuple[int, int, int]  # start, length, period


def _equal_until(w: np.ndarray, at: int, period: int) -> int:
    """The first i >= at for which w[i] and w[i + period] differ (or the latter is none)."""
    size, end = 64, len(w) - period
    while at < end:
        to = min(at + size, end)
        apart = w[at:to] != w[at + period : to + period]
        k = int(apart.argmax())
        if apart[k]:
            return at + k
        at, size = to, size * 2
    return max(at, end) if end > 0 else at


def _equal_since(w: np.ndarray, at: int, period: int) -> int:
    """The first i of the stretch up to `at` in which w[i] equals w[i + period]."""
    size = 64
    while at > 0:
        low = max(0, at - size)
        apart = (w[low:at] != w[low + period : at + period])[::-1]
        k = int(apart.argmax())
        if apart[k]:
            return at - k
        at, size = low, size * 2
    return 0


def find_runs(w: np.ndarray, tops: list[tuple[int, int]], times: int = TIMES, shortest: int = SHORTEST) -> list[Run]:
    """All runs in an array of word numbers. tops: (longest period, words of the array to probe for periods beyond the
    one before), by ascending period."""
    found: list[Run] = []
    reach = np.zeros(len(w), np.int64)  # the furthest end of the runs that hold a word
    period = 1
    for longest, n in tops:
        v = w[:n]
        for p in range(period, longest + 1):
            grid = v[::p]
            same = grid[1:] == grid[:-1]
            last = len(same) - times + 2
            if last <= 0:
                continue
            hits = same[:last]
            for k in range(1, times - 1):
                hits = hits & same[k : k + last]
            hits = np.flatnonzero(hits) * p
            span = (times - 1) * p
            for at in hits[reach[hits] <= hits + span].tolist():
                if reach[at] > at + span:
                    continue  # in a run found meanwhile
                until = _equal_until(v, at, p)
                if until < at + span - p:
                    continue
                start = _equal_since(v, at, p)
                length = until + p - start
                if length >= max(shortest, times * p):
                    found.append((start, length, p))
                    np.maximum(reach[start : start + length], start + length, out=reach[start : start + length])
        period = max(period, longest + 1)
    return found


def runs_of_texts(texts: list[np.ndarray], times: int = TIMES, shortest: int = SHORTEST) -> list[list[Run]]:
    """The runs of each text (word numbers), by start, then period."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    sizes = np.array([len(texts[k]) + 1 for k in order], np.int64)
    ends = np.cumsum(sizes)
    most = max((int(t.max()) for t in texts if len(t)), default=-1)
    w = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for k, end, size in zip(order, ends.tolist(), sizes.tolist()):
        w[end - size : end - 1] = texts[k]
        w[end - 1] = most + 1 + k
    tops: dict[int, int] = {}
    for size, end in zip(sizes.tolist(), ends.tolist()):
        tops[(size - 1) // times] = end  # the last text that has room for so long a period
    out: list[list[Run]] = [[] for _ in texts]
    for start, length, p in find_runs(w, sorted(t for t in tops.items() if t[0]), times, shortest):
        k = int(np.searchsorted(ends, start, "right"))
        out[order[k]].append((start - int(ends[k] - sizes[k]), length, p))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Whether each of n words stays when every run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, p in runs:
        edge[start + p] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:n] == 0


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length over period; ties: the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def planted(n: int, doc_id: int | None) -> np.ndarray:
    """Which original word stands at each place of a text of n words in the contract's edited texts."""
    at = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


def _batches(rows: Callable[[pa.RecordBatch, list[list[bytes]], list[np.ndarray], list[list[Run]]], pa.RecordBatch], places: Callable[[int, int | None], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rows(batch, words, places, runs) of each batch of (id, text, ...), whose word i is the text's word places[i]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in text_views(b.column(1), VIEW_BYTES):
                part, numbers = b.slice(first, end - first), {}
                words, at, texts = [], [], []
                for x, y, i in zip(offsets[:-1].tolist(), offsets[1:].tolist(), part.column(0).to_pylist()):
                    words.append(data[x:y].tobytes().split())  # by the six bytes of white space, as ASCII has them
                    at.append(places(len(words[-1]), i))
                    texts.append(np.array([numbers.setdefault(w, len(numbers)) for w in words[-1]], np.int64)[at[-1]])
                yield rows(part, words, at, runs_of_texts(texts))

    return lean(run)


def _digests(part: pa.RecordBatch, words: list[list[bytes]], places: list[np.ndarray], runs: list[list[Run]]) -> pa.RecordBatch:
    best = [strongest(r) for r in runs]
    pick = lambda f: pa.array([None if r is None else f(r) for r in best], pa.int64())
    listed = [hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in r).encode()).hexdigest() for r in runs]
    collapsed = [hashlib.sha256(b" ".join(w[k] for k in at[kept_words(len(at), r)].tolist())).hexdigest() for w, at, r in zip(words, places, runs)]
    columns = [part.column(0), pa.array([len(r) for r in runs], pa.int64()), pick(lambda r: r[0]), pick(lambda r: r[1]), pick(lambda r: r[2]), pick(lambda r: 1000 * r[1] // r[2]), pa.array(listed), pa.array(collapsed)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def _listed(part: pa.RecordBatch, words: list[list[bytes]], places: list[np.ndarray], runs: list[list[Run]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    text = pa.array([b" ".join(w[k] for k in np.flatnonzero(kept_words(len(w), r)).tolist()).decode() for w, r in zip(words, runs)])
    return pa.RecordBatch.from_arrays([part.column(0), pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in runs], kind), text], names=["id", "runs", "collapsed"])


def periodic_runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, runs (start, length, period of each, in order) and collapsed (the text's words, single spaced, every run cut
    to its first period) of each row of df."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_batches(_listed, lambda n, _: np.arange(n)), f"id {rows.schema['id'].dataType.simpleString()}, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("id", id_col)


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents' whole texts, a tenth of them with a repetition planted by their doc_id."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.mapInArrow(_batches(_digests, planted), kinds)
