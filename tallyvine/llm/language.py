"""Language identification by words first, then ever shorter character n-grams.

A word is a run of letters, lower-cased. A word of the model adds its log frequency in each language. Any other word
backs off: the longest n-grams (five characters down to one, one character beyond either end of the word included) of
which the model knows any add the mean of their log frequencies. The languages' sums per text, tempered by the square
root of the number of words, give the prediction and its score.

The model is fitted on at most FIT_DOCS labelled rows per language, those of the smallest hash of doc_id, and keeps
the WORDS most frequent words and GRAMS n-grams of each length per language. Every value of lang is a language; tables
hold only the frequencies that a language has, so the model grows in proportion to the languages. Defined results: null
texts and texts without a letter give `und` and score 0; a model without languages gives `und`; ties go to the first
language by name; repeated rows are rows like any other; an empty table gives no rows; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, lean, table, text_views, written
from .toxicity import fold
from .words import mix

FIT_DOCS = 2000
WORDS, GRAMS, LONGEST = 30_000, 20_000, 5
_POINT = 0x9E3779B97F4A7C15
#: Code points of a piece of a long text, twice over; those of a piece of several texts, and bytes of text that a task takes at once.
_LIMIT, _TOGETHER = 1 << 20, 1 << 18
#: Numbers of a dense block of words or n-grams by languages, and languages that the driver fetches at once.
_CELLS, _FETCHED = 1 << 22, 16
_letters: list[np.ndarray] = []
_powers: list[np.ndarray] = []


@dataclass
class Sparse:
    """Rows of log frequencies by language, indexed as a dense array is: row i has values[first[i] : first[i + 1]] of the languages at the same places, and rest of all others."""

    first: np.ndarray
    languages: np.ndarray
    values: np.ndarray
    rest: np.ndarray

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        n = self.first[at + 1] - self.first[at]
        place = np.arange(int(n.sum())) + np.repeat(self.first[at] - np.cumsum(n) + n, n)
        out = np.repeat(self.rest[None, :], len(at), axis=0)
        out[np.repeat(np.arange(len(at)), n), self.languages[place]] = self.values[place]
        return out


@dataclass
class Model:
    """Languages, and for words and for n-grams of each length: sorted hashes and their log frequencies by language."""

    languages: list[str]
    words: tuple[np.ndarray, np.ndarray | Sparse]
    grams: dict[int, tuple[np.ndarray, np.ndarray | Sparse]]


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def _hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans of code points; every non-letter counts as the same."""
    if not _powers or len(_powers[0]) <= len(points):
        n = max(_TOGETHER, 1 << len(points).bit_length())  # a worker keeps them
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, p, np.uint64)])) for p in (_POINT, pow(_POINT, -1, 2**64))]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(points.astype(np.uint64) + np.uint64(0x51)) * _powers[0][: len(points)])])
    return mix((sums[ends] - sums[starts]) * _powers[1][starts])


def _hash_of(grams: list[str]) -> np.ndarray:
    """The same hashes of single strings in which a blank stands for a non-letter."""
    points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).copy()
    points[points == 32] = 0
    ends = np.cumsum([len(g) for g in grams]).astype(np.int64)
    return _hashes(points, ends - np.array([len(g) for g in grams], np.int64), ends) if grams else np.zeros(0, np.uint64)


def _known(table_: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes the table has, and where."""
    if not len(table_[0]):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(table_[0], hashes), len(table_[0]) - 1)
    return table_[0][at] == hashes, at


def word_scores(model: Model, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log frequencies by language of the words at the given spans (non-letters are 0 in points), and what gave them:
    LONGEST + 1 for a known word, the length of n-grams, 0 for nothing."""
    hashes = _hashes(points, starts, ends)
    _, one, of = np.unique(hashes, return_index=True, return_inverse=True)
    mine = np.zeros((len(one), len(model.languages)))
    known, at = _known(model.words, hashes[one])
    mine[known] = model.words[1][at[known]]
    basis = np.where(known, LONGEST + 1, 0)
    left = np.flatnonzero(~known)
    for k in range(LONGEST, 0, -1):
        if not len(left):
            break
        low, high = starts[one[left]] - (k > 1), ends[one[left]] + (k > 1)
        n = np.maximum(high - low - k + 1, 0)
        owner = np.repeat(np.arange(len(left)), n)
        begin = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + low[owner]
        known, at = _known(model.grams[k], _hashes(points, begin, begin + k))
        count = np.bincount(owner[known], minlength=len(left))
        found = count > 0
        owner, at, step = owner[known], at[known], max(1, _CELLS // max(1, len(model.languages)))
        total = np.zeros((len(model.languages), len(left)))
        for a in range(0, len(at), step):
            block = model.grams[k][1][at[a : a + step]]
            for j in range(len(model.languages)):
                total[j] += np.bincount(owner[a : a + step], block[:, j], minlength=len(left))
        mine[left[found]] = (total[:, found] / count[found]).T
        basis[left[found]] = k
        left = left[~found]
    return mine[of], basis[of]


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Code points of lower-cased texts, a blank around each, and the row of each piece; a long text makes several."""
    held, rows, size = [], [], 0
    for row, text in enumerate(texts):
        text = text.lower()
        for a in [0] if len(text) <= _LIMIT // 2 else _cuts(text):
            part = text[a : a + _LIMIT // 2] if len(text) <= _LIMIT // 2 else text[a[0] : a[1]]
            if size and size + len(part) > _TOGETHER:
                yield _points(held), rows
                held, rows, size = [], [], 0
            held.append(part)
            rows.append(row)
            size += len(part) + 1
    if held:
        yield _points(held), rows


def _cuts(text: str) -> list[tuple[int, int]]:
    """Spans of a long text that end between words: a span grows to the end of the word that it would cut."""
    out, at = [], 0
    while at < len(text):
        to = min(len(text), at + _LIMIT // 2)
        while to < len(text) and text[to].isalpha():
            to += 1
        out.append((at, to))
        at = to
    return out


def _points(held: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points with 0 for non-letters, and where each piece begins."""
    points = np.frombuffer(("\n" + "\n".join(held) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    first = 1 + np.concatenate([[0], np.cumsum([len(h) + 1 for h in held])])
    points[~_is_letter()[points]] = 0
    return points, first


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each text, and the best basis of any word of it (see word_scores)."""
    total, count = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    basis = np.zeros(len(texts), np.int64)
    for (points, first), rows in _pieces(texts):
        letter = points > 0
        starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        owner = np.asarray(rows)[np.searchsorted(first, starts, "right") - 1]
        if len(starts) and model.languages:
            step = max(1, _CELLS // len(model.languages))
            for a in range(0, len(starts), step):
                found, by = word_scores(model, points, starts[a : a + step], ends[a : a + step])
                np.maximum.at(basis, owner[a : a + step], by)
                for j in range(len(model.languages)):
                    total[:, j] += np.bincount(owner[a : a + step], found[:, j], minlength=len(texts))
        count += np.bincount(owner, minlength=len(texts))
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), basis
    best = total.argmax(axis=1)
    power = np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(count, 1))[:, None])
    score = np.where(count > 0, power.max(axis=1) / power.sum(axis=1), 0.0)
    return [model.languages[b] if c else "und" for b, c in zip(best, count)], score, basis


def fit(docs: DataFrame, usable: Column) -> Model:
    """A model from rows of docs (doc_id, text, lang) that are usable (a condition on doc_id) and have a language."""
    mine = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r[0]: r[1] for r in mine.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    shares = docs.sparkSession.createDataFrame([(g, (FIT_DOCS + 6 * FIT_DOCS**0.5 + 10) / n) for g, n in sizes.items()], "lang string, _share double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # as few_by_hash does, for any number of groups
    chosen = mine.select("lang", "doc_id").join(F.broadcast(shares), "lang").where(place <= F.col("_share")).withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id")))
    chosen = chosen.where(F.col("_rank") <= FIT_DOCS).select("doc_id").distinct()  # at most FIT_DOCS ids per language
    texts = mine.select("doc_id", "lang", "text").join(F.broadcast(chosen) if FIT_DOCS * len(languages) <= MAX_BROADCAST_ROWS else chosen.hint("merge"), "doc_id")
    words = texts.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    words = words.repartition("lang", "gram")
    # letters are a column of their own: taking a part of a text counts its letters from the start each time
    letters = words.withColumn("_c", F.split(F.concat(F.lit(" "), F.col("gram"), F.lit(" ")), ""))
    of = lambda k: F.transform(F.sequence(F.lit(0), F.size("_c") - k), lambda i: F.concat(*[F.get(F.col("_c"), i + j) for j in range(k)])) if k > 1 else F.split("gram", "")
    some = [words.select("lang", F.lit(0).alias("k"), "gram", "n")]
    for k in range(1, LONGEST + 1):
        some.append(letters.where(F.size("_c") >= k).select("lang", F.lit(k).alias("k"), F.explode(of(k)).alias("gram"), "n").where("gram <> ''").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")))
    counts = some[0]
    for x in some[1:]:
        counts = counts.union(x)
    rank = F.row_number().over(Window.partitionBy("lang", "k").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("_r", rank).where(F.col("_r") <= F.when(F.col("k") == 0, WORDS).otherwise(GRAMS)).drop("_r")
    top = written(top, "grams")
    made = {}
    for k in range(LONGEST + 1):  # one length and a few languages at a time on the driver
        hashes, langs, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0)]
        for a in range(0, len(languages), _FETCHED):
            part = top.where((F.col("k") == k) & F.col("lang").isin(languages[a : a + _FETCHED])).select("lang", "gram", "n").toPandas()
            hashes.append(_hash_of(list(part["gram"])))
            langs.append(np.searchsorted(np.array(languages, object), part["lang"].to_numpy(object)).astype(np.int32))
            counts.append(part["n"].to_numpy(float))
        hashes, langs, counts = map(np.concatenate, (hashes, langs, counts))
        order = np.argsort(hashes, kind="stable")
        own, first = np.unique(hashes[order], return_index=True)
        sums = np.bincount(langs, counts, len(languages)) + 0.5 * len(own)
        values = np.log((counts + 0.5) / sums[langs])[order]
        made[k] = (own, Sparse(np.append(first, len(hashes)), langs[order], values, np.log(0.5 / np.maximum(sums, 0.5))))
    return Model(languages, made[0], {k: made[k] for k in range(1, LONGEST + 1)})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, _, _ in text_views(b.column(1), _TOGETHER):
                part = b.slice(first, end - first)
                langs, score, _ = predict(sent.value, [t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(rows), "doc_id long, lang_pred string, score double")


#: A text is in a language of the model if one of its words is known, or has an n-gram so long that is.
EVIDENCE = 3


def with_language(docs: DataFrame, model: Model, least: int = EVIDENCE) -> DataFrame:
    """The rows of docs, with all their columns, whose text is in a language of the model: not those without a letter,
    nor those of which no word is known and no n-gram of `least` letters or more. That two languages are equally likely
    is no reason to reject a text, as with single words that both have."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index("text"))
            for first, end, _, _ in text_views(column, _TOGETHER):
                langs, _, basis = predict(sent.value, [t or "" for t in column.slice(first, end - first).to_pylist()])
                yield b.slice(first, end - first).filter(pa.array((basis >= least) & (np.array(langs) != "und")))

    return docs.mapInArrow(lean(rows), docs.schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all documents by a model of the rows that are not held out. Rows without doc_id are neither held
    out nor learned from; null texts and texts without a letter give und and 0; repeated rows give a row each."""
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 0
    held_out = held_out & F.col("doc_id").isNotNull()
    return identify(docs, fit(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
