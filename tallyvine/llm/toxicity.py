"""Convolutional text classifier for toxicity: hashed word embeddings, filters of several widths, max pooling.

Words are runs of letters (A-Z lower-cased). Each has three hashed rows of embeddings, of the word, its first six and
its first four bytes, so that inflected forms share what was learned; rows of fewer than three
training texts are zero. Filters of one, two and three words slide over the
whole text, each gives its largest response, and a logistic layer turns these into a score. All usable labelled rows
with a text count, whatever their length: four fifths of them, by a hash of doc_id, train, the other fifth sets thresholds
by language; the language never enters the score. Training is data-parallel: rows are dealt into shards by a hash, each
shard makes one pass from the common model in a task, and models are averaged by the rows of their shards, EPOCHS times.
Words' document counts are sums over all training rows, thresholds are chosen from counts of all scores in SCORE_STEPS
steps.

Defined results: null and empty texts have no words and get the score of an all-zero pooling; if all labelled texts of
a class fall in the fifth set aside, all rows train and thresholds are PREDICT; without labelled texts of both classes
every score is the share of toxic ones among them (0 if none) and none is rejected; rows without doc_id are not held out;
repeated rows are rows like any other; an empty table gives no rows; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, cut, lean, table, text_views, written
from .words import NOT_LETTER, mix, word_hashes

#: Passes over the training rows, words of a shard (a task holds them), steps of a score from 0 to 1 in the thresholds'
#: counts, numbers of a model that one task averages.
EPOCHS, SHARD_WORDS, SCORE_STEPS, CHUNK = 5, 2_000_000, 1 << 16, 1 << 16
ROWS, DIM = 1 << 17, 6
VIEWS = (1 << 62, 6, 4)  # how many bytes of a word each table sees
WIDTHS, FILTERS = (1, 2, 3), 16
PREDICT = 0.7
#: Text that a task hashes at once.
VIEW_BYTES = 1 << 18


@dataclass
class Model:
    """Embeddings (a table per view, row 0 is padding), filters and biases per width, the logistic layer, thresholds."""

    tables: list[np.ndarray]
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weight: np.ndarray
    bias: float
    thresholds: dict = field(default_factory=dict)


def embedding_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows (from 1) of each word, (words, views), and where each text's words begin."""
    views = [word_hashes(data, offsets, NOT_LETTER, most) for most in VIEWS]
    return np.stack([(mix(h + np.uint64(k)) % np.uint64(ROWS - 1)).astype(np.int32) + 1 for k, (h, _) in enumerate(views)], axis=1), views[0][1]


def _responses(model: Model, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Embedded words of documents, each followed by two paddings, and the responses of each width at each word.

    first: where each document's words begin in rows (one entry more than documents).
    """
    sizes = np.diff(first)
    at = np.arange(len(rows)) + 2 * np.repeat(np.arange(len(sizes)), sizes)
    x = np.zeros((len(rows) + 2 * len(sizes) + 2, len(VIEWS) * DIM), np.float32)
    for t, values in enumerate(model.tables):
        x[at, t * DIM : (t + 1) * DIM] = values[rows[:, t]]
    out = []
    for width, f, b in zip(WIDTHS, model.filters, model.biases):
        r = x[at] @ f[0]
        for j in range(1, width):
            r += x[at + j] @ f[j]
        out.append(r + b)
    return x, out


def scores(model: Model, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A score for each document."""
    n = len(first) - 1
    pooled = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        _, responses = _responses(model, rows, first)
        best = np.concatenate([np.maximum.reduceat(r, first[some]) for r in responses], axis=1)
        pooled[some] = np.maximum(best, 0)
    return 1 / (1 + np.exp(-np.clip(pooled @ model.weight + model.bias, -30, 30)))


def start_tables(tables: list[np.ndarray], docs: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator, least: int = 3, prior: float = 3.0) -> list[np.ndarray]:
    """Fills embeddings of rows that `least` documents or more have: the first number is the smoothed log odds of the
    classes' document frequencies, the others are small random ones. Other rows stay zero; returns which are filled."""
    counts = np.zeros((len(tables), 2, ROWS))
    for d, y in zip(docs, labels):
        for t in range(len(tables)):
            counts[t, y][np.unique(d[:, t])] += 1
    return fill_tables(tables, counts, int(labels.sum()), len(labels), rng, least, prior)


def fill_tables(tables: list[np.ndarray], counts: np.ndarray, toxic: int, total: int, rng: np.random.Generator, least: int = 3, prior: float = 3.0) -> list[np.ndarray]:
    """start_tables() from document counts by view, class and row, of `total` texts."""
    known, toxic = [], max(1, toxic)
    for values, by_class in zip(tables, counts):
        filled = by_class.sum(axis=0) >= least
        odds = np.log((by_class[1] + prior) / (toxic + 2 * prior)) - np.log((by_class[0] + prior) / (total - toxic + 2 * prior))
        values[filled] = rng.normal(0, 0.1, (int(filled.sum()), DIM))
        values[filled, 0] = odds[filled] / 2
        known.append(filled)
    return known


def _blank(rng: np.random.Generator, rows: int = ROWS) -> Model:
    return Model([np.zeros((rows, DIM), np.float32) for _ in VIEWS], [rng.normal(0, 0.4, (w, len(VIEWS) * DIM, FILTERS)).astype(np.float32) for w in WIDTHS], [np.full(FILTERS, 0.01, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)


def _squares(model: Model) -> Model:
    """Where sums of squared gradients start."""
    return Model(*[[np.full(v.shape, 1e-2, np.float32) for v in values] for values in (model.tables, model.filters, model.biases)], np.full(model.weight.shape, 1e-2, np.float32), 1e-2)


def train(docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.07, seed: int = 7) -> Model:
    """A model fitted to documents given as embedding rows, by Adagrad on the logistic loss with balanced classes."""
    rng = np.random.default_rng(seed)
    model = _blank(rng)
    if not len(labels) or labels.min() == labels.max():
        share = labels.mean() if len(labels) else 0.0
        model.weight[:] = 0
        model.bias = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        return model
    known, seen = start_tables(model.tables, docs, labels, rng), _squares(model)
    for _ in range(epochs):
        _pass(model, seen, known, docs, labels, labels.mean(), rng, batch, rate)
    return model


def _pass(model: Model, seen: Model, known: list[np.ndarray], docs: list[np.ndarray], labels: np.ndarray, share: float, rng: np.random.Generator, batch: int = 32, rate: float = 0.07) -> None:
    """One pass over documents, in which model and seen change. share: of toxic ones among all, of which these are a part."""
    importance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))

    def step(value: np.ndarray, gradient: np.ndarray, squares: np.ndarray) -> None:
        squares += gradient**2
        value -= rate * gradient / np.sqrt(squares)

    order = rng.permutation(len(docs))
    for a in range(0, len(order), batch):
        pick = [i for i in order[a : a + batch] if len(docs[i])]
        if not pick:
            continue
        first = np.concatenate([[0], np.cumsum([len(docs[i]) for i in pick])])
        rows = np.concatenate([docs[i] for i in pick])
        g = gradients(model, rows, first, labels[pick], importance[pick])
        step(model.weight, g.weight + np.float32(1e-4) * model.weight, seen.weight)
        seen.bias += g.bias**2
        model.bias -= rate * g.bias / seen.bias**0.5
        for k in range(len(WIDTHS)):
            step(model.biases[k], g.biases[k], seen.biases[k])
            step(model.filters[k], g.filters[k], seen.filters[k])
        for t, (which, total) in enumerate(g.tables):
            total[~known[t][which]] = 0
            seen.tables[t][which] += total**2
            model.tables[t][which] -= rate * total / np.sqrt(seen.tables[t][which])


def _flat(*models: Model) -> np.ndarray:
    """All numbers of models in one array."""
    return np.concatenate([np.ravel(v) for m in models for v in (*m.tables, *m.filters, *m.biases, m.weight, np.array([m.bias]))]).astype(np.float32)


def _unflat(values: np.ndarray, model: Model, start: int = 0) -> Model:
    """The model of such numbers, shaped like another one."""

    def take(like: np.ndarray) -> np.ndarray:
        nonlocal start
        start += like.size
        return values[start - like.size : start].reshape(like.shape).copy()

    return Model([take(v) for v in model.tables], [take(v) for v in model.filters], [take(v) for v in model.biases], take(model.weight), float(take(np.zeros(1))[0]))


@dataclass
class Gradients:
    """Of the mean weighted logistic loss; tables: for each view the rows that have one, and theirs."""

    weight: np.ndarray
    bias: float
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    tables: list[tuple[np.ndarray, np.ndarray]]


def gradients(model: Model, rows: np.ndarray, first: np.ndarray, labels: np.ndarray, importance: np.ndarray) -> Gradients:
    """Gradients over a batch of documents that all have words: only the word of each largest response has any."""
    n = len(first) - 1
    pooled, peak = _peaks(model, rows, first)
    active = np.maximum(pooled, 0)
    guess = 1 / (1 + np.exp(-np.clip(active @ model.weight + model.bias, -30, 30)))
    off = ((guess - labels) * importance / n).astype(np.float32)
    back = off[:, None] * model.weight[None, :] * (pooled > 0)
    touched, values, filters, biases = [], [], [], []
    for k, (width, p) in enumerate(zip(WIDTHS, peak)):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        gradient = np.zeros_like(model.filters[k])
        for j in range(width):
            inside = (p + j < first[1:, None]) & (g != 0)
            x = np.concatenate([v[rows[np.minimum(p + j, len(rows) - 1), t]] for t, v in enumerate(model.tables)], axis=2)
            gradient[j] = np.einsum("dfe,df->ef", x, g * inside)
            touched.append((p + j)[inside])
            values.append((g[:, :, None] * model.filters[k][j].T[None])[inside])
        biases.append(g.sum(axis=0))
        filters.append(gradient)
    at, value = np.concatenate(touched), np.concatenate(values)
    tables = []
    for t in range(len(VIEWS)):
        which, inverse = np.unique(rows[at, t], return_inverse=True)
        total = np.zeros((len(which), DIM), np.float32)
        np.add.at(total, inverse, value[:, t * DIM : (t + 1) * DIM])
        tables.append((which, total))
    return Gradients(active.T @ off, float(off.sum()), filters, biases, tables)


def _peaks(model: Model, rows: np.ndarray, first: np.ndarray, most: int = 1 << 14) -> tuple[np.ndarray, list[np.ndarray]]:
    """The largest responses of documents that all have words, and for each width the words where they stand. Long texts
    go in windows, so that what is held at once does not grow with them."""
    pooled = np.full((len(first) - 1, len(WIDTHS) * FILTERS), -np.inf, np.float32)
    peak = [np.zeros((len(first) - 1, FILTERS), np.int64) for _ in WIDTHS]
    x = 0
    while x < len(first) - 1:
        y = max(x + 1, int(np.searchsorted(first, first[x] + most, "right")) - 1)
        for a in range(int(first[x]), int(first[y]), most):
            to = min(a + most + 2, int(first[y]))
            cuts = first[x : y + 1] - first[x] if first[y] - first[x] <= most else np.array([0, to - a])
            _, responses = _responses(model, rows[a:to], cuts)
            for d in range(x, y):
                low, high = max(int(first[d]) - a, 0), min(int(first[d + 1]) - a, most)
                for k, r in enumerate(responses):
                    at = r[low:high].argmax(axis=0)
                    best = np.take_along_axis(r[low:high], at[None], axis=0)[0]
                    mine = slice(k * FILTERS, (k + 1) * FILTERS)
                    better = best > pooled[d, mine]
                    peak[k][d][better] = (at + a + low)[better]
                    pooled[d, mine][better] = best[better]
        x = y
    return pooled, peak


def threshold(score: np.ndarray, label: np.ndarray, default: float = PREDICT, weight: np.ndarray | None = None) -> float:
    """The threshold of the best F0.5 (clean texts weigh more), in the middle between the scores beside it; default without both classes.
    weight: of how many texts each score is that of."""
    weight = np.ones(len(label), int) if weight is None else weight
    if weight.sum() < 20 or label.min() == label.max():
        return default
    order = np.argsort(-score)
    hits = np.cumsum((label * weight)[order])
    quality = 1.25 * hits / (np.cumsum(weight[order]) + 0.25 * (label * weight).sum())
    quality[:-1][score[order][:-1] == score[order][1:]] = 0
    k = int(np.argmax(quality))
    below = score[order][k + 1] if k + 1 < len(score) else 0.0
    return float(np.clip((score[order][k] + below) / 2, 0.5, 0.9))


def fold(key: Column, parts: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """A model from all labels (doc_id, toxic) that are usable (a condition on doc_id) and the texts of docs."""
    spark = docs.sparkSession
    mine = labels.where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    mine = mine.withColumn("train", F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) != 0)
    few = mine.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang).join(F.broadcast(mine) if few else mine.hint("merge"), "doc_id")
    classes = {(r.train, r.toxic) for r in texts.select("train", "toxic").distinct().collect()}
    if len({y for of_train, y in classes if of_train}) < 2 <= len({y for _, y in classes}):
        texts = texts.withColumn("train", F.lit(True))  # the fifth set aside has all rows of a class
    if len({y for _, y in classes}) < 2:
        model = train([], np.array([y for _, y in classes], int))
        model.thresholds = {"": float("inf")}
        return model
    training = texts.where("train").select("doc_id", "text", "toxic")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """view, row, toxic and how many texts have it; view -1: texts, -2: words."""
        counts, sizes = np.zeros((len(VIEWS), 2, ROWS), np.int64), np.zeros((2, 2), np.int64)
        for b in batches:
            for first, end, data, offsets in text_views(b.column(1), VIEW_BYTES):
                found, start = embedding_rows(data, offsets)
                for x, y, label in zip(start[:-1], start[1:], b.column(2).slice(first, end - first).to_pylist()):
                    sizes[:, label] += 1, y - x
                    for t in range(len(VIEWS)):
                        counts[t, label][np.unique(found[x:y, t])] += 1
        view, label, row = np.nonzero(counts)
        columns = [np.concatenate(c) for c in ((view, [-1, -1, -2, -2]), (row, [0] * 4), (label, [0, 1, 0, 1]), (counts[view, label, row], sizes.ravel()))]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int32, np.int32, np.int32, np.int64))], names=["view", "row", "toxic", "n"])

    of = written(training.mapInArrow(lean(counted), "view int, row int, toxic int, n long"), "counts").groupBy("view", "row", "toxic").agg(F.sum("n").alias("n")).toPandas()  # 6 * ROWS rows at most
    counts, inside = np.zeros((len(VIEWS), 2, ROWS)), of["view"].to_numpy() >= 0
    counts[tuple(of[c].to_numpy()[inside] for c in ("view", "toxic", "row"))] = of["n"].to_numpy()[inside]
    size = {(v, y): n for v, _, y, n in of[~inside].itertuples(index=False)}
    toxic, total = int(size[-1, 1]), int(size[-1, 0] + size[-1, 1])
    shards, share = max(1, -(-int(size[-2, 0] + size[-2, 1]) // SHARD_WORDS)), toxic / total
    rng = np.random.default_rng(7)
    whole = _blank(rng)
    known = fill_tables(whole.tables, counts, toxic, total, rng)
    # rows that are not known stay zero: tasks get the known ones, behind a zero row, and words as places among them
    names = [np.flatnonzero(k) for k in known]
    model = Model([np.concatenate([np.zeros((1, DIM), np.float32), v[n]]) for v, n in zip(whole.tables, names)], whole.filters, whole.biases, whole.weight, whole.bias)
    place = spark.sparkContext.broadcast([np.where(k, np.cumsum(k), 0).astype(np.int32) for k in known])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in text_views(b.column(1), VIEW_BYTES):
                found, start = embedding_rows(data, offsets)
                found = np.stack([p[found[:, t]] for t, p in enumerate(place.value)], axis=1)
                part = b.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([found[x:y].tobytes() for x, y in zip(start[:-1], start[1:])], pa.binary()), part.column(2)], names=["doc_id", "words", "toxic"])

    words = training.mapInArrow(lean(placed), "doc_id long, words binary, toxic int").withColumn("place", F.xxhash64("doc_id")).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int"))
    words = cut(words.repartition(shards, "shard").sortWithinPartitions("shard", "place", "doc_id", "words").select("shard", "words", "toxic"))
    squares = _squares(model)
    for epoch in range(EPOCHS):
        values = _averaged(words, spark.sparkContext.broadcast((model, squares)), share, epoch)
        model, squares = _unflat(values, model), _unflat(values, squares, len(values) // 2)
    for v, n, small in zip(whole.tables, names, model.tables):
        v[n] = small[1:]
    whole.filters, whole.biases, whole.weight, whole.bias = model.filters, model.biases, model.weight, model.bias
    sent = spark.sparkContext.broadcast(whole)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in text_views(b.column(0), VIEW_BYTES):
                part = b.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([pa.array(_scored(sent.value, *embedding_rows(data, offsets))), part.column(1), part.column(2)], names=["score", "lang", "toxic"])

    step = F.floor(F.col("score") * SCORE_STEPS)
    kept = texts.where("not train").select("text", "lang", "toxic").mapInArrow(lean(scored), "score double, lang string, toxic int").groupBy(step.alias("step"), "lang", "toxic").agg(F.count(F.lit(1)).alias("n"))
    kept = written(kept, "kept").orderBy("step", "lang", "toxic").toPandas()  # SCORE_STEPS rows of a language and class at most
    score, label, lang, n = (kept["step"].to_numpy(float) + 0.5) / SCORE_STEPS, kept["toxic"].to_numpy(int), kept["lang"].fillna("").to_numpy(object), kept["n"].to_numpy(int)
    if len(label):
        overall = threshold(score, label, weight=n)
        whole.thresholds = {"": overall} | {k: threshold(score[lang == k], label[lang == k], overall, n[lang == k]) for k in sorted(set(lang)) if k}
    return whole


def _averaged(words: DataFrame, sent: "pa.Broadcast", share: float, epoch: int) -> np.ndarray:
    """All numbers of the models and sums of squares that the shards' passes make of those sent, averaged by texts."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, labels = None, [], []

        def sent_back() -> Iterator[pa.RecordBatch]:
            model, squares = (_unflat(_flat(m), m) for m in sent.value)  # copies
            known = [np.arange(len(t)) > 0 for t in model.tables]
            _pass(model, squares, known, docs, np.array(labels, int), share, np.random.default_rng([7, epoch, now]))
            values = _flat(model, squares)
            for k, a in enumerate(range(0, len(values), CHUNK)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([now], pa.int32()), pa.array([len(labels)], pa.int64()), pa.array([values[a : a + CHUNK].tobytes()], pa.binary())], names=["chunk", "shard", "n", "numbers"])

        for b in batches:
            for shard, of, label in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                if shard != now and docs:
                    yield from sent_back()
                    docs.clear()
                    labels.clear()
                now = shard
                docs.append(np.frombuffer(of.as_buffer(), np.int32).reshape(-1, len(VIEWS)).copy())
                labels.append(label)
        if docs:
            yield from sent_back()

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, n = None, None, 0
        for b in batches:
            for chunk, m, numbers in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                values = np.frombuffer(numbers.as_buffer(), np.float32).astype(float) * m
                if chunk != now and n:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["chunk", "numbers"])
                now, total, n = (chunk, values, m) if chunk != now else (now, total + values, n + m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["chunk", "numbers"])

    made = words.mapInArrow(lean(passed), "chunk int, shard int, n long, numbers binary").repartition("chunk").sortWithinPartitions("chunk", "shard")
    means = written(made.mapInArrow(lean(mean), "chunk int, numbers binary"), "means").orderBy("chunk").collect()  # a model's size
    return np.concatenate([np.frombuffer(r.numbers, np.float32) for r in means])


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs (with doc_id, text) with score, predicted, and rejected: a score of the language's threshold or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in text_views(b.column(1), VIEW_BYTES):
                part = b.slice(first, end - first)
                score, limit = _rejects(sent.value, part, data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= PREDICT).astype(np.int32)), pa.array(limit), pa.array(score >= limit)], names=["doc_id", "score", "predicted", "threshold", "rejected"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang).mapInArrow(lean(rows), "doc_id long, score double, predicted int, threshold double, rejected boolean")


def _rejects(model: Model, part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of a part's texts and the thresholds of their languages."""
    score = _scored(model, *embedding_rows(data, offsets))
    langs = part.column("lang").to_pylist() if "lang" in part.schema.names else [""] * part.num_rows
    default = model.thresholds.get("", PREDICT)
    return score, np.array([model.thresholds.get(str(k or ""), default) for k in langs])


def _scored(model: Model, found: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Scores of documents given as embedding rows and where each one's begin."""
    score = np.zeros(len(start) - 1)
    for x, y, span in _runs(start):
        score[x:y] = span(model, found)
    return score


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in text_views(b.column(b.schema.get_field_index("text")), VIEW_BYTES):
                part = b.slice(first, end - first)
                score, limit = _rejects(sent.value, part, data, offsets)
                yield part.filter(pa.array(score < limit))

    return docs.mapInArrow(lean(rows), docs.schema)


def _runs(start: np.ndarray, most: int = 1 << 14):
    """Documents x to y and a function that scores them. A longer text goes in overlapping windows: the largest
    responses of a text are the largest of its windows', so its pooling is taken over all of them."""

    def plain(x: int, y: int):
        return lambda model, found: scores(model, found[start[x] : start[y]], start[x : y + 1] - start[x])

    def windowed(x: int):
        def span(model: Model, found: np.ndarray) -> np.ndarray:
            best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
            for a in range(int(start[x]), int(start[x + 1]), most):
                to = min(a + most + 2, int(start[x + 1]))
                _, r = _responses(model, found[a:to], np.array([0, to - a]))
                cut = to - a if to == start[x + 1] else most  # windows but the last end before their padding counts
                best = np.maximum(best, np.concatenate([k[:cut].max(axis=0) for k in r]))
            return 1 / (1 + np.exp(-np.clip(np.maximum(best, 0) @ model.weight + model.bias, -30, 30)))

        return span

    x, n = 0, len(start) - 1
    while x < n:
        if start[x + 1] - start[x] > most:
            yield x, x + 1, windowed(x)
            x += 1
            continue
        y = x + 1
        while y < n and start[y + 1] - start[x] <= most:
            y += 1
        yield x, y, plain(x, y)
        x = y


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labelled rows that are not held out, beside the threshold of the
    language and whether it rejects the text. Null and empty texts have a score like any other."""
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "threshold", "rejected")
