"""The pipeline and its filters on empty and odd tables; packing under any partitioning; labels of one class."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyvine.llm import jaccard, language, packing, toxicity
from tallyvine.sources.scratch import BATCH_BYTES, BATCH_ROWS

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _doc string, _TH string, score string, n_tokens int"


def saved(spark, path, rows, labels):
    docs = spark.createDataFrame([(i, t, lang, None, None, "d", "t", "s", 1) for i, t, lang in rows], DOCS)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_empty_tables(spark, tmp_path):
    where = saved(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, where).count() == 0
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, where).columns == docs.columns, name


def test_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, an id with several texts, a very long text and columns whose names the stages use."""
    plain = [(k, f"plain words about matter number {k} and the things that follow from it in time {k * 7}", "en") for k in range(30)]
    long = " ".join(f"word{k % 977} plain" for k in range(30_000))
    odd = [(None, None, None), (None, "plain words without any id at all here", "en"), (40, "", "en"), (41, long, None), (5, "another text that has the id of a plain one", "en"), (42, "12345 67890", "en")]
    where = saved(spark, tmp_path, plain + plain[:4] + odd, [(k, 1, 0) for k in range(20)] + [(None, None, None), (41, 1, None)])
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, where)
        assert kept.columns == docs.columns, name
    packed = corpus_pipeline.run(spark, where).collect()
    ids = sorted((r.doc_id for r in packed), key=str)
    # without a letter nothing is known of a language; repeated rows are copies; all else stays
    assert ids == sorted([*range(30), 5, 41, None], key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == ids


@pytest.mark.parametrize("labels", [[(1, 0), (7, 1)], [(k, 1) for k in range(11)], [(k, 0) for k in range(11)], [(1, 1), (7, 0)]])
def test_few_labels_reject_nothing_clean(spark, labels):
    """One class alone rejects nothing, whichever fold its rows fall in."""
    docs = spark.createDataFrame([(k, f"an ordinary text on subject {k} with some more words", "en") for k in range(11)], "doc_id long, text string, lang string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).collect()}
    toxic = {k for k, y in labels if y}
    assert kept >= set(range(11)) - toxic if len({y for _, y in labels}) > 1 else kept == set(range(11))


def test_packing_is_a_function_of_the_rows(spark):
    df = spark.range(60_000).select((F.col("id") % 40_000).alias("bucket"), (F.xxhash64(F.col("id") % 40_000) % 900 + 900).alias("n"))
    df = df.union(spark.range(30_000).select(F.lit(None).cast("long"), F.lit(77)))  # a key of a third of all rows
    one, two = (packing.pack(df.repartition(p), "bucket", F.col("n"), buckets=4, budget=9000) for p in (2, 5))
    names = one.columns
    assert len(names) == 7
    first, second = (sorted(map(repr, x.collect())) for x in (one, two))
    assert first == second and len(first) == 90_000


def test_near_duplicates_with_clashing_columns(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, text, "a", "b", 0), (2, text, "c", "d", 0), (3, "something else that is long enough to stay", "e", "f", 0)], "doc_id long, text string, _doc string, _Th string, _doc_ int")
    kept = jaccard.without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(tuple(r)[:3] for r in kept.collect()) == [(1, text, "a"), (3, "something else that is long enough to stay", "e")]


def test_stages_keep_batches_small(spark, tmp_path):
    """What a stage returns is run by its caller: batches of whole texts are small there too, and run() leaves no trace."""
    names = [f"spark.sql.execution.arrow.max{kind}PerBatch" for kind in ("Records", "Bytes")]
    before = [spark.conf.get(n) for n in names]
    where = saved(spark, tmp_path, [(k, f"plain words about matter number {k}", "en") for k in range(9)], [(1, 0, 0), (2, 0, 1)])
    docs = spark.read.parquet(f"{where}/documents.parquet")
    try:
        for name, stage in corpus_pipeline.STAGES:
            for n, value in zip(names, ("10000", str(1 << 26))):
                spark.conf.set(n, value)
            docs = stage(spark, docs, where)
            assert [int(spark.conf.get(n)) for n in names] == [BATCH_ROWS, BATCH_BYTES], name
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)
    corpus_pipeline.run(spark, where)
    assert [spark.conf.get(n) for n in names] == before


def test_language_takes_texts_in_small_pieces():
    """However many texts there are, few code points are held at once, and packing changes no prediction."""
    texts = [f"some plain words of text {k} " * 100 for k in range(400)] + ["ein anderer Text " * 20_000]
    assert max(len(points) for (points, _), _ in language._pieces(texts)) <= max(1 << 18, len(texts[-1])) + 3
    words = np.sort(language._hash_of(["some", "text", "text "]))
    model = language.Model(["de", "en"], (words[:1], np.log(np.array([[0.1, 0.9]]))), {k: (words[1:], np.log(np.array([[0.3, 0.2], [0.2, 0.4]]))) for k in range(1, 6)})
    langs, scores, basis = language.predict(model, texts)
    alone = [language.predict(model, [t]) for t in texts[::40]]
    assert [(x[0], y[0], z[0]) for x, y, z in alone] == list(zip(langs[::40], scores[::40], basis[::40]))
