"""The corpus pipeline: documents without toxic texts, in a known language, without near copies and secrets, packed.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents. Models are fitted on the labelled rows among the stage's own input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvine.llm import jaccard, language, packing, secrets, token_counts, toxicity
from tallyvine.llm.common import mark, release, set_batches, small_batches, table, written

#: No SQL: the stages' models, segmentations and components are tested against brute force instead.
ORACLE_SQL = None
#: Tokens of a batch, padding included.
PACK_TOKENS = 1 << 16


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language; null and empty texts are kept."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True)))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language of the corpus; texts without a letter or any known part of a word go."""
    return language.with_language(docs, language.fit(docs, F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies; different texts of one doc_id are documents."""
    return jaccard.without_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secrets.without_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in token-budget batches of optimal length buckets; lengths are word-piece tokens."""
    counts = written(token_counts.token_counts(docs, token_counts.automaton(*token_counts.vocabulary())), "tokens")
    return packing.pack(counts, "doc_id", F.col("n_tokens"), budget=PACK_TOKENS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stage in a session that keeps small Arrow batches: the caller runs what a stage returns, and whole texts in
    batches of Spark's 10,000 rows stand in memory on both sides of each task."""

    def small(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        set_batches(spark)
        return stage(spark, docs, sf_dir)

    return small


STAGES = [(name, bounded(stage)) for name, stage in (("toxicity", drop_toxic), ("language", keep_languages), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("packing", pack))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in order over all documents, each written and read again. Each stage's intermediate tables, and the
    documents it read, are removed once its own are written; the session's own batches are set again at the end."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    with small_batches(spark):
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), name)
            release(spark, since, docs)
    return docs
