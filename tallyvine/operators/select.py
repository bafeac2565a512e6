"""Selection: gates, membership joins, first and best rows per key, grids, dynamic filters, oversampling."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grade import num_eq
from ..functions.text import estimated_tokens, extract_answer, first_non_empty, has_text, strip

#: Rows and bytes of a table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_IDS, BROADCAST_BYTES = 1_000_000, 64 << 20


def is_small(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Whether df has at most so many rows, which hold at most so many bytes as text."""
    rows, size = BROADCAST_IDS if rows is None else rows, BROADCAST_BYTES if size is None else size
    if df.limit(rows + 1).count() > rows:
        return False
    held = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    return (df.agg(F.sum(held)).first()[0] or 0) <= size


def small(df: DataFrame, rows: int | None = None, size: int | None = None) -> DataFrame:
    """df marked for a broadcast if its rows and bytes prove it small, for a merge join otherwise."""
    return F.broadcast(df) if is_small(df, rows, size) else df.hint("merge")


def without_errors(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("error", F.lit("")) == "")


def members(df: DataFrame, ids: DataFrame, keys: str | list[str]) -> DataFrame:
    """Rows whose key is among ids."""
    return df.join(small(ids), keys, "left_semi")


def others(df: DataFrame, ids: DataFrame, keys: str | list[str]) -> DataFrame:
    """Rows whose key is not among ids."""
    return df.join(small(ids), keys, "left_anti")


def grid(problems: DataFrame, generations: int, done: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Every problem with gen 0 to generations - 1, without the pairs of done that did not fail."""
    rows = problems.withColumn("gen", F.explode(F.sequence(F.lit(0), F.lit(generations - 1))))
    if done is None:
        return rows
    if "error" in done.columns:
        done = without_errors(done)
    return rows.join(done.select(key, F.col("gen").cast("int").alias("gen")).distinct(), [key, "gen"], "left_anti")


def enrich(df: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    """df with a column filled from a lookup where it is null or empty. The lookup is broadcast only if its texts are
    few bytes; columns of df keep their names, whatever they are."""
    found = "_found"
    while found in df.columns:
        found += "_"
    other = lookup.groupBy(key).agg(F.min(column).alias(found))
    return df.join(small(other), key, "left").withColumn(column, F.coalesce(F.nullif(column, F.lit("")), found)).drop(found)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle too."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows by an ordinal: rows of files have none of their own, so it must be a column."""
    return df.orderBy(*order).limit(n)


def with_status(df: DataFrame, *statuses: str, column: str = "status") -> DataFrame:
    """Rows of one of the statuses; rows without status are of none."""
    return df.where(F.col(column).isin(*statuses))


def matching(df: DataFrame, category: str | None = None, model: str | None = None, correct: bool | None = None, with_text: bool | None = None) -> DataFrame:
    """The conjunction of the given conditions; category and model are patterns, letter case aside."""
    found = []
    if category is not None:
        found.append(F.col("category").rlike(f"(?i){category}"))
    if model is not None:
        found.append(F.col("model").rlike(f"(?i){model}"))
    if correct is not None:
        found.append(F.coalesce("correct", F.lit(False)) == correct)
    if with_text is not None:
        found.append(has_text(F.col("text")) == with_text)
    return df.where(functools.reduce(Column.__and__, found, F.lit(True)))


def oversample(df: DataFrame, times: int) -> DataFrame:
    """Each row `times` times, with its copy number."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def trace_text(df: DataFrame) -> DataFrame:
    """df with cot: the stripped first non-empty of text and answer_text; rows without any fall."""
    return df.withColumn("cot", strip(first_non_empty(F.col("text"), F.col("answer_text")))).where("cot <> ''")


def answered(cot: Column, truth: Column) -> Column:
    """Whether a trace's extracted answer, which is found once, equals the truth exactly."""
    return F.element_at(F.transform(F.array(extract_answer(cot)), lambda found: num_eq(found, truth)), 1)


def exact_answers(df: DataFrame, truth: str = "truth") -> DataFrame:
    """Rows whose trace's extracted answer equals the truth exactly."""
    return df.where(answered(F.col("cot"), F.col(truth)))


def within_budget(df: DataFrame, text: Column, most: int = 8000, tokens: Callable[[Column], Column] = estimated_tokens) -> DataFrame:
    """Rows whose formatted example takes at most so many tokens; corpus.curation_report() counts the others."""
    return df.where(tokens(text) <= most)


def within_recorded(df: DataFrame, most: int = 8192) -> DataFrame:
    """Rows whose recorded tokens are unknown or at most so many."""
    return df.where(F.coalesce("out_tokens", F.lit(0)) <= most)


def capture_row(df: DataFrame) -> DataFrame:
    """The columns kept of a graded generation: text only if correct, errors cut to 160 characters."""
    return df.withColumn("text", F.when(F.col("correct"), F.col("text"))).withColumn("error", F.left("error", F.lit(160)))
