"""Aggregates: pass rates, upper medians, accuracies, votes, agreement, inflation and overlap reports."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def yield_table(traces: DataFrame, groups: list[str], problem: str = "id") -> DataFrame:
    """n_prob, n_gen, pass1, pass_any, tok_p50, calls and errors of each group of graded traces.

    A first aggregation per problem feeds the second, so no distinct expansion is needed. Errors count as calls only.
    """
    fine = F.coalesce("error", F.lit("")) == ""
    hit = F.coalesce("correct", F.lit(False))
    per = traces.groupBy(*groups, problem).agg(F.count_if(fine).alias("gens"), F.count_if(fine & hit).alias("hits"), F.count(F.lit(1)).alias("calls"))
    mid = traces.where(fine).groupBy(*groups).agg(median_sql("nullif(out_tokens, 0)").alias("tok_p50"))
    found = per.groupBy(*groups).agg(F.count_if(F.col("gens") > 0).alias("n_prob"), F.sum("gens").alias("n_gen"), (F.sum("hits") / F.sum("gens")).alias("pass1"), (F.count_if(F.col("hits") > 0) / F.count_if(F.col("gens") > 0)).alias("pass_any"), F.sum("calls").alias("calls"), (F.sum("calls") - F.sum("gens")).alias("errors"))
    same = functools.reduce(Column.__and__, [found[g].eqNullSafe(mid[g]) for g in groups], F.lit(True))  # null is a group too
    return found.join(mid, same, "left").select(*[found[c] for c in found.columns], F.coalesce(mid["tok_p50"], F.lit(0)).alias("tok_p50"))


def median_sql(expression: str) -> Column:
    """The upper median of a SQL expression as an aggregate; null without values.

    percentile_disc takes the lower middle of an even group: of the negated values that is the upper one. It merges
    value counts and so needs no list of a group's rows.
    """
    return F.expr(f"-(percentile_disc(0.5) within group (order by -({expression})))").cast("long")


def accuracy(scores: DataFrame, kind: str, correct: Column) -> DataFrame:
    """Accuracy per kind and overall (kind OVERALL)."""
    rows = scores.withColumn("_ok", F.coalesce(correct, F.lit(False)))
    return rows.rollup(kind).agg(F.count_if("_ok").alias("correct"), F.count(F.lit(1)).alias("total"), F.grouping(kind).cast("int").alias("_all")).select(F.when(F.col("_all") == 1, "OVERALL").otherwise(F.col(kind).cast("string")).alias(kind), "correct", "total", (F.col("correct") / F.col("total")).alias("accuracy"))


def outcomes(results: DataFrame, status: str = "status", outcome: str = "outcome") -> DataFrame:
    """Exclusive counts of outcomes by status; a missing status is `?`."""
    of = F.coalesce(F.nullif(status, F.lit("")), F.lit("?"))
    counts = [F.count_if(F.col(outcome) == x).alias(x) for x in ("ok", "wrong", "error", "timeout")]
    return results.groupBy(of.alias("status")).agg(F.count(F.lit(1)).alias("total"), *counts)


def summary(traces: DataFrame, groups: list[str], correct: Column, has_text: Column) -> DataFrame:
    """Totals, correct rows, correct rows with a trace, and the share in percent rounded half-even to a digit."""
    ok = F.coalesce(correct, F.lit(False))
    found = traces.groupBy(*groups).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("correct"), F.count_if(ok & has_text).alias("with_trace"))
    return found.withColumn("pct", F.bround(F.col("correct") * 100.0 / F.col("total"), 1))


def lengths(df: DataFrame, groups: list[str], size: str, cap: int) -> DataFrame:
    """Least, upper median, largest, mean, 90th percentile and the share above a cap of a size."""
    return df.groupBy(*groups).agg(F.min(size).alias("least"), median_sql(size).alias("median"), F.max(size).alias("most"), F.avg(size).alias("mean"), F.percentile(size, F.lit(0.9)).alias("p90"), (F.count_if(F.col(size) > cap) / F.count(F.lit(1))).alias("over"))


def majority(df: DataFrame, keys: list[str], answer: str, order: str) -> DataFrame:
    """The most frequent answer of each key, ties to the one that came first, and the only answer or null (abstain)."""
    counts = df.where(F.col(answer).isNotNull()).groupBy(*keys, answer).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(answer, F.struct("_n", -F.col("_first"))).alias("majority"), F.max("_n").alias("votes"), F.count(F.lit(1)).alias("answers"), F.when(F.count(F.lit(1)) == 1, F.min(answer)).alias("unanimous"))


def agreement(df: DataFrame, problem: str, source: str, answer: str) -> DataFrame:
    """Per problem: how many sources solved it and how many answers they gave."""
    return df.groupBy(problem).agg(F.count_distinct(source).alias("sources"), F.count_distinct(answer).alias("answers"))


def agreement_report(found: DataFrame, all_sources: int) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("solved"), F.count_if(F.col("sources") == all_sources).alias("by_all"), F.count_if(F.col("sources") == 1).alias("by_one"), F.count_if(F.col("sources") >= 2).alias("by_two"), F.count_if(F.col("answers") > 1).alias("conflicting"))


def complement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of two id sets, their differences, intersection and union."""
    one, two = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    both = one.join(two, key, "full")
    return both.agg(F.count("_a").alias("a"), F.count("_b").alias("b"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count(F.lit(1)).alias("either"))


def capped_histogram(df: DataFrame, value: str, cap: int = 3) -> DataFrame:
    return df.groupBy(F.least(F.col(value), F.lit(cap)).alias(value)).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def inflation(df: DataFrame, groups: list[str], stored: Column, exact: Column, tolerant: Column) -> DataFrame:
    """Stored labels against a new grading: how many hold exactly, how many only within the tolerance, how many not."""
    s, e, t = (F.coalesce(c, F.lit(False)) for c in (stored, exact, tolerant))
    found = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), F.count_if(s).alias("stored"), F.count_if(s & e).alias("exact"), F.count_if(s & t & ~e).alias("tolerance_only"), F.count_if(s & ~t).alias("wrong"), F.count_if(~s & e).alias("missed"))
    return found.withColumn("inflation_pct", F.bround((F.col("stored") - F.col("exact")) * 100.0 / F.nullif("stored", F.lit(0)), 1))


def candidate_fit(df: DataFrame, candidates: dict[str, Column], truth: Column) -> DataFrame:
    """For each candidate operation its matches and their share among rows where operands and truth are known."""
    total = F.count_if(truth.isNotNull())
    counts = df.agg(total.alias("parseable"), *[F.count_if(c == truth).alias(name) for name, c in candidates.items()])
    stacked = ", ".join(f"'{name}', `{name}`" for name in candidates)
    return counts.select("parseable", F.expr(f"stack({len(candidates)}, {stacked}) as (operation, matches)")).select("operation", "matches", "parseable", (F.col("matches") / F.col("parseable")).alias("share"))


def best_per_symbol(df: DataFrame, symbol: str, candidates: dict[str, Column], truth: Column) -> DataFrame:
    """The best operation of each symbol with knowledge of the answers: an upper bound of any rule by symbol."""
    counts = df.groupBy(symbol).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c == truth).alias(name) for name, c in candidates.items()])
    stacked = ", ".join(f"'{name}', `{name}`" for name in candidates)
    long = counts.select(symbol, "rows", F.expr(f"stack({len(candidates)}, {stacked}) as (operation, matches)"))
    return long.groupBy(symbol).agg(F.max("rows").alias("rows"), F.max("matches").alias("matches"), F.min_by("operation", F.struct(-F.col("matches"), "operation")).alias("operation"))


def least_logprob(df: DataFrame, logprobs: str, limit: float = -0.69) -> DataFrame:
    """df with its least token log probability and whether it falls below the limit."""
    low = F.array_min(logprobs)
    return df.withColumn("least_logprob", low).withColumn("doubtful", F.coalesce(low < limit, F.lit(False)))


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many values each column has."""
    return df.agg(*[F.count_distinct(c).alias(c) for c in columns])


def value_list(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column in order."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def best_rules(df: DataFrame, symbol: str, candidates: dict[str, Column], truth: Column) -> DataFrame:
    """One row: matches of the best operation of each symbol, summed; the best operation for all, and its matches."""
    per = best_per_symbol(df, symbol, candidates, truth).agg(F.sum("rows").alias("rows"), F.sum("matches").alias("by_symbol"))
    fixed = candidate_fit(df, candidates, truth).agg(F.max("matches").alias("fixed"), F.min_by("operation", F.struct(-F.col("matches"), "operation")).alias("operation"))
    return per.join(F.broadcast(fixed))
