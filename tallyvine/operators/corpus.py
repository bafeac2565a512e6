"""Corpus building end to end: gates, ranking, synthetic traces, chat records and training order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chat, equation_query, estimated_tokens, first_non_empty, render_chat, strip, typographic, usable_cot
from ..sources.scratch import written
from .select import answered, exact_answers, others, oversample, top_per_group, trace_text, within_budget, without_errors
from .split import SEED, round_robin

BUDGET, KEEP = 8000, 4


def curate(traces: DataFrame, problems: DataFrame, held_out: DataFrame, ranks: dict[str, int], allowed: list[str] | None = None, keep: int = KEEP, budget: int = BUDGET, tokens: Callable[[Column], Column] = estimated_tokens, prefix: str = "bedrock_") -> DataFrame:
    """Curated records from traces (with source), at most `keep` per problem by source rank and length.

    Truth comes from the problem table. Gates run from cheap to dear: errors, membership, text, exact answer, tokens.
    allowed: sources that may be used (None: all that have a rank). prefix: what records of traces have before their
    source.
    """
    known = others(problems, held_out, "id").select("id", "prompt", F.col("answer").alias("truth"), F.col("category").alias("type"))
    rows = without_errors(traces).where(F.col("source").isin(list(ranks) if allowed is None else allowed))
    rows = exact_answers(trace_text(rows.select("id", "gen", "source", "text", "answer_text")).join(known, "id"))
    rows = within_budget(rows, render_chat(chat(F.col("prompt"), F.col("cot"), F.col("truth"))), budget, tokens)
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), F.col("source")), F.lit(len(ranks)))
    best = top_per_group(rows, ["id"], [rank, F.length("cot"), F.col("source"), F.col("gen")], keep)
    return best.select("id", "prompt", F.col("truth").alias("answer"), "type", F.col("cot").alias("generated_cot"), F.concat(F.lit(prefix), F.col("source")).alias("source"))


#: What becomes of a trace: the first gate that it does not pass, or `kept`.
GATES = ("error", "source_gate", "problem", "no_text", "wrong", "over_budget", "outranked", "kept")


def curation_report(traces: DataFrame, problems: DataFrame, held_out: DataFrame, ranks: dict[str, int], allowed: list[str] | None = None, keep: int = KEEP, budget: int = BUDGET, tokens: Callable[[Column], Column] = estimated_tokens) -> DataFrame:
    """source, traces and, for each of GATES, how many traces ended there: what curate() drops and why. A trace whose
    problem is held out or unknown ends at `problem`; null is a source of its own."""
    known = others(problems, held_out, "id").select("id", "prompt", F.col("answer").alias("truth"), F.lit(True).alias("known"))
    allowed_here = F.coalesce(F.col("source").isin(list(ranks) if allowed is None else allowed), F.lit(False))
    early = F.when(F.coalesce("error", F.lit("")) != "", "error").when(~allowed_here, "source_gate")
    rows = traces.select("id", "gen", "source", "text", "answer_text", early.alias("early"))
    # texts of traces that end early are neither stripped nor sent
    rows = rows.select("id", "gen", "source", "early", F.when(F.col("early").isNull(), strip(first_non_empty(F.col("text"), F.col("answer_text")))).alias("cot")).join(known, "id", "left")
    size = tokens(render_chat(chat(F.col("prompt"), F.col("cot"), F.col("truth"))))
    gate = F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("known").isNull(), "problem").when(F.coalesce("cot", F.lit("")) == "", "no_text").when(~answered(F.col("cot"), F.col("truth")), "wrong").when(F.coalesce(size > budget, F.lit(True)), "over_budget")
    slim = written(rows.select("id", "gen", "source", F.length("cot").alias("size"), gate.alias("gate")), "gates")  # it is read twice
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), F.col("source")), F.lit(len(ranks)))
    passed = slim.where("gate is null")
    best = top_per_group(passed, ["id"], [rank, F.col("size"), F.col("source"), F.col("gen")], keep).groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
    ended = slim.groupBy("source").agg(F.count(F.lit(1)).alias("traces"), F.count_if(F.col("gate").isNull()).alias("passed"), *[F.count_if(F.col("gate") == g).alias(g) for g in GATES[:-2]])
    kept = F.coalesce("kept", F.lit(0))
    return ended.join(best, "source", "left").select("source", "traces", *GATES[:-2], (F.col("passed") - kept).alias("outranked"), kept.alias("kept"))


def synthetic(problems: DataFrame) -> DataFrame:
    """Curated records of the problems whose question uses one of three operators with a known meaning and whose
    answer it gives exactly; the fallback rule is not taught."""
    q = equation_query(F.col("prompt"))
    rows = problems.withColumn("_q", q).where(F.col("_q.op").isin("-", "*", "/"))
    rows = rows.withColumn("_made", typographic(F.col("_q.a"), F.col("_q.op"), F.col("_q.b"))).where(F.col("_made") == F.trim("answer"))
    meaning = F.when(F.col("_q.op") == "-", "subtracts the second number from the first").when(F.col("_q.op") == "*", "writes the second number before the first").otherwise("multiplies both numbers")
    cot = F.concat(F.lit("No example shows the operator "), F.col("_q.op"), F.lit(", so its sign has to tell: it "), meaning, F.lit(". For "), F.col("_q.a"), F.lit(" and "), F.col("_q.b"), F.lit(" that gives "), F.col("_made"), F.lit("."))
    return rows.select("id", "prompt", F.col("_made").alias("answer"), F.col("category").alias("type"), cot.alias("generated_cot"), F.lit("solver_rule").alias("source"))


def chat_records(base: DataFrame, extra: DataFrame | None = None, times: int = 1) -> DataFrame:
    """id, type, messages: usable base rows, then extra rows (not filtered), each `times` times."""
    rows = base.where(usable_cot(F.col("generated_cot"))).withColumn("copy", F.lit(1))
    if extra is not None:
        rows = rows.unionByName(oversample(extra, times), allowMissingColumns=True)
    return rows.select("id", "copy", "type", chat(F.col("prompt"), F.col("generated_cot"), F.col("answer")).alias("messages"))


def training_order(records: DataFrame, batch_size: int = 32, seed: int = SEED) -> DataFrame:
    """Records with batch and place, each batch mixed over types."""
    keyed = records.withColumn("_key", F.concat_ws(":", "id", "copy", F.md5(render_chat(F.col("messages")).cast("binary"))))
    return round_robin(keyed, "_key", "type", batch_size, seed).drop("_key")


def over_length(records: DataFrame, limit: int = 7600, reserve: int = 96, tokens: Callable[[Column], Column] = estimated_tokens) -> DataFrame:
    """The work list of traces to be shortened: those above the limit, with the share to keep after a reserve for the
    answer."""
    n = tokens(F.col("generated_cot"))
    return records.withColumn("tokens", n).where(F.col("tokens") > limit).withColumn("keep_share", F.lit(float(limit - reserve)) / F.col("tokens"))
