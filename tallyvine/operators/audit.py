"""Audits of captures: flags of doubtful traces, degenerate answers, distances of wrong bits, contamination."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import hamming, lexicon_hit, normalise, verified_without_guess
from ..sources.scratch import written
from .select import is_small, small

STUB_CHARS, OVER_TOKENS = 300, 7680


def degenerate(answer: Column) -> Column:
    """An answer of zeros alone."""
    return F.coalesce(answer.rlike("^0+$"), F.lit(False))


def trace_flags(df: DataFrame, text: str, tokens: Column, stop: Column) -> DataFrame:
    """df with is_stub, is_cut, is_over, has_guess, is_verified."""
    c = F.col(text)
    flags = {"is_stub": F.coalesce(F.length(c), F.lit(0)) < STUB_CHARS, "is_cut": F.coalesce(stop == "max_tokens", F.lit(False)), "is_over": F.coalesce(tokens > OVER_TOKENS, F.lit(False)), "has_guess": lexicon_hit(c), "is_verified": verified_without_guess(c)}
    return df.withColumns(flags)


def flag_report(flagged: DataFrame, groups: list[str]) -> DataFrame:
    names = ("is_stub", "is_cut", "is_over", "has_guess", "is_verified")
    return flagged.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(n).alias(n) for n in names])


def distance_histogram(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """How many words of eight bits differ in how many places."""
    return df.groupBy(hamming(a, b).alias("distance")).agg(F.count(F.lit(1)).alias("rows"))


#: Pairs and short items that may be broadcast.
FEW = 100_000


def _grams(text: Column, size: Column) -> Column:
    """All runs of `size` characters of a column that holds them as an array."""
    return F.transform(F.sequence(F.lit(0), F.size(text) - size), lambda i: F.array_join(F.slice(text, i + 1, size), ""))


def _sought(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item key) of texts (key, text) that contain an item (item key, text): all items are one automaton of checked
    size, which each task builds and runs over its texts in time linear in their length."""
    named: dict[str, list] = {}
    for item, text in items.collect():
        named.setdefault(text, []).append(item)
    sent = texts.sparkSession.sparkContext.broadcast(named)
    fields = T.StructType([texts.schema[0], items.schema[0]])
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for text, keys in sent.value.items():
            machine.add_word(text, keys)
        machine.make_automaton()
        for b in batches:
            met = [(k, i) for k, (key, text) in enumerate(zip(*(c.to_pylist() for c in b.columns))) for i in {id(x): x for _, x in machine.iter(text)}.values()]
            at = [k for k, keys in met for _ in keys]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())).cast(kinds.field(0).type), pa.array([i for _, keys in met for i in keys], kinds.field(1).type)], schema=kinds)

    return texts.mapInArrow(rows, fields)


def contamination(docs: DataFrame, items: DataFrame, key: str, item_key: str, text: str = "text", size: int = 8) -> DataFrame:
    """(key, item_key) of texts that contain an item's whole text, both normalised; null and empty items are in none.

    An item of three words or more meets texts through a run of its inner words, up to `size` of them, by an equality
    join on its hash: its first and last word may be parts of others in the text. Words are hashed once and runs are
    made of those hashes; texts that meet an item are sought as a whole, without being moved as long as the pairs are
    small. Items of one or two words have no inner word: up to a size an automaton of all of them reads each text once,
    more meet texts by a run of up to `size` characters. What is broadcast has a checked number of rows and bytes.
    """
    held = items.where(F.col(text).isNotNull()).select(F.col(item_key), normalise(F.col(text)).alias("_item")).where("_item <> ''").withColumn("_iw", F.transform(F.split("_item", " "), lambda w: F.xxhash64(w)))
    inner = F.least(F.size("_iw") - 2, F.lit(size))
    whole = docs.where(F.col(text).isNotNull()).select(F.col(key), normalise(F.col(text)).alias("_doc"))
    sizes = [r[0] for r in held.where(inner >= 1).select(inner).distinct().collect()]  # at most `size` numbers
    found = whole.limit(0).select(key).join(held.limit(0).select(item_key))
    if sizes:
        words = whole.select(key, F.transform(F.split("_doc", " "), lambda w: F.xxhash64(w)).alias("_w"))
        at = lambda n: lambda i: F.xxhash64(*[F.get(F.col("_w"), i + j) for j in range(n)])
        runs = [F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(0), F.size("_w") - n), at(n))).otherwise(F.array().cast("array<bigint>")) for n in sizes]
        by_size = F.lit(None).cast("long")
        for n in sizes:
            by_size = F.when(inner == n, F.xxhash64(*[F.get(F.col("_iw"), F.lit(1 + j)) for j in range(n)])).otherwise(by_size)
        keyed = held.where(inner >= 1).select(item_key, by_size.alias("_run"))
        met = words.select(key, F.explode(F.array_distinct(F.concat(*runs))).alias("_run")).join(small(keyed, FEW), "_run").select(key, item_key).distinct()
        met = written(met, "met")
        pairs = met.join(small(held.select(item_key, "_item"), FEW), item_key)
        found = whole.join(small(pairs, FEW), key).where(F.contains("_doc", "_item")).select(key, item_key)
    short = held.where(inner < 1).select(item_key, "_item")
    if short.isEmpty():
        return found.distinct()
    if is_small(short, FEW // 10):
        return found.union(_sought(whole, short)).distinct()
    chars = short.withColumn("_n", F.least(F.length("_item"), F.lit(size))).withColumn("_run", F.left("_item", F.col("_n")))
    letters = whole.select(key, "_doc", F.split("_doc", "").alias("_c"))
    for n in [r[0] for r in chars.select("_n").distinct().collect()]:
        met = letters.where(F.size("_c") >= n).select(key, F.explode(F.array_distinct(_grams(F.col("_c"), F.lit(n)))).alias("_run")).join(chars.where(F.col("_n") == n).select("_run", item_key), "_run").select(key, item_key).distinct()
        found = found.union(whole.join(met.join(short, item_key), key).where(F.contains("_doc", "_item")).select(key, item_key))
    return found.distinct()
