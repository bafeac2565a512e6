"""Splits, samples and orders that depend on hashes of a seed and a key, so that they don't change with partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

SEED = 42
#: Rows that a broadcast may hold.
BROADCAST_IDS = 1_000_000


def draw(key: Column, seed: int = SEED) -> Column:
    """The key's place in a shuffle: a digest of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def quota(n: Column, share: str = "0.15", least: int = 15) -> Column:
    """Held-out rows of a stratum of n: the share rounded half-even, but at least `least` or half the stratum if that
    is smaller."""
    return F.least(F.greatest(F.least(F.lit(least), F.floor(n / 2)), F.bround(n * F.lit(share).cast("decimal(10, 4)"), 0)), n).cast("long")


def quotas(df: DataFrame, stratum: str) -> DataFrame:
    return df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).withColumn("held_out", quota(F.col("n")))


#: Hash ranges of a stratum; each is ranked by itself after the rows of those before it have been counted.
RANGES = 1 << 12


def ranked(df: DataFrame, key: str, stratum: str, seed: int = SEED, ahead: Column | None = None, most: Column | None = None) -> DataFrame:
    """df with `_rank` of each row in its stratum by draw order (rows with `ahead` first) and `_total` of the stratum; null is
    a stratum too. most: only rows up to this rank, a function of the stratum, are kept and sorted at all.

    Rows are counted by stratum and hash range; a row's rank is the count of the ranges before its own plus its place
    inside, so no task sees more than one range of a stratum. The counts are a written table, so df is computed twice:
    for them and for the ranks.
    """
    return _ranks(df, key, stratum, seed, ahead, most)[0]


def _ranks(df: DataFrame, key: str, stratum: str, seed: int = SEED, ahead: Column | None = None, most: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """ranked(), and the rows (_n) of each stratum (_stratum) and range (_of)."""
    rows = df.withColumn("_draw", draw(F.col(key), seed))
    place = F.conv(F.substring("_draw", 1, 3), 16, 10).cast("int")  # 12 bits: RANGES
    rows = rows.withColumn("_range", place if ahead is None else place + F.when(ahead, 0).otherwise(RANGES))
    counts = rows.groupBy(F.col(stratum).alias("_stratum"), F.col("_range").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    counts = written(counts, "ranges")
    whole = Window.partitionBy("_stratum")
    before = counts.select("_stratum", "_of", (F.sum("_n").over(whole.orderBy("_of")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_total"))
    few = before.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(before) if few else before.hint("merge"), F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_range") == F.col("_of")))
    if most is not None:
        rows = rows.where(F.col("_before") < most)
    rows = rows.withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy(stratum, "_range").orderBy("_draw", key)))
    if most is not None:
        rows = rows.where(F.col("_rank") <= most)
    return rows.drop("_draw", "_range", "_stratum", "_of", "_before"), counts


def stratified(df: DataFrame, key: str, stratum: str, seed: int = SEED) -> DataFrame:
    """df (a row per key) with split: heldout for the first quota of each stratum in draw order, else train."""
    rows = ranked(df, key, stratum, seed)
    return rows.withColumn("split", F.when(F.col("_rank") <= quota(F.col("_total")), "heldout").otherwise("train")).drop("_rank", "_total")


def split_faults(split: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Keys that stand in both splits, and keys of ids in none: no rows if the split is disjoint and covers."""
    both = split.groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1").select(key, F.lit("in both").alias("fault"))
    return both.union(ids.select(key).distinct().join(split, key, "left_anti").select(key, F.lit("in none").alias("fault")))


def _cap(stratum: str, caps: dict, default: int) -> Column:
    cap = F.lit(default)
    for value, n in caps.items():
        cap = F.when(F.col(stratum) == value, F.lit(n)).otherwise(cap)
    return cap


def capped_sample(df: DataFrame, key: str, stratum: str, caps: dict, default: int, seed: int = SEED) -> DataFrame:
    """At most a cap of rows per stratum, without replacement, in draw order."""
    return ranked(df, key, stratum, seed, most=_cap(stratum, caps, default)).drop("_rank", "_total")


def unsolved_first(df: DataFrame, key: str, stratum: str, unsolved: Column, caps: dict, default: int, seed: int = SEED) -> DataFrame:
    """A capped sample that takes unsolved rows of a stratum before the others."""
    return ranked(df, key, stratum, seed, F.coalesce(unsolved, F.lit(False)), _cap(stratum, caps, default)).drop("_rank", "_total")


def shuffled(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """df with its position in draw order, from 0."""
    rows = ranked(df.withColumn("_whole", F.lit(0)), key, "_whole", seed)
    return rows.withColumn("position", F.col("_rank") - 1).drop("_whole", "_rank", "_total")


def round_robin(df: DataFrame, key: str, stratum: str, batch_size: int, seed: int = SEED) -> DataFrame:
    """df with batch and place: each stratum's rows, in draw order, are dealt over all batches by a counter that runs
    on from stratum to stratum; batches themselves come in draw order.

    The counter is a rank inside each stratum plus the sizes of the strata before it, so no task sees all rows.
    """
    rows, counts = _ranks(df, key, stratum, seed)
    sizes = counts.groupBy("_stratum").agg(F.sum("_n").alias("n"))
    total = int(sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n)
    batches = max(1, -(-total // batch_size))
    before = sizes.select("_stratum", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_stratum")) - F.col("n")).alias("_before"))  # a row per stratum
    few = before.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(before) if few else before.hint("merge"), F.col(stratum).eqNullSafe(F.col("_stratum")))
    rows = rows.withColumn("place", F.col("_before") + F.col("_rank") - 1).withColumn("slot", F.pmod("place", F.lit(batches))).drop("_before", "_rank", "_total", "_stratum")
    slots = ranked(df.sparkSession.range(batches).select(F.col("id").alias("slot"), F.lit(0).alias("_all")), "slot", "_all", seed + 1)
    return rows.join(slots.select("slot", (F.col("_rank") - 1).alias("batch")), "slot").drop("slot")
