"""Optimal length buckets: dynamic programming over the global length histogram, then token-budget batches.

A length is the number of byte tokens of the whole text (null: 0). The histogram has a cell per length below 2**11 and
2**10 cells per power of two above, so at most about 22,000 cells reach the driver for lengths up to 2**31; the
boundaries minimise the total padding exactly over the cells' largest lengths. Batches form inside a bucket: as many
rows as the token budget holds at the bucket's length, one at least, so a row above the budget is a batch of its own.
A bucket is dealt into shards of about SHARD_ROWS rows by a hash, so that no task holds a bucket; each shard's last
batch may be part full. Rows of equal id and length are counted first and dealt in blocks of BLOCK_ROWS of them, so the
batches are a function of the rows alone, however they are partitioned. Null and repeated ids are rows like any other;
an empty table gives no rows; columns beside the id and the length are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHARD_ROWS, BLOCK_ROWS = 20_000, 1024


def cell_of(n: Column) -> Column:
    """The histogram cell (its top) of a length."""
    step = F.greatest(F.lit(0), F.length(F.bin(n)) - 11)
    width = F.pow(F.lit(2.0), step).cast("long")
    return F.ceil(n / width).cast("long") * width


def boundaries(tops: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """Tops of at most `buckets` runs of cells whose total padding is least. tops ascend; sums are of lengths.

    The padding of a run obeys the quadrangle inequality, so the best last cut moves one way: divide and conquer.
    """
    n = len(tops)
    if not n:
        return []
    rows, held = np.concatenate([[0], np.cumsum(counts)]).astype(float), np.concatenate([[0], np.cumsum(sums)]).astype(float)
    best = np.concatenate([[0.0], np.full(n, np.inf)])
    cuts = []
    for _ in range(min(buckets, n)):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        now[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            at = np.arange(first, min(last, mid - 1) + 1)
            cost = best[at] + tops[mid - 1] * (rows[mid] - rows[at]) - (held[mid] - held[at])
            k = int(np.argmin(cost))
            now[mid], cut[mid] = cost[k], at[k]
            todo += [(low, mid - 1, first, int(at[k])), (mid + 1, high, int(at[k]), last)]
        best = now
        cuts.append(cut)
    found, at = [], n
    for cut in reversed(cuts):
        if at == 0:
            break
        found.append(int(tops[at - 1]))
        at = int(cut[at])
    return sorted(set(found))


def pack(df: DataFrame, id_col: str, length: Column, buckets: int = 16, budget: int = 1 << 18) -> DataFrame:
    """id, n_tokens, bucket, bucket_len, padding, batch (bucket-shard-number), slot of each row of df."""
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("n_tokens"))
    cells = rows.groupBy(cell_of(F.col("n_tokens")).alias("cell")).agg(F.max("n_tokens").alias("top"), F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("held")).orderBy("cell").collect()
    tops, counts, held = (np.array([c[k] for c in cells], dtype=np.int64) for k in ("top", "rows", "held"))
    ends = boundaries(tops, counts, held, buckets) or [0]
    of = np.searchsorted(ends, tops)
    shards = [max(1, -(-int(counts[of == b].sum()) // SHARD_ROWS)) for b in range(len(ends))]
    caps = [max(1, budget // max(1, e)) for e in ends]
    pick = lambda values, b: F.element_at(F.array(*[F.lit(int(v)) for v in values]), b + 1)
    keys = rows.groupBy("_id", "n_tokens").agg(F.count(F.lit(1)).alias("copies"))
    keys = keys.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(copies - 1) div " + str(BLOCK_ROWS))))).withColumn("copies", F.least(F.lit(BLOCK_ROWS), F.col("copies") - F.col("block") * BLOCK_ROWS))
    keys = keys.withColumn("bucket", sum((F.when(F.col("n_tokens") > e, 1).otherwise(0) for e in ends[:-1]), F.lit(0)))
    keys = keys.withColumn("bucket_len", pick(ends, F.col("bucket")).cast("long")).withColumn("shard", F.pmod(F.xxhash64("_id", "n_tokens", "block"), pick(shards, F.col("bucket"))))
    before = Window.partitionBy("bucket", "shard").orderBy("_id", "n_tokens", "block").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("from", F.coalesce(F.sum("copies").over(before), F.lit(0))).withColumn("cap", pick(caps, F.col("bucket")))
    rows = keys.withColumn("place", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("copies") - 1)))
    return rows.select(F.col("_id").alias(id_col), "n_tokens", "bucket", "bucket_len", (F.col("bucket_len") - F.col("n_tokens")).alias("padding"), F.concat_ws("-", "bucket", "shard", F.floor(F.col("place") / F.col("cap"))).alias("batch"), F.pmod("place", "cap").cast("int").alias("slot"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed by the byte tokens of their whole texts (null: 0)."""
    return pack(table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"))
