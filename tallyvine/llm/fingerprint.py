"""Bottom-k fingerprints of word shingles, with DataFrame functions only.

A document's shingles are the runs of five words of `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased (fewer words: the
whole sequence as one; none: none). Its fingerprint is the ascending array of the k smallest distinct 64-bit hashes of
them; the fingerprint of a union of parts is the k smallest of their fingerprints. With fewer than k shingles it is
the set itself and every estimate is exact. Null texts count as empty; two empty fingerprints are alike (1.0). Repeated
rows are rows like any other; of the caller's columns only one of the name asked for is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K = 256
SIZE = 5
_SPAN = 2.0**64


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_fingerprint(df: DataFrame, text_col: str, out: str, k: int = K, size: int = SIZE) -> DataFrame:
    """df with the array<bigint> fingerprint of a text column.

    Word hashes are a column of their own before the shingles, so that no lambda computes them again.
    """
    words = F.filter(F.split(ascii_lower(F.coalesce(text_col, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    held = "_words"
    while held in df.columns:
        held += "_"
    df = df.withColumn(held, F.transform(words, lambda w: F.xxhash64(w)))
    last = F.size(held) - size
    run = lambda i: F.xxhash64(*[F.get(F.col(held), i.cast("int") + j) for j in range(size)])
    shingles = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), run)).when(F.size(held) > 0, F.array(F.xxhash64(held))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop(held)


def merge(df: DataFrame, keys: list[str], sketch_col: str, out: str, k: int = K) -> DataFrame:
    """One fingerprint per group of df: the k smallest distinct hashes of its rows' fingerprints.

    Hashes are made distinct before and ranked with a limit on both sides of the shuffle, so a group of any size sends
    at most k hashes per task.
    """
    rows = df.select(*keys, F.explode(sketch_col).alias("_hash")).distinct()
    near = Window.partitionBy(*keys).orderBy("_hash")
    return rows.withColumn("_rank", F.row_number().over(near)).where(F.col("_rank") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(out))


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the share of hash space below the k-th."""
    share = (F.element_at(sketch, -1).cast("double") + F.lit(_SPAN / 2)) / F.lit(_SPAN)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's k smallest hashes that both fingerprints hold."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds (no shingles: 1)."""
    j = resemblance(a, b, k)
    common = j / (1 + j) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))


def encoded(sketch: Column) -> Column:
    """A fingerprint as text: base64 of the hashes' bytes."""
    return F.base64(F.unhex(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


#: Rows that a range of keys should hold, and the most ranges (their ends go through the driver, 32 bytes each).
RANGE_ROWS, MAX_RANGES = 500, 1 << 16


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df's id and text with a key (_d, _h) and `_range`, repartitioned by it, each range with the row that follows it.

    Keys are the id (null last) and the text's hash, in descending order. Ranges are quantiles of the keys, so neither
    ids far apart nor an id with many texts fill one. A copy of the row that follows a range's last one is sent to that
    range too (`_guest`), so a window inside a range sees the successor of each row; the last range gets the first row.
    """
    rows = df.select(id_col, text_col, F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_d"), F.xxhash64(text_col).alias("_h"))
    keys = rows.select("_d", "_h")
    ranges = max(1, min(MAX_RANGES, -(-keys.count() // RANGE_ROWS)))
    key = F.struct("_d", "_h")
    ends = keys.repartitionByRange(ranges, "_d", "_h").groupBy(F.spark_partition_id().alias("_p")).agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()
    ends.sort(key=lambda e: e.low)
    n = len(ends)
    low = [F.split(F.lit(",".join(str(e.low[k]) for e in ends)), ",").cast("array<bigint>") for k in range(2)]
    steps = [1 << k for k in range(max(0, n - 1).bit_length())][::-1]

    def further(at: Column, step: Column) -> Column:
        d, h = (F.get(x, at + step) for x in low)
        return F.when((d < F.col("_d")) | ((d == F.col("_d")) & (h <= F.col("_h"))), at + step).otherwise(at)

    of = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further) if steps else F.lit(0)  # by bisection
    heads = df.sparkSession.createDataFrame([(e.high[0], e.high[1], (k + 1) % n) for k, e in enumerate(ends)], "_d long, _h long, _range int")
    guests = rows.join(F.broadcast(heads), ["_d", "_h"]).dropDuplicates(["_range"])  # at most MAX_RANGES heads
    names = [id_col, text_col, "_d", "_h"]
    both = rows.select(*names, of.alias("_range"), F.lit(False).alias("_guest")).union(guests.select(*names, "_range", F.lit(True)))
    return both.repartition("_range")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edits with the next document's first half.

    The next document has the next smaller doc_id (ties: the next smaller hash of the text); rows without doc_id come
    last; after the last comes the first. A single document is its own next; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_fingerprint(with_next(docs, "doc_id", "text"), "text", "_own")
    order = Window.partitionBy("_range").orderBy("_guest", F.desc("_d"), F.desc("_h"))  # a guest comes last
    rows = rows.withColumn("_next", F.lead("text", 1, "").over(order)).withColumn("_next_own", F.lead("_own").over(order)).where(~F.col("_guest"))
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.col("_next"), F.lit(1), half)))
    rows = rows.select("doc_id", size.cast("long").alias("n_chars"), "edited", F.sha2("edited", 256).alias("edited_sha256"), "_own", F.coalesce("_next_own", F.array().cast("array<bigint>")).alias("_next_own"))
    rows = with_fingerprint(rows, "edited", "_edited").drop("edited")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", encoded(F.col("_own")).alias("fingerprint"), encoded(F.col("_edited")).alias("edited_fingerprint"),
        resemblance(F.col("_own"), F.col("_edited")).alias("near_edited"), resemblance(F.col("_own"), F.col("_next_own")).alias("near_next"),
        distinct_count(F.col("_own")).alias("n_shingles"), containment(F.col("_own"), F.col("_edited")).alias("kept_in_edited"),
    )
