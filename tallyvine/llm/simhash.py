"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at three or fewer differing bits.

A text's shingles are its runs of three words of `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased, repeats included,
joined by one space (fewer words: the whole sequence; none: no shingle). A bit of its fingerprint is 1 if more than
half of the shingles' XXH64 (seed 42) have it; a text without shingles has fingerprint zero and is linked like others.

Method: meet-in-the-middle ball hashing. Two fingerprints at distance d <= 3 meet in a word between them, one or two
bits from either; each fingerprint emits its variants, variants are shuffled, and fingerprints that share one are
verified. Of the ball of radius two only the variants that some pair needs are emitted:

* distance 1 and 3: the fingerprints differ in the parity of their bits. Those of the rarer parity emit themselves
  and pairs of flips, the others single flips. Of three differing bits two lie in one half of the word, so pairs of
  flips inside a half, 992 of 2,016, are enough (no fewer pairs touch every triple).
* distance 2: the parities are equal, and both fingerprints emit single flips.

So a fingerprint emits 1,057 or 64 variants. A variant's holders with at most one flip are linked with all its other
holders (1 + 2 <= 3), so one of them stands for all pairs: edges are linear in the holders, however many share a
variant, and holders that have two flips each are a pair only if another variant says so.

The nodes are distinct fingerprints, so copies, however many, are one node. Null texts have no words; a null doc_id
is no component's smallest unless there is no other; repeated rows are rows like any other; an empty table gives no
rows; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, table, text_views, with_match, written
from .jaccard import components
from .words import mix

SIZE, SEED, RADIUS = 3, 42, 3
#: Text that a task cuts at once, fingerprints whose variants it emits at once, variants that a bucket should hold.
VIEW_BYTES, EMIT_ROWS, BUCKET_KEYS = 1 << 19, 2048, 1 << 21

_ONE = np.uint64(1) << np.arange(64, dtype=np.uint64)
_LOW, _HIGH = np.triu_indices(32, 1)
#: Flips by code: none, single ones, pairs inside a half.
FLIPS = np.concatenate([[np.uint64(0)], _ONE, _ONE[_LOW] | _ONE[_HIGH], _ONE[_LOW + 32] | _ONE[_HIGH + 32]])
_SINGLE, _WIDE = np.arange(1, 65), np.arange(len(FLIPS))
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, size: int = SIZE) -> np.ndarray:
    """XXH64 of each shingle of a UTF-8 text, repeats included."""
    words = text.lower().split()  # both go by ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    width = min(size, len(words))
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist())], np.uint64)


def majority_bits(hashes: list[np.ndarray]) -> np.ndarray:
    """The word of bits that more than half of each array's words have (no words: zero)."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    if not sizes.sum():
        return np.zeros(len(hashes), np.uint64)
    octets = np.concatenate(hashes).astype("<u8").view(np.uint8).reshape(-1, 8)
    row = np.repeat(np.arange(len(hashes)) * 256, sizes)
    out = np.zeros(len(hashes), np.uint64)
    for k in range(8):
        counts = np.bincount(row + octets[:, k], minlength=len(hashes) * 256).reshape(-1, 256) @ _BYTE_BITS
        out |= ((2 * counts > sizes[:, None]).astype(np.uint64) << np.arange(8 * k, 8 * k + 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [np.zeros(0, np.uint64)]
        for _, _, data, offsets in text_views(b.column(1), VIEW_BYTES):
            found.append(majority_bits([shingle_hashes(data[x:y].tobytes()) for x, y in zip(offsets[:-1], offsets[1:])]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "fp"])


def with_simhash(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (long) and fp (the fingerprint as a signed long) of each row of df."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(_fingerprints), "doc_id long, fp long")


def _emit(wide_parity: int, buckets: int):
    """The variants of each fingerprint with the code of their flips, by bucket of the variant's hash."""

    def sent(fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        wide = np.bitwise_count(fp) % 2 == wide_parity
        keys = np.concatenate([(fp[wide][:, None] ^ FLIPS[_WIDE]).ravel(), (fp[~wide][:, None] ^ FLIPS[_SINGLE]).ravel()])
        codes = np.concatenate([np.tile(_WIDE, int(wide.sum())), np.tile(_SINGLE, int((~wide).sum()))]).astype(np.uint16)
        bucket = ((mix(keys) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, keys, codes = bucket[order], keys[order], codes[order]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
        stops = [*starts[1:].tolist(), len(bucket)]
        blobs = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(starts.tolist(), stops)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), blobs(keys), blobs(codes)], names=["bucket", "keys", "codes"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            count += b.num_rows
            if count >= EMIT_ROWS:
                fps = np.concatenate(held)
                for a in range(0, len(fps), EMIT_ROWS):
                    yield from sent(fps[a : a + EMIT_ROWS])
                held, count = [], 0
        if count:
            yield from sent(np.concatenate(held))

    return rows


def meeting(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) of fingerprints that share a variant: from its first holder of at most one flip to all others."""
    order = np.lexsort((codes, keys))
    keys, codes = keys[order], codes[order]
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
    start = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]  # of each holder's variant; codes of fewer flips come first
    other = (np.arange(len(keys)) != start) & (codes[start] <= 64)
    return keys[start[other]] ^ FLIPS[codes[start[other]]], keys[other] ^ FLIPS[codes[other]]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges among the fingerprints of the buckets that reach a task; a bucket's variants are nowhere else."""
    now, held = None, []

    def edges() -> Iterator[pa.RecordBatch]:
        keys, codes = (np.concatenate([np.frombuffer(x[k].as_buffer(), t) for x in held]) for k, t in ((0, np.uint64), (1, np.uint16)))
        a, b = meeting(keys, codes)
        for at in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)].view(np.int64)) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        for bucket, *blobs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if bucket != now and held:
                yield from edges()
                held = []
            now = bucket
            held.append(blobs)
    if held:
        yield from edges()


def near_fingerprints(fps: DataFrame) -> DataFrame:
    """Verified edges (a, b) among distinct fingerprints (fp): each fingerprint is connected with all at distance RADIUS
    or less; not every such pair is an edge of its own."""
    spark = fps.sparkSession
    parity = F.bit_count("fp") % 2
    odd, n = fps.agg(F.sum(parity), F.count(F.lit(1))).first()
    wide = 1 if (odd or 0) <= n - (odd or 0) else 0
    rare = min(odd or 0, n - (odd or 0))
    variants = rare * len(_WIDE) + (n - rare) * len(_SINGLE)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-variants // BUCKET_KEYS))
    sent = fps.repartition(max(parts, -(-n // (8 * EMIT_ROWS))), "fp").mapInArrow(lean(_emit(wide, buckets)), "bucket int, keys binary, codes binary")
    met = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_meet), "a long, b long").distinct()
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links) of each row of docs."""
    rows = written(with_simhash(docs, id_col, text_col), "simhash")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("_n")))
    links = written(near_fingerprints(nodes.select("fp")), "near")
    found = components(links).withColumnRenamed("node", "fp")
    placed = cut(nodes.join(found, "fp", "left").select("fp", "first", "_n", F.coalesce("component", "fp").alias("component")))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    groups = with_match(placed.select("fp", "component", F.col("_n").alias("rows")), "component", least, "inner").select("fp", "component_id", F.col("rows").alias("_n"))
    return with_match(rows, "fp", groups, "inner").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
