"""Duplicates: exact, normalised, by fingerprints of prompts, likely copies by characters, greedy clusters."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise
from ..sources.scratch import written
from .select import small


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def copies(df: DataFrame, key: str, text: Column) -> DataFrame:
    """digest, rows and first key of each text that occurs more than once. Only digests are shuffled."""
    return df.select(key, digest(text).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first")).where("rows > 1")


def prompt_keys(prompt: Column, pairs: Column) -> dict[str, Column]:
    """Four keys by which prompts can overlap: exact, white space normalised, without any, set of example pairs."""
    return {"exact": digest(prompt), "normalised": digest(normalise(prompt)), "squeezed": digest(F.regexp_replace(prompt, r"\s+", "")), "pairs": digest(F.to_json(F.array_sort(F.array_distinct(pairs))))}


def overlap(a: DataFrame, b: DataFrame, keys: dict[str, tuple[Column, Column]]) -> DataFrame:
    """For each key how many rows of a have an equal one in b."""
    out = None
    for name, (of_a, of_b) in keys.items():
        hit = a.select(of_a.alias("k")).join(b.select(of_b.alias("k")).distinct(), "k", "left_semi").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("key"), "rows")
        out = hit if out is None else out.union(hit)
    return out


#: Counts of characters by code point modulo GROUPS bound a pair's likeness. Nodes of a band that stand in a chunk, of
#: which a task holds two; characters that it compares at once.
GROUPS, CHUNK, COMPARED = 16, 1 << 14, 1 << 18


def likely_copies(df: DataFrame, key: str, text: str, block: str, ratio: float) -> DataFrame:
    """All pairs of one block (null is a block too) whose character likeness is at least `ratio` (below 1).

    Texts with the same counts of all characters are one node, so exact copies are compared once. Nodes stand in length
    bands; two chunks of a band, or of neighbouring ones, meet in a cell with their counts and leave it as alike pairs,
    so what is shuffled are nodes, a few times each, and never candidates. In a cell, differences of the counts of
    GROUPS groups of characters sum to no more than those of single characters, so only pairs that cannot be alike fall
    before the exact counts are compared. Rows without a key or with a null text have no pairs; empty texts are all
    alike. The output is quadratic in rows that are alike.
    """
    kind = dict(df.dtypes)[key]
    named = F.coalesce(F.concat(F.lit("="), F.col(block).cast("string")), F.lit("null"))
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), named.alias("block"), F.col(text).alias("t"))
    rows = written(rows.mapInArrow(_histograms, f"k {kind}, block string, n long, h binary, counted binary"), "histograms")
    band = F.floor(F.log(F.greatest(F.first("n"), F.lit(1)).cast("double")) / F.lit(math.log((2 - ratio) / ratio) * (1 + 1e-9)))
    nodes = rows.groupBy("h").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("block").alias("block"), F.first("counted").alias("counted"), band.alias("band"))
    nodes = written(nodes, "nodes")
    sizes = nodes.groupBy("block", "band").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    beside = lambda name, by: sizes.select("block", (F.col("band") + by).alias("band"), F.col("chunks").alias(name))
    sizes = written(sizes.join(beside("above", -1), ["block", "band"], "left").join(beside("below", 1), ["block", "band"], "left").fillna(0, ["above", "below"]), "bands")
    placed = nodes.join(small(sizes), ["block", "band"]).withColumn("chunk", F.pmod(F.xxhash64("h"), F.col("chunks")).cast("int"))
    # a cell's halves are compared with each other; own: its first half with itself too
    cell = lambda at, way, x, y, half, own: F.struct(F.concat_ws(":", at, F.lit(way), x, y, "block").alias("cell"), half.alias("half"), own.alias("own"))
    counted = lambda n, f: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda j: j < n), f)
    chunk, no, yes = F.col("chunk"), F.lit(0), F.lit(1)
    cells = F.concat(
        F.filter(counted(F.col("chunks"), lambda j: cell(F.col("band"), "in", F.least(chunk, j), F.greatest(chunk, j), F.when(chunk > j, 1).otherwise(0), chunk == j)), lambda c: ~c["own"] | (F.col("above") == 0)),
        counted(F.col("above"), lambda j: cell(F.col("band"), "up", chunk, j, no, j == 0)),
        counted(F.col("below"), lambda j: cell(F.col("band") - 1, "up", j, chunk, yes, chunk == 0)),
    )
    placed = placed.select(F.explode(cells).alias("c"), "h", "k", "rows", "n", "counted").select("c.*", "h", "k", "rows", "n", "counted")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own, as small cells can be long work
    pairs = placed.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_alike(ratio), f"h binary, k {kind}, h2 binary, k2 {kind}, same boolean, ratio double")
    pairs = written(pairs, "alike")

    def all_rows(pairs: DataFrame, h: str, k: str) -> DataFrame:
        """Pairs with a row for each row of a node that has several."""
        several = pairs.where(F.col(h).isNotNull()).drop(k).join(rows.select(F.col("h").alias(h), F.col("k").alias(k)), h)
        return pairs.where(F.col(h).isNull()).unionByName(several)

    unlike = all_rows(all_rows(pairs, "h", "k"), "h2", "k2").where("k <> k2")
    swapped = F.col("same") & (F.col("k") > F.col("k2"))
    unlike = unlike.select(F.when(swapped, F.col("k2")).otherwise(F.col("k")).alias("a"), F.when(swapped, F.col("k")).otherwise(F.col("k2")).alias("b"), "ratio")
    left, right = rows.select("h", F.col("k").alias("a")), rows.select("h", F.col("k").alias("b"))
    return left.join(right, "h").where("a < b").select("a", "b", F.lit(1.0).alias("ratio")).union(unlike)


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: those of high bytes are zeros, which compress to nothing."""
    return values.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (k, block, t) as k, block, length, digest of block and counts, and the steps between code points and
    their counts as planes."""
    for batch in batches:
        for first in range(0, batch.num_rows, 1000):
            b = batch.slice(first, 1000)
            sizes, digests, counted = [], [], []
            for named, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                if points.max(initial=0) < 4096:
                    m = np.bincount(points)
                    c = np.flatnonzero(m)
                    m = m[c]
                else:
                    c, m = np.unique(points, return_counts=True)
                packed = _planes(np.concatenate([np.diff(c.astype(np.int64), prepend=0), m]))
                sizes.append(len(points))
                digests.append(hashlib.sha256(packed + named.encode("utf-8", "surrogatepass")).digest())
                counted.append(packed)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(counted, pa.binary())], names=["k", "block", "n", "h", "counted"])


def _alike(ratio: float):
    """The alike pairs of each cell, from rows sorted by it: cell, half, own, h, k, rows, n, counted. The shorter text's
    node comes first; h stands only where a node has several rows."""

    def compared(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        half, n = (t.column(c).to_numpy().astype(np.int64) for c in ("half", "n"))
        order = np.lexsort((n, half))
        half, n, t = half[order], n[order], t.take(pa.array(order)).combine_chunks()
        both = [np.frombuffer(x.as_buffer(), np.uint8).reshape(4, -1).T.copy().view(np.int32).reshape(2, -1) for x in t.column("counted").combine_chunks()]
        first = np.concatenate([[0], np.cumsum([x.shape[1] for x in both])])
        codes, counts = np.concatenate([np.cumsum(x[0]) for x in both]), np.concatenate([x[1] for x in both])
        row = np.repeat(np.arange(len(n)), np.diff(first))
        groups = np.bincount(row * GROUPS + codes % GROUPS, counts, len(n) * GROUPS).astype(np.int32).reshape(-1, GROUPS)
        alphabet, place = np.unique(codes, return_inverse=True)
        coarse = np.ascontiguousarray(groups.reshape(len(n), 4, -1).sum(axis=2).T.astype(np.int32))
        mine, split, own = np.zeros(len(alphabet), np.int32), int(np.searchsorted(half, 1)), t.column("own")[0].as_py()
        found, found2, likeness = [], [], []

        def sent() -> pa.RecordBatch:
            i, j, r = np.concatenate(found), np.concatenate(found2), np.concatenate(likeness)
            short, long = (pa.array(np.where(n[i] <= n[j], x, y)) for x, y in ((i, j), (j, i)))
            several = t.column("rows").to_numpy() > 1
            h, k = (t.column(c).combine_chunks() for c in ("h", "k"))
            named = lambda at: pc.if_else(pa.array(several[at.to_numpy()]), h.take(at), pa.scalar(None, h.type))
            return pa.RecordBatch.from_arrays([named(short), k.take(short), named(long), k.take(long), pa.array(n[i] == n[j]), pa.array(r)], names=["h", "k", "h2", "k2", "same", "ratio"])

        for i in range(split):
            least, most = n[i] * ratio / (2 - ratio) - 1, n[i] * (2 - ratio) / ratio + 1
            spans = [(split + int(np.searchsorted(n[split:], least)), split + int(np.searchsorted(n[split:], most, "right")))]
            if own:
                spans.append((i + 1, i + 1 + int(np.searchsorted(n[i + 1 : split], most, "right"))))
            for x, y in spans:
                if x >= y:
                    continue
                room = (n[x:y] + n[i]) * (1 - ratio) + 1e-6  # what alike texts may differ in
                apart = np.abs(coarse[0, x:y] - coarse[0, i])
                for c in coarse[1:]:
                    apart += np.abs(c[x:y] - c[i])
                j = np.flatnonzero(apart <= room)
                j = x + j[np.abs(groups[x + j] - groups[i]).sum(axis=1) <= room[j]]
                if not len(j):
                    continue
                here = slice(first[i], first[i + 1])
                mine[place[here]] = counts[here]
                lengths = first[j + 1] - first[j]
                part = np.cumsum(lengths) // COMPARED
                for some in np.split(np.arange(len(j)), np.flatnonzero(np.diff(part)) + 1):
                    starts = np.cumsum(lengths[some]) - lengths[some]
                    at = np.arange(int(lengths[some].sum())) + np.repeat(first[j[some]] - starts, lengths[some])
                    shared = np.add.reduceat(np.minimum(counts[at], mine[place[at]]), starts)
                    r = 2.0 * shared / (n[j[some]] + n[i])
                    good = r >= ratio
                    found.append(np.full(int(good.sum()), i))
                    found2.append(j[some][good])
                    likeness.append(r[good])
                mine[place[here]] = 0
            if sum(map(len, found)) > 20_000:
                yield sent()
                found, found2, likeness = [], [], []
        if found:
            yield sent()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            cells = b.column(0).to_pylist()
            edges = [0, *(i for i in range(1, len(cells)) if cells[i] != cells[i - 1]), len(cells)]
            for x, y in zip(edges[:-1], edges[1:]):
                if x == y:
                    continue
                if cells[x] != now and held:
                    yield from compared(held)
                    held = []
                now = cells[x]
                held.append(b.slice(x, y - x))
        if held:
            yield from compared(held)

    return rows


#: Rows of each group that a round decides in order, at first and at most; rows that one task holds against them.
FIRST_ROWS, MOST_ROWS, PART_ROWS = 256, 4096, 20_000
_STATE = "g string, o {0}, h long, id long, n int, codes array<int>, counts array<int>"


class _Representatives:
    """Counts of the characters of a group's representatives, in order."""

    def __init__(self) -> None:
        self.places: dict[int, int] = {}
        self.counts, self.sizes, self.names = np.zeros((4, 64), np.int32), [], []

    def first_alike(self, codes: np.ndarray, counts: np.ndarray, n: int, least: float) -> int | None:
        """The first representative that is at least so alike."""
        if not self.names:
            return None
        known = [(self.places[c], m) for c, m in zip(codes.tolist(), counts.tolist()) if c in self.places]
        at, mine = np.array([k for k, _ in known], int), np.array([m for _, m in known], np.int32)
        shared = np.minimum(self.counts[: len(self.names)][:, at], mine).sum(axis=1)
        both = np.array(self.sizes, float) + n
        alike = np.flatnonzero(np.where(both > 0, 2.0 * shared / np.maximum(both, 1), 1.0) >= least)
        return int(alike[0]) if len(alike) else None

    def add(self, name: object, codes: np.ndarray, counts: np.ndarray, n: int) -> None:
        at = np.array([self.places.setdefault(c, len(self.places)) for c in codes.tolist()], int)
        rows, columns = self.counts.shape
        self.counts = np.pad(self.counts, ((0, rows if len(self.names) == rows else 0), (0, max(0, len(self.places) - columns) and max(columns, len(self.places) - columns))))
        self.counts[len(self.names), at] = counts
        self.names.append(name)
        self.sizes.append(n)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (g, o, h, id, t) with the characters of t counted: n, codes, counts."""
    kind = pa.list_(pa.int32())
    for b in batches:
        made = [np.unique(np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32), return_counts=True) for t in b.column(4).to_pylist()]
        counts = [m.astype(np.int32) for _, m in made]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([int(m.sum()) for m in counts], pa.int32()), pa.array([c for c, _ in made], kind), pa.array(counts, kind)], names=["g", "o", "h", "id", "n", "codes", "counts"])


def greedy_clusters(df: DataFrame, group: str, order: str, text: str, least: float = 0.55) -> DataFrame:
    """group, order, representative (the order value of its cluster's first row), and whether it is one.

    In order, a row joins the first representative that is at least so alike, else becomes one; null is a group, a null
    text counts as empty, two empty texts are alike; rows of one order value go by a hash of their text.

    The representatives are the first independent set of the likeness graph in that order, and rounds build it: the next
    rows of each group (FIRST_ROWS, twice as many each round) are decided among themselves, as all earlier
    representatives have met them; then all later rows of the group, dealt into parts of PART_ROWS, meet the new
    representatives, and those that join one leave. So a group of any size is shared by many tasks, and one task holds
    MOST_ROWS rows in order or a part. Each round is a written table.
    """
    kinds = dict(df.dtypes)
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("null"))
    rows = df.select(key.alias("g"), F.col(order).alias("o"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("id"), F.col(text).alias("t"))
    state = _STATE.format(kinds[order])
    left = written(rows.mapInArrow(_counted, state), "clusters")
    place, result, size = F.struct("o", "h", "id"), f"g string, o {kinds[order]}, id long, r {kinds[order]}, first boolean", FIRST_ROWS

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, _Representatives()
        for frame in frames:
            out = []
            for g, o, i, n, codes, counts in zip(*(frame[c].tolist() for c in ("g", "o", "id", "n", "codes", "counts"))):
                if g != now:
                    now, held = g, _Representatives()
                k = held.first_alike(codes, counts, n, least)
                if k is None:
                    held.add(o, codes, counts, n)
                out.append((g, o, i, o if k is None else held.names[k], k is None))
            yield pd.DataFrame(out, columns=["g", "o", "id", "r", "first"]).astype({"o": frame["o"].dtype, "r": frame["o"].dtype}) if out else pd.DataFrame({c: frame[x].head(0) for c, x in (("g", "g"), ("o", "o"), ("id", "id"), ("r", "o"))}).assign(first=False)

    def meet(later: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        held = _Representatives()
        for o, n, codes, counts in zip(*(new.sort_values(["o", "h", "id"], na_position="first")[c].tolist() for c in ("o", "n", "codes", "counts"))):
            held.add(o, codes, counts, n)
        found = [held.first_alike(codes, counts, n, least) for n, codes, counts in zip(later["n"].tolist(), later["codes"], later["counts"])]
        return later[["g", "o", "id"]].assign(r=pd.Series([None if k is None else held.names[k] for k in found], index=later.index, dtype=object), first=[k is None for k in found])

    parts = []
    while True:
        block = left.withColumn("_k", F.row_number().over(Window.partitionBy("g").orderBy("o", "h", "id"))).where(F.col("_k") <= size).drop("_k")
        decided = written(block.repartition("g").sortWithinPartitions("g", "o", "h", "id").mapInPandas(decide, result), "decided")
        parts.append(decided)
        done = left.join(decided.select("g", "id"), ["g", "id"], "left_semi")
        edges = done.groupBy("g").agg(F.max(place).alias("edge"), F.count(F.lit(1)).alias("n_done")).where(F.col("n_done") == size)
        later = left.join(edges.select("g", "edge"), "g").where(place > F.col("edge")).drop("edge")
        sizes = written(later.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts")), "sizes")
        if sizes.isEmpty():
            break
        later = later.join(sizes, "g").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        new = written(left.join(decided.where("first").select("g", "id"), ["g", "id"], "left_semi"), "new").join(sizes, "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        met = written(later.groupBy("g", "part").cogroup(new.groupBy("g", "part")).applyInPandas(meet, result), "met")
        parts.append(met.where("not first"))
        left = written(left.join(met.where("first").select("g", "id"), ["g", "id"], "left_semi"), "clusters")
        size = min(MOST_ROWS, 2 * size)
    out = functools.reduce(DataFrame.union, parts)
    named = F.when(F.col("g") != "null", F.substring("g", 2, 2**31 - 1)).cast(kinds[group])
    return out.select(named.alias(group), F.col("o").alias(order), F.col("r").alias("representative"), F.col("first").alias("is_first"))


def diversity(clusters: DataFrame, group: str, cap: int = 3, status: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Representatives per group, and their histogram capped at `cap` or, with the groups' status (group, status), how
    many groups of each status have two or more."""
    per = clusters.groupBy(group).agg(F.count_if("is_first").alias("nrep"), F.count(F.lit(1)).alias("ngens"))
    if status is not None:
        return per, per.join(status, group).groupBy("status").agg(F.count(F.lit(1)).alias("problems"), F.count_if(F.col("nrep") >= 2).alias("diverse"))
    return per, per.groupBy(F.least("nrep", F.lit(cap)).alias("nrep")).agg(F.count(F.lit(1)).alias("problems"))
