"""N-gram Jaccard join: links and components of documents whose word-shingle sets reach a Jaccard of 0.75.

Method: universe partition and pigeonhole. Two sets of sizes x and y with Jaccard >= t differ in at most
h = (x + y)(1 - t)/(1 + t) elements. Sizes fall in bands whose ends grow by 1/t, so linked sets share a band or are
neighbours; a set is indexed in its own band and, where it can have smaller partners, in the band below. A band cuts
the hash universe into m narrow segments and, for sizes from 48 on, a wide one.

Narrow segments: a key is a segment's content. d <= h differences leave at least m - d of them equal, so a set may skip
m - 1 - h of them in an order that depends on contents alone: the first equal one in that order is kept by both.
Wide segment: its content and all its one-deletion neighbours are keys, so it is found if it differs in at most one
element; if it differs in more, at least m + 2 - d narrow segments are equal and two more may be skipped.

Cost-based allocation: a segment costs the smallest known document frequency of its elements (an empty one most), from
a bounded table of the most frequent shingles of the whole corpus, which steers cost and never the result; the most
costly segments are skipped. The wide one is skipped if fewer than three of its elements are rare, and the two more
narrow ones are kept if fewer than four are: two sets whose wide segments differ by one element differ by at most one
in that number, so either both have wide keys or neither has skipped too many.

The nodes of all this are distinct sets, so copies of one set, however many, are one node, and rows that share a
doc_id but not their text are several. Candidates are verified exactly on the sets. A component needs no more than one
path: a first round joins each key's members to its smallest member. After that only sets of one key in different
components can matter: their parity sketches bound the differences from below, and a second round takes the sets that
can still be linked with one of another component. They meet in blocks again, now as whole sets, and what leaves a task
are links that join two of its components, fewer than it has components. So pairs are never rows, and no link between
different components is lost.

Defined results: null, empty and blank texts have no shingles and no links; 1 to 4 words are one shingle. A document's
links are those of all rows with its doc_id, whatever their texts. Rows without doc_id link others like any row; their
component is the smallest doc_id reachable, null if there is none. Further columns are never read. Shingles and sets
are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, cut, lean, table, text_views, with_match, written
from .words import mix, shingle_sets

SIZE = 5
NUM, DEN = 3, 4  # the threshold as a fraction
#: Bits of a set's parity sketch: twice its size or more as a power of two, within these bounds.
SKETCH_BITS = (256, 1 << 16)
#: Members of a run that a task compares at once; larger runs are dealt out as pairs of such blocks.
BLOCK = 4096
#: Shingles of the sets that such a block has where whole sets are compared.
BLOCK_SHINGLES = 1 << 20
#: Text that a task cuts into shingles at once.
VIEW_BYTES = 1 << 18
#: The frequency table: at most so many shingles, each in at least so many documents.
FREQUENT, FREQUENT_LEAST = 1 << 16, 24
#: The bits of a key that are sent. Keys that differ in the others alone only add candidates.
KEY_BITS = np.uint64(2**64 - 2**16)
#: Shingles and keys held by one task before they are counted and sent, and keys of one bucket.
TASK_SHINGLES, TASK_KEYS, BUCKET_KEYS = 1 << 19, 1 << 18, 1 << 19


def bands(limit: int) -> np.ndarray:
    """Largest size of each band, until limit is covered."""
    ends = [1]
    while ends[-1] < limit:
        ends.append(max(ends[-1] + 1, ends[-1] * DEN // NUM))
    return np.array(ends, np.int64)


def most_different(x: int, y: int) -> int:
    """Largest symmetric difference of linked sets of sizes x and y."""
    return (x + y) * (DEN - NUM) // (DEN + NUM)


def segments(end: int) -> int:
    """Narrow segments of the band that ends so: over twice what h differences can touch, for room to skip costly ones."""
    return 2 * most_different(end, end * DEN // NUM) + 64


def band_keys(hashes: np.ndarray, cost: np.ndarray, band: int, end: int, h: int) -> np.ndarray:
    """Keys of a set in the index of a band. h: the most differences to a partner in that index."""
    if not h:  # only equal sets, which are found by their digest
        return np.zeros(0, np.uint64)
    m = segments(end)
    salt = mix(np.array([band + 1], np.uint64))[0]
    place = (mix(hashes ^ salt) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    wide_share = 10.0 / end if end >= 64 else 0.0  # about ten elements of the largest set
    wide = place < wide_share
    slot = np.minimum(((place - wide_share) / (1 - wide_share) * m).astype(np.int64), m - 1)
    mixed = mix(hashes + salt)
    rare = int((cost[wide] == 1).sum())
    keys = np.zeros(0, np.uint64)
    if rare >= 3:
        inside = mixed[wide]
        total = inside.sum(dtype=np.uint64)
        keys = mix(np.concatenate([[total], total - inside]) ^ salt)
    order = np.argsort(slot[~wide], kind="stable")
    slots, elements, costs = slot[~wide][order], mixed[~wide][order], cost[~wide][order]
    starts = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if len(slots) else np.zeros(0, np.int64)
    content = np.zeros(m, np.uint64)
    price = np.full(m, np.iinfo(np.int64).max)
    if len(starts):
        content[slots[starts]] = np.add.reduceat(elements, starts)
        price[slots[starts]] = np.minimum.reduceat(costs, starts)
    narrow = mix(content + mix(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt))
    keep = h - 1 if rare >= 4 else h + 1
    return np.concatenate([keys, narrow[np.lexsort((narrow, price))[:keep]]])


def keys_of(hashes: np.ndarray, cost: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All keys of a set: in its own band's index and, if it can have smaller partners there, in the one below."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    band = int(np.searchsorted(ends, n))
    out = [band_keys(hashes, cost, band, int(ends[band]), most_different(n, min(n * DEN // NUM, int(ends[band + 1]))))]
    least = -(-n * NUM // DEN)
    if band and least <= ends[band - 1]:
        out.append(band_keys(hashes, cost, band - 1, int(ends[band - 1]), most_different(n, int(ends[band - 1]))))
    return np.concatenate(out)


def parity_sketch(hashes: np.ndarray) -> bytes:
    """A bit for each of b slots: whether an odd number of elements falls there. The bits in which two sketches differ
    are no more than the elements in which the sets differ."""
    bits = min(max(1 << int(2 * len(hashes) - 1).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1]) if len(hashes) else SKETCH_BITS[0]
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the shortest: a fold is a sketch of fewer slots."""
    least = min(map(len, sketches))
    out = np.empty((len(sketches), least // 8), np.uint64)
    for k, x in enumerate(sketches):
        row = np.frombuffer(x, np.uint64)
        while len(row) * 8 > least:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[k] = row
    return out


_BASE = "kind int, doc_id long, th long, node long, n long, sketch binary"


def node_of(hashes: np.ndarray) -> int:
    """The name of a set that is not empty."""
    with np.errstate(over="ignore"):
        total = np.array([hashes.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(hashes + np.uint64(77))), np.uint64(len(hashes))], np.uint64)
        return int(mix(mix(mix(total[:1]) ^ total[1:2]) + total[2:])[0].view(np.int64))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a row's set, its size and sketch; kind 1: a shingle (as node) and how many sets of a run hold it."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])
    held, count = [], 0

    def frequent() -> pa.RecordBatch:
        shingles, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        some = counts >= 3
        k = int(some.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(shingles[some].view(np.int64)), pa.array(counts[some].astype(np.int64)), pa.nulls(k, pa.binary())], schema=schema)

    for b in batches:
        for first, end, data, offsets in text_views(b.column(1), VIEW_BYTES):
            sets = shingle_sets(data, offsets, SIZE)
            part = b.slice(first, end - first)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(end - first, np.int32)), part.column(0), part.column(2), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity_sketch(s) if len(s) else None for s in sets], pa.binary())], schema=schema)
            held += sets
            count += sum(map(len, sets))
            if count > TASK_SHINGLES:
                yield frequent()
                held, count = [], 0
    yield frequent()


def _planes(values: np.ndarray) -> bytes:
    """Differences of 64-bit values, byte plane by byte plane: most planes are zeros, which compress to nothing."""
    return np.diff(values, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel())


def _emit(frequent: "pa.Broadcast", ends: np.ndarray, buckets: int):
    """Keys of each set, by bucket and in their order, so that differences are small however many buckets there are; a
    run's copies of one set send theirs once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = (np.frombuffer(x, t) for x, t in zip(frequent.value, (np.uint64, np.int64)))
        held: list[tuple[int, np.ndarray]] = []
        seen: set[int] = set()
        count = 0

        def send() -> pa.RecordBatch:
            keys = np.concatenate([k for _, k in held]) & KEY_BITS
            docs = np.repeat(np.array([d for d, _ in held], np.int64), [len(k) for _, k in held])
            order = np.argsort(keys)
            keys, docs = keys[order], docs[order]
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            stops = np.concatenate([starts[1:], [len(keys)]])
            return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array([_planes(keys[a:b].view(np.int64)) for a, b in zip(starts, stops)], pa.binary()), pa.array([docs[a:b].tobytes() for a, b in zip(starts, stops)], pa.binary())], names=["bucket", "keys", "docs"])

        for b in batches:
            for _, _, data, offsets in text_views(b.column(0), VIEW_BYTES):
                for s in shingle_sets(data, offsets, SIZE):
                    if not len(s) or (node := node_of(s)) in seen:
                        continue
                    seen.add(node)
                    at = np.minimum(np.searchsorted(common, s), max(0, len(common) - 1))
                    cost = np.where(common[at] == s, counts[at], 1) if len(common) else np.ones(len(s), np.int64)
                    keys = keys_of(s, cost, ends)
                    if not len(keys):
                        continue
                    held.append((node, keys))
                    count += len(keys)
                    if count > TASK_KEYS:
                        yield send()
                        held, count = [], 0
                    if len(seen) > TASK_KEYS:
                        seen.clear()
        if held:
            yield send()

    return rows


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, node) of the keys that several sets hold, from rows sorted by bucket; one bucket is held at a time."""
    now, keys, docs = None, [], []
    for b in batches:
        for bucket, of_keys, of_docs in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            if bucket != now and keys:
                yield from _runs_of(keys, docs)
                keys, docs = [], []
            now = bucket
            keys.append(_unplaned(of_keys.as_buffer()).view(np.uint64))
            docs.append(np.frombuffer(of_docs.as_buffer(), np.int64))
    if keys:
        yield from _runs_of(keys, docs)


def _runs_of(keys: list[np.ndarray], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The runs of a bucket; keys with the same holders make one run."""
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    once = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])  # copies of a set come from many tasks
    key, doc = key[once], doc[once]
    several = np.concatenate([[False], key[1:] == key[:-1]])
    several[:-1] |= several[1:]
    key, doc = key[several], doc[several]
    if not len(key):
        return
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    holders = np.add.reduceat(mix(doc.view(np.uint64)), starts) + sizes.astype(np.uint64)
    _, one = np.unique(holders, return_index=True)
    kept = np.zeros(len(starts), bool)
    kept[one] = True
    take = np.repeat(kept, sizes)
    run, doc = np.repeat(holders, sizes)[take].view(np.int64), doc[take]
    for a in range(0, len(run), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(run[a : a + (1 << 18)]), pa.array(doc[a : a + (1 << 18)])], names=["run", "doc"])


def _able(n: np.ndarray, m: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m that differ in `apart` elements or more can be linked."""
    return (np.minimum(n, m) * DEN >= np.maximum(n, m) * NUM) & (apart <= (n + m) * (DEN - NUM) // (DEN + NUM))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and sketches leave a link possible."""
    for b in batches:
        if b.num_rows:
            n, m = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            apart = np.zeros(len(n), np.int64)
            for k, pair in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
                two = folded(list(pair))
                apart[k] = int(np.bitwise_count(two[0] ^ two[1]).sum())
            able = pa.array(_able(n, m, apart))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(able), b.column(1).filter(able)], names=["a", "b"])


def _by_cell(batches: Iterator[pa.RecordBatch], values: Callable[[pa.RecordBatch], list[list]]) -> Iterator[tuple[tuple[int, int], list[list]]]:
    """(run, cell) and the columns of its rows, for each cell of two rows or more, from rows sorted by run and cell, the
    first two columns. values: the further columns of a batch."""
    now, held = None, []
    for b in batches:
        columns = values(b)
        for at, *row in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), *columns):
            if at != now:
                if held and len(held[0]) > 1:
                    yield now, held
                now, held = at, [[] for _ in columns]
            for x, v in zip(held, row):
                x.append(v)
    if held and len(held[0]) > 1:
        yield now, held


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of each cell (a group, or a pair of blocks of a large one) that can be linked with one of another component.

    Rows come sorted by run and cell: run, cell, block, node, component, n, sketch. A cell has two blocks at most.
    """
    for (run, _), cell in _by_cell(batches, lambda b: [b.column(k).to_pylist() for k in range(2, 7)]):
        block, node, component, n = (np.array(x) for x in cell[:4])
        sketch = folded(cell[4])
        of = np.unique(component, return_inverse=True)[1]
        main = np.bincount(of).argmax()
        one = len(np.unique(block)) == 1
        can = np.zeros(len(node), bool)
        for i in np.flatnonzero(of != main):
            j = np.flatnonzero((of != of[i]) & ((of == main) | (node > node[i])) & (one | (block != block[i])) & (np.minimum(n, n[i]) * DEN >= np.maximum(n, n[i]) * NUM))
            if len(j):
                apart = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1).astype(np.int64)
                j = j[_able(n[j], n[i], apart)]
                can[j] = True
                can[i] |= len(j) > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(can.sum()), run, np.int64)), pa.array(node[can]), pa.array(component[can]), pa.array(n[can])], names=["run", "node", "component", "n"])


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join the components of each cell, one for each two joined.

    Rows come sorted by run and cell: run, cell, block, node, component, text. Cells are those of _open.
    """

    def values(b: pa.RecordBatch) -> list[list]:
        return [*(b.column(k).to_pylist() for k in range(2, 5)), [s for _, _, data, offsets in text_views(b.column(5), VIEW_BYTES) for s in shingle_sets(data, offsets, SIZE)]]

    for _, (block, node, component, sets) in _by_cell(batches, values):
        block, n = np.array(block), np.array([len(s) for s in sets], np.int64)
        sketch = folded([parity_sketch(s) for s in sets])
        of = np.unique(np.array(component), return_inverse=True)[1]
        one = len(np.unique(block)) == 1
        found = []
        for i, x in enumerate(sets):
            j = i + 1 + np.flatnonzero((of[i + 1 :] != of[i]) & (one | (block[i + 1 :] != block[i])))
            j = j[_able(n[j], n[i], np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1).astype(np.int64))]
            if not len(j):
                continue
            others = np.concatenate([sets[k] for k in j])
            same = x[np.minimum(np.searchsorted(x, others), len(x) - 1)] == others
            both = np.add.reduceat(same, np.cumsum(n[j]) - n[j], dtype=np.int64)
            for k in j[both * DEN >= (n[j] + n[i] - both) * NUM]:
                if of[k] != of[i]:
                    found.append((node[i], node[k]))
                    of[of == of[k]] = of[i]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are linked."""
    for whole in batches:
        for at in range(0, whole.num_rows, 32):
            b = whole.slice(at, 32)
            one, two = ([s for _, _, data, offsets in text_views(b.column(k), VIEW_BYTES) for s in shingle_sets(data, offsets, SIZE)] for k in (2, 3))
            ok = []
            for x, y in zip(one, two):
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(both > 0 and both * DEN >= (len(x) + len(y) - both) * NUM)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok, pa.bool_())), b.column(1).filter(pa.array(ok, pa.bool_()))], names=["a", "b"])


def texts_of(some: DataFrame, nodes: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """node and text of each node in `some`; the others as in verified()."""
    rows = cut(nodes.select("node", "doc", "th").join(some.select("node").distinct(), "node"))
    few = rows.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    texts = docs.join(F.broadcast(rows) if few else rows.hint("merge"), ["doc", "th"]).select("node", "text")
    return texts.dropDuplicates(["node"]) if repeated else texts


def in_cells(held: DataFrame, weight: Column, most: int) -> DataFrame:
    """held (run, node and more) with block and cell: a run is cut into blocks of about `most` of weight, and a row stands
    in a cell for each block of its run, so any two rows of a run meet in one."""
    blocks = held.groupBy("run").agg(F.ceil(F.sum(weight) / most).cast("int").alias("blocks"), F.count(F.lit(1)).alias("_n"))
    placed = with_match(held, "run", blocks, "inner").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.least(k, F.col("block")).cast("long") * F.col("blocks") + F.greatest(k, F.col("block")))
    return placed.withColumn("cell", F.explode(cells)).drop("blocks")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """The pairs (a, b) of nodes that are links. nodes: their sizes, sketches and one row (doc, th) each; docs: doc, th
    and text, where `repeated` tells whether a row occurs more than once."""
    one, two = (nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"sketch{k}")).hint("merge") for k in "ab")  # at every size: sketches are no rows to broadcast
    near = written(pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sketcha", "sketchb").mapInArrow(lean(_near), "a long, b long"), "near")
    texts = texts_of(near.select(F.explode(F.array("a", "b")).alias("node")), nodes, docs, repeated)
    # a hot hub's rows are slim on this side, and a partition of them that grows large is split by adaptive execution
    both = near.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return written(both.select("a", "b", "ta", "tb").mapInArrow(lean(_linked), "a long, b long"), "links").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest reachable node) of all nodes of links (a, b), by large-star and small-star rounds."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(u, v) as decimal(20, 0)))")).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


#: Stands for no doc_id where rows are ordered by it.
_NO_ID = 2**63 - 1


def set_components(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Rows of docs (doc_id, text), the groups among their sets, and whether a row with words occurs more than once.

    rows: doc_id, doc (doc_id, the largest number for null), th (hash of the text), n (size of the set), node (the set,
    null if it is empty). groups: node, first row (first_doc, first_th) of its component, and rows that hold the node
    (_n), for all nodes that have a copy or a link.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    described = written(docs.mapInArrow(lean(_describe), _BASE), "base")
    docs = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), "th", "text")
    rows = described.where("kind = 0").select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), "th", "n", "node")
    total = rows.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    if not total.n:
        return rows, spark.createDataFrame([], "node long, first_doc long, first_th long, _n long"), False
    own = described.where("kind = 0 and n > 0").withColumn("doc", F.coalesce("doc_id", F.lit(_NO_ID)))
    nodes = cut(own.groupBy("node").agg(F.min(F.struct("doc", "th")).alias("row"), F.max("n").alias("n"), F.min("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")).select("node", "row.doc", "row.th", "n", "sketch", "copies"))
    repeated = not rows.where("n > 0").groupBy("doc", "th").count().where("count > 1").isEmpty()
    common = described.where("kind = 1").groupBy(F.col("node").alias("s")).agg(F.sum("n").alias("c")).where(F.col("c") >= FREQUENT_LEAST).orderBy(F.desc("c"), "s").limit(FREQUENT).toPandas()
    order = np.argsort(common["s"].to_numpy(np.int64).view(np.uint64))
    frequent = spark.sparkContext.broadcast((common["s"].to_numpy(np.int64)[order].tobytes(), common["c"].to_numpy(np.int64)[order].tobytes()))
    ends = bands(int(total.most) * DEN // NUM + DEN)
    buckets = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total.n) // BUCKET_KEYS))

    sent = docs.select("text").mapInArrow(lean(_emit(frequent, ends, buckets)), "bucket int, keys binary, docs binary").repartition(max(1, buckets // 4), "bucket").sortWithinPartitions("bucket")
    members = written(sent.mapInArrow(lean(_runs), "run long, node long").distinct(), "runs")
    hubs = members.groupBy("run").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    stars = cut(with_match(members, "run", hubs, "inner").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    links = verified(stars, nodes, docs, repeated)
    found = cut(components(links))

    # sets of one run that are in different components so far
    placed = members.join(found, "node", "left").select("run", "node", F.coalesce("component", "node").alias("component"))
    # runs that touch the same least component are compared as one group, in which a set stands once
    open_runs = placed.groupBy("run").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("_n")).where("low < high").select("run", F.col("low").alias("anchor"), "_n")
    held = cut(with_match(placed, "run", open_runs, "inner").select(F.col("anchor").alias("run"), "node", "component").distinct())
    placed = in_cells(held, F.lit(1), BLOCK).join(nodes.select("node", "n", "sketch").hint("merge"), "node").select("run", "cell", "block", "node", "component", "n", "sketch")
    able = cut(placed.repartition("run", "cell").sortWithinPartitions("run", "cell").mapInArrow(lean(_open), "run long, node long, component long, n long").distinct())
    whole = in_cells(able, F.col("n"), BLOCK_SHINGLES).join(texts_of(able, nodes, docs, repeated), "node").select("run", "cell", "block", "node", "component", "text")
    more = cut(whole.repartition("run", "cell").sortWithinPartitions("run", "cell").mapInArrow(lean(_joining), "a long, b long"))

    found = components(links.union(more))
    grouped = cut(nodes.join(found, "node", "left").where("component is not null or copies > 1").select("node", F.coalesce("component", "node").alias("component"), "doc", "th", "copies"))
    first = grouped.groupBy("component").agg(F.min(F.struct("doc", "th")).alias("row"), F.count(F.lit(1)).alias("_n")).select("component", F.col("row.doc").alias("first_doc"), F.col("row.th").alias("first_th"), "_n")
    groups = with_match(grouped, "component", first, "inner").select("node", "first_doc", "first_th", F.col("copies").alias("_n"))
    return rows, groups, repeated


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text)."""
    rows, groups, _ = set_components(docs)
    rows = with_match(rows, "node", groups.drop("first_th")).select("doc_id", "doc", F.col("n").alias("n_shingles"), F.coalesce("first_doc", "doc").alias("component"))
    # components that rows of one doc_id join
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    if not several.isEmpty():
        rows = cut(rows)
        joined = rows.join(several.select("doc_id", "low"), "doc_id").select(F.col("low").alias("a"), F.col("component").alias("b"))
        # a row without shingles is a component of its own, named like its doc_id
        found = components(joined).select(F.col("node").alias("component"), F.col("component").alias("least"))
        sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
        rows = with_match(rows, "component", found.join(sizes, "component")).withColumn("component", F.coalesce("least", "component"))
    return rows.select("doc_id", "n_shingles", F.nullif("component", F.lit(_NO_ID)).alias("component_id"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their component by doc_id (null last) and text
    hash. Texts that differ too much to be linked stay even where they share a doc_id; of wholly equal pairs of doc_id
    and text one row stays; rows without words stay."""
    rows, groups, repeated = set_components(docs)
    own_doc, own_th = "_doc", "_th"
    while {own_doc.lower(), own_th.lower()} & {c.lower() for c in docs.columns}:
        own_doc, own_th = own_doc + "_", own_th + "_"
    gone = with_match(rows.where("n > 0"), "node", groups, "inner").where("doc <> first_doc or th <> first_th").select(F.col("doc").alias(own_doc), F.col("th").alias(own_th)).distinct()
    gone = cut(gone)
    few = gone.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    here = (F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)) == F.col(own_doc)) & (F.xxhash64(docs["text"]) == F.col(own_th))
    kept = docs.join(F.broadcast(gone) if few else gone.hint("merge"), here, "left_anti")
    if repeated:
        words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        kept = kept.where(words).dropDuplicates(["doc_id", "text"]).union(kept.where(~words))
    return kept


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_components of all documents."""
    return jaccard_components(table(spark, sf_dir, "documents"))
