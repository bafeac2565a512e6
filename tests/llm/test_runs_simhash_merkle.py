"""Periodic runs, SimHash components and Merkle proofs against brute force; odd rows."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyvine.llm import merkle, periodic, simhash


def joined(n, links):
    """The smallest place that each of n places can reach."""
    of = list(range(n))

    def find(x):
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


# periodic runs


def all_runs(t):
    out = []
    for p in range(1, len(t) // 4 + 1):
        i = 0
        while i + p < len(t):
            if t[i] != t[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(t) and t[i] == t[i + p]:
                i += 1
            n = i + p - start
            if n >= max(6, 4 * p) and not any(all(t[k] == t[k + q] for k in range(start, start + n - q)) for q in range(1, p)):
                out.append((start, n, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, kinds = rng.choice([0, 1, 5, 6, 7, 20, 60, 150]), rng.choice([1, 2, 3, 10])
    t = [rng.randrange(kinds) for _ in range(n)]
    if n > 8 and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 9)
        t = [t[i] if i < a else t[a + (i - a) % p] for i in range(n)]
    return t


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        texts = [some_words(rng) for _ in range(rng.randint(0, 8))]
        assert periodic.runs_of_texts([np.array(t, np.int64) for t in texts]) == [all_runs(t) for t in texts]


def test_equal_runs_stay_apart_at_the_ends_of_texts():
    one = np.zeros(9, np.int64)
    assert periodic.runs_of_texts([one, one]) == [[(0, 9, 1)], [(0, 9, 1)]]


def test_long_runs_take_linear_time():
    assert periodic.runs_of_texts([np.zeros(300_000, np.int64)]) == [[(0, 300_000, 1)]]
    assert periodic.runs_of_texts([np.arange(200_000) % 1999]) == [[(0, 200_000, 1999)]]


def test_op11_contract(spark, tmp_path):
    rng = random.Random(9)
    words = ["ab", "c", "É", "Ab"]
    texts = [(k, rng.choice([" ", "\n", " \t"]).join(words[x] for x in some_words(rng) if x < 4)) for k in range(300)]
    texts += [(7, "a a a a a a a"), (8, None), (None, "b c " * 20), (9, ""), (10, " \n ")]
    spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_runs", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")

    def expected(i, text):
        w = (text or "").encode().split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        runs = all_runs(w)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        return (i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], listed, hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())

    got = [tuple(r) for r in periodic.op11_periodic(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(repr(expected(*t)) for t in texts)
    assert sum(r[1] > 0 for r in got) > 30


def test_collapsed_texts(spark):
    df = spark.createDataFrame([("k", "x y x y x y x y z", 1), (None, None, 2)], "runs string, text string, id int")
    rows = {r.runs_id: r for r in periodic.periodic_runs(df.withColumnRenamed("runs", "runs_id"), "runs_id", "text").collect()}
    assert rows["k"].collapsed == "x y z" and [tuple(r) for r in rows["k"].runs] == [(0, 8, 2)]
    assert rows[None].collapsed == "" and rows[None].runs == []


# SimHash


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("parity", [0, 1])
def test_balls_connect_exactly_what_is_near(parity):
    """Random families with steps of one to four bits; any parity may be the one that emits pairs of flips."""
    rng = np.random.default_rng(parity)
    for _ in range(30):
        fps = list(rng.integers(0, 2**63, 5, dtype=np.uint64))
        for _ in range(60):
            x = fps[rng.integers(len(fps))]
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x = x ^ (np.uint64(1) << np.uint64(b))
            fps.append(x)
        fps = np.unique(np.array(fps, np.uint64))
        batch = pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], names=["fp"])
        keys, codes = [], []
        for sent in simhash._emit(parity, 5)(iter([batch])):
            keys += [np.frombuffer(x.as_py(), np.uint64) for x in sent.column(1)]
            codes += [np.frombuffer(x.as_py(), np.uint16) for x in sent.column(2)]
        a, b = simhash.meeting(np.concatenate(keys), np.concatenate(codes))
        assert np.bitwise_count(a ^ b).max(initial=0) <= 3
        apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
        near = [(i, j) for i in range(len(fps)) for j in range(i) if apart[i, j] <= 3]
        assert joined(len(fps), zip(np.searchsorted(fps, a).tolist(), np.searchsorted(fps, b).tolist())) == joined(len(fps), near)


def test_a_crowded_variant_gives_linear_edges():
    """All 2,080 neighbours within two flips of one word share it; an edge each, not one for each pair."""
    fps = np.unique(np.concatenate([np.uint64(5) ^ simhash.FLIPS, [np.uint64(5)]]))
    a, b = simhash.meeting(np.full(len(simhash.FLIPS), np.uint64(5)), np.arange(len(simhash.FLIPS)).astype(np.uint16))
    assert len(fps) == len(simhash.FLIPS) == 1057 and len(a) == 1056 and set(a.tolist()) == {5}


def test_op12_contract(spark, tmp_path):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["red", "Blue", "green", "oak", "elm", "É"]) for _ in range(rng.randint(30, 200))) for _ in range(25)]
    texts = [(k, t) for k, t in enumerate(base)]
    for k in range(120):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = "other"
        texts.append((100 + k, " \t".join(words)))
    texts += [(300, None), (301, ""), (302, "one"), (303, "one two"), (5, base[5]), (5, base[6]), (None, base[7]), (None, "apart from all of these")]
    spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, fp int").write.parquet(f"{tmp_path}/documents.parquet")
    fps = [slow_fingerprint(t) for _, t in texts]
    of = joined(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for (i, _), c in zip(texts, of):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    got = [tuple(r) for r in simhash.op12_simhash(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, f"{f:016x}", least[c])) for (i, _), f, c in zip(texts, fps, of))
    assert len(set(of)) < len(set(fps)) < len(texts)  # there are links and copies


def test_hashes_equal_sparks(spark):
    text = "Some words, \t and É more of THEM\n than thirty-two bytes in a shingle: " + "x" * 50
    words = text.encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]).decode() for k in range(len(words) - 2)]
    df = spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s").alias("h"))
    assert [r.h for r in df.collect()] == simhash.shingle_hashes(text.encode()).view(np.int64).tolist()


# Merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def manifest(rows):
    """op13's rows of (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf_of(r)))
    trees = {k: tree([leaf_of(r) for r in groups[k]]) for k in keys}
    top = tree([trees[k][-1][0] for k in keys])
    root = top[-1][0]
    for rank, k in enumerate(keys):
        for i, r in enumerate(groups[k]):
            path = [(level, i >> j) for j, level in enumerate(trees[k][:-1])] + [(level, rank >> j) for j, level in enumerate(top[:-1])]
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now, beside = leaf_of((*r[:3], r[3] + 1, r[4]) if changed else r), []
            for level, at in path:
                beside.append(level[at ^ 1] if at ^ 1 < len(level) else "")
                now = H(now, beside[-1]) if at % 2 == 0 else H(beside[-1], now)
            yield r[0], leaf_of(r), trees[k][-1][0], root, H(*beside), now, now == root


def odd_rows(n):
    rng = random.Random(n)
    rows = [(k * 3 % 1009, rng.choice(["web", None]), rng.choice([None, "", "en", "é", "de", "ab", "zz"][: 1 + n % 7]), rng.choice([5, None]), rng.choice(["text é", None, "", "long " * 99])) for k in range(n)]
    return rows + rows[: n // 9] + ([(None, None, None, None, None)] * 2 if n % 2 else [])


@pytest.mark.parametrize("n", [1, 2, 64, 65, 333, 9000])
def test_op13_contract(spark, tmp_path, n):
    """Trees of one leaf, of exactly one block, of one more, and of three tiers; nulls, repeated rows and ids; DuckDB's too."""
    rows = odd_rows(n)
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(repr(tuple(r)) for r in merkle.op13_merkle(spark, str(tmp_path)).collect())
    assert got == sorted(map(repr, manifest(rows)))
    if n < 1000:
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        found = con.sql(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({merkle.SQL})")
        assert sorted(map(repr, found.fetchall())) == got


def test_as_many_groups_as_rows(spark):
    """A tree over thousands of groups, each a lone leaf."""
    df = spark.range(5000).select("id", F.lpad("id", 5, "0").alias("g"))
    rows = merkle.manifest(df, [F.col("id")], F.col("g"), F.col("id"), {"id": F.col("id")})
    rows = rows.select("id", "root", merkle.folded(F.col("path"), F.col("leaf")).alias("folded"), merkle.siblings(F.col("path")).alias("beside")).collect()
    levels = tree([leaf_of((k,)) for k in range(5000)])
    assert {r.root for r in rows} == {r.folded for r in rows} == {levels[-1][0]} and len(rows) == 5000
    assert all(r.beside.startswith(levels[0][r.id ^ 1]) for r in rows)


def test_places_do_not_depend_on_the_reading(spark):
    """A group that holds nearly all rows takes several ranges; places are the order's."""
    df = spark.range(3000).select((F.col("id") * 7 % 3000).alias("o"), F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("k"))
    one, two = (sorted((r.k, r.pos, r.o, r.n) for r in merkle.placed(df.repartition(p), ["k", "o"]).collect()) for p in (1, 5))
    assert one == two and [r[1] for r in one if r[0] == "a"] == list(range(2940)) and [r[2] for r in one if r[0] == "a"] == sorted(r[2] for r in one if r[0] == "a")
