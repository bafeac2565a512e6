"""The Jaccard join against all pairs, and the pipeline."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyvine.llm import common, jaccard, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus(seed=1):
    """Texts of many sizes, chains of edits, exact copies, shared passages and odd cases."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 5000)
    passage = [word() for _ in range(60)]
    texts = [None, "", "  \n", "one", "ONE", "one two three", "one two three four", "one two three four five", "a b c d e f", "a b c d e f g", "b c d e f g"]
    for k in range(60):
        base = [word() for _ in range(rng.choice((4, 6, 8, 12, 20, 40, 80, 150, 400, 900)))]
        if k % 3 == 0:
            base[len(base) // 2 : len(base) // 2] = passage
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):  # a chain of edits
            base = list(base)
            for _ in range(max(1, int(len(base) * rng.choice((0.005, 0.02, 0.03, 0.05))))):
                at = rng.randrange(len(base))
                base[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
            texts.append(" ".join(base))
        if k % 5 == 0:
            texts.append(texts[-1])
    hot = [word() for _ in range(120)]
    for _ in range(40):
        some = list(hot)
        some[rng.randrange(120)] = word()
        texts.append(" ".join(some))
    return texts


def components_by_hand(texts):
    made, parent = [sets(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(made[i] & made[j])
        if both and 100 * both >= 75 * (len(made[i]) + len(made[j]) - both):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: (len(made[i]), root(i)) for i in range(len(texts))}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(spark, seed, monkeypatch):
    if seed == 2:  # all that steers cost may change; the result may not
        monkeypatch.setattr(jaccard, "FREQUENT_LEAST", 2)
        monkeypatch.setattr(jaccard, "TASK_KEYS", 500)
        monkeypatch.setattr(jaccard, "TASK_SHINGLES", 500)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == components_by_hand(texts)


def near_copies(n, seed=5):
    """Texts that differ from one base so much that about half of their pairs are links."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = []
    for k in range(n):
        some = list(base)
        for at in rng.sample(range(len(base)), rng.choice((3, 6, 8, 9))):
            some[at] = f"x{k} {at}"
        texts.append(" ".join(some))
    return texts


def test_a_group_of_near_copies_leaves_as_many_rows_as_it_has_sets():
    """Not as many as it has pairs, and the links that leave join all that its links join."""
    texts = near_copies(100)
    made = [s for _, _, data, offsets in common.text_views(pa.array(texts)) for s in words.shingle_sets(data, offsets, 5)]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[str(k) for k in range(len(rows[0]))])
    sent = [r for b in jaccard._open(iter([batch([(1, 0, 0, k, k, len(x), jaccard.parity_sketch(x)) for k, x in enumerate(made)])])) for r in b.to_pylist()]
    assert len(sent) == len({r["node"] for r in sent}) <= 100 and {r["node"] for r in sent} == {r["component"] for r in sent}
    rows = [(1, 0, 0, r["node"], r["component"], texts[r["node"]]) for r in sent]
    links = [(r["a"], r["b"]) for b in jaccard._joining(iter([batch(rows[:30]), batch(rows[30:])])) for r in b.to_pylist()]
    by_hand = components_by_hand(texts)
    pairs = sum(100 * len(x & y) >= 75 * len(x | y) for x, y in itertools.combinations([sets(t) for t in texts], 2))
    assert len(links) == 100 - len({c for _, c in by_hand.values()}) and pairs > 1000
    root = list(range(100))
    for a, b in links:
        root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    assert root == [by_hand[k][1] for k in range(100)]


@pytest.mark.parametrize(("block", "shingles"), [(4096, 1 << 20), (16, 1 << 20), (16, 2000)])
def test_blocks_of_near_copies_against_all_pairs(spark, monkeypatch, block, shingles):
    """Sets of a group meet in some cell, however it is cut into blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", shingles)
    texts = near_copies(60) + near_copies(30, 6)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    rounds = []
    in_cells = jaccard.in_cells

    def seen(held, *a):
        out = in_cells(held, *a)
        rounds.append((held.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard, "in_cells", seen)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == components_by_hand(texts)
    assert all(held for held, _ in rounds) and rounds[0][0] <= 2 * len(texts) and (rounds[1][1] > rounds[1][0]) == (shingles == 2000)


def test_keys_never_miss_a_link():
    """Two linked sets always share a key, whatever the frequencies are."""
    rng = np.random.default_rng(3)
    ends = jaccard.bands(6000)
    for n in [*range(1, 60), 64, 90, 130, 300, 700]:
        for _ in range(12 if n < 60 else 40):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = jaccard.most_different(len(x), len(x))
            gone = rng.integers(0, max(1, most // 2 + 1))
            y = np.unique(np.concatenate([x[gone:], rng.integers(0, 2**63, int(rng.integers(0, most + 2))).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if both * 4 < (len(x) + len(y) - both) * 3 or (len(x) == len(y) == both):
                continue
            cost = lambda s: 1 + (s % np.uint64(3) == 0) * (s % np.uint64(97)).astype(np.int64)
            a, b = (jaccard.keys_of(s, cost(s), ends) for s in (x, y))
            assert len(np.intersect1d(a, b)), (len(x), len(y), both)


def test_no_rows_and_repeated_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.jaccard_components(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (2, " ", None, None, None)], SCHEMA)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(blank).collect()} == {1: 1, 2: 2}
    text = "a b c d e f g h i j k l m n o p"
    rows = [(5, text, "en", "s", 1), (5, text, "en", "s", 1), (9, text + " q", "en", "s", 1), (None, text, "en", "s", 1), (7, "other words than those above here", "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.jaccard_components(df).collect()) == [(0, 5), (5, 5), (5, 5), (7, 7), (9, 5)]
    kept = jaccard.without_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [5, 7]


def test_texts_that_share_an_id(spark, monkeypatch):
    """Links of every row of a doc_id count, and different texts of one doc_id stay."""
    rng = random.Random(8)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    long, short = some(400), some(60)
    near = short[:-1] + ["x"]
    rows = [(5, " ".join(long)), (5, " ".join(short)), (9, " ".join(near)), (12, " ".join(long)), (3, ""), (3, " ".join(near[1:] + ["y"])), (None, " ".join(some(30))), (None, " ".join(long[:-1])), (20, None), (20, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    for most in (1_000_000, 1):  # all groups broadcast, then heavy ones broadcast and the others shuffled
        monkeypatch.setattr(common, "MAX_MATCHES", most)
        monkeypatch.setattr(common, "HEAVY", 1)
        monkeypatch.setattr(jaccard, "MAX_BROADCAST_ROWS", most)
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()), key=str)
        want = [(5, 396, 3), (5, 56, 3), (9, 56, 3), (12, 396, 3), (3, 0, 3), (3, 56, 3), (None, 26, None), (None, 395, 3), (20, 0, 20), (20, 0, 20)]
        assert got == sorted(want, key=str)
        kept = jaccard.without_near_duplicates(df.union(df.where("doc_id = 5")))
        assert sorted(((r.doc_id, len((r.text or "").split())) for r in kept.collect()), key=str) == sorted([(5, 400), (3, 60), (3, 0), (None, 30), (20, 0), (20, 0)], key=str)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 3)]
    got = {r.node: r.component for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("ane", "ole", "ithe", "ound")]
    rows, labels = [], []
    for i in range(160):
        bad = i % 8 == 0
        text = " ".join(rng.choices(words, k=60)) + (" vilest awful" if bad else "")
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(bad)))
    rows.append((500, rows[1][1] + " more", "en", "s", 0))
    rows.append((501, "12 34 !!", "en", "s", 8))
    rows.append((502, rows[2][1][:200] + " token = abcdef0123456789abcdef99 " + " ".join(rng.choices(words, k=60)), "en", "s", 0))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not seen["toxicity"] & {i for i in range(0, 160, 8)} and len(seen["toxicity"]) == 143
    assert 501 not in seen["language"] and len(seen["language"]) == 142
    assert 500 not in seen["near_duplicates"] and len(seen["near_duplicates"]) == 141
    assert seen["packing"] == seen["secrets"] == seen["near_duplicates"]
    assert "[SECRET]" in spark.read.parquet(str(tmp_path / "secrets")).where("doc_id = 502").first().text
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen["packing"]
