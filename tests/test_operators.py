"""Splits, selections, metrics, duplicates, rules, corpus building, files and streams on small fixtures."""

import itertools
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvine.operators import audit, corpus, dedup, metrics, rules, select, split
from tallyvine.sources import files, schemas
from tallyvine.streaming import work

#: Sizes of strata and their held-out quotas.
GOLDEN = [(1340, 201), (990, 148), (30, 15), (10, 5), (29, 14), (100, 15), (110, 16), (1, 0), (0, 0)]


def test_quota(spark):
    got = [r[0] for r in spark.createDataFrame([(n,) for n, _ in GOLDEN], "n long").select(split.quota(F.col("n"))).collect()]
    assert got == [max(min(15, n // 2), round(n * 0.15)) for n, _ in GOLDEN] == [q for _, q in GOLDEN]


def test_split_is_stable_and_covers(spark):
    rows = [(i, "ab"[i % 3 == 0]) for i in range(200)]
    one = split.stratified(spark.createDataFrame(rows, "id int, kind string"), "id", "kind")
    two = split.stratified(spark.createDataFrame(rows[::-1], "id int, kind string").repartition(7), "id", "kind")
    assert sorted(map(tuple, one.select("id", "split").collect())) == sorted(map(tuple, two.select("id", "split").collect()))
    assert split.split_faults(one, one.select("id"), "id").count() == 0
    assert split.split_faults(one.where("id > 0"), one.select("id"), "id").count() == 1


def test_round_robin_mixes_every_batch(spark):
    df = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(90)] + [(100, None)], "id int, kind string")
    got = split.round_robin(df, "id", "kind", 9).collect()
    assert sorted(r.place for r in got) == list(range(91)) and len({r.batch for r in got}) == 11
    for _, group in itertools.groupby(sorted(got, key=lambda r: r.batch), key=lambda r: r.batch):
        assert len({r.kind for r in group}) >= 3


def reads(spark, df):
    """df, and an accumulator of how many of its rows have been computed."""
    seen, names = spark.sparkContext.accumulator(0), df.columns

    def rows(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(rows, df.schema).select(*names), seen


def test_round_robin_computes_its_rows_twice(spark):
    """Once to count ranges of strata, once to rank: keys may be digests of long texts."""
    df, seen = reads(spark, spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(90)], "id int, kind string"))
    got = split.round_robin(df, "id", "kind", 9).collect()
    assert sorted(r.place for r in got) == list(range(90)) and seen.value == 180


def test_curation_report_computes_its_traces_once(spark):
    problems = spark.createDataFrame([(str(i), f"p{i}", "7", "k") for i in range(4)], "id string, prompt string, answer string, category string")
    answer = {0: "it is \\boxed{7}", 1: "it is \\boxed{8}", 2: None}
    rows = [(str(i % 5), i, "NAR"[i % 3], answer[i % 4] if i % 4 < 3 else "so 7", None, "x" if i % 7 == 0 else None) for i in range(60)]
    traces, seen = reads(spark, spark.createDataFrame(rows, "id string, gen long, source string, text string, answer_text string, error string"))
    got = {r.source: r for r in corpus.curation_report(traces, problems, problems.where("id = '3'"), {"N": 0, "A": 1}, keep=2).collect()}
    assert seen.value == 60
    passed = {(s, i, g) for i, g, s, text, _, error in rows if not error and s != "R" and i not in "34" and text in (answer[0], "so 7")}
    kept = {x for i in "012" for x in sorted((x for x in passed if x[1] == i), key=lambda x: ("NA".index(x[0]), len(rows[x[2]][3]), x[2]))[:2]}
    for s in "NA":
        assert (got[s].traces, got[s].kept) == (20, sum(x[0] == s for x in kept)) and got[s].outranked == sum(x[0] == s for x in passed - kept)
        assert got[s].problem == sum(r[2] == s and not r[5] and r[0] in "34" for r in rows) and got[s].error == sum(r[2] == s and r[5] == "x" for r in rows)
    assert got["R"].source_gate == 20 - got["R"].error and got["R"].kept == 0


def test_grid_retries_errors(spark):
    problems = spark.createDataFrame([("a",), ("b",)], "id string")
    done = spark.createDataFrame([("a", 0, None), ("b", 1, "boom")], "id string, gen int, error string")
    assert sorted(map(tuple, select.grid(problems, 2, done).select("id", "gen").collect())) == [("a", 1), ("b", 0), ("b", 1)]


def test_upper_median_and_yield(spark):
    rows = [("p1", "c", True, 1, None), ("p1", "c", False, 2, None), ("p2", "c", False, 3, None), ("p2", "c", None, 4, None), ("p3", "c", None, None, "x"), ("p4", "d", True, 0, None)]
    got = {r.category: r for r in metrics.yield_table(spark.createDataFrame(rows, "id string, category string, correct boolean, out_tokens int, error string"), ["category"]).collect()}
    c = got["c"]
    assert (c.n_prob, c.n_gen, c.pass1, c.pass_any, c.calls, c.errors, c.tok_p50) == (2, 4, 0.25, 0.5, 5, 1, 3)
    assert got["d"].tok_p50 == 0


def test_votes(spark):
    df = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (1, "y", 2), (2, "b", 5), (2, "a", 6), (3, "z", 7), (3, None, 1)], "id int, a string, o int")
    got = {r.id: r for r in metrics.majority(df, ["id"], "a", "o").collect()}
    assert (got[1].majority, got[2].majority, got[2].unanimous, got[3].unanimous) == ("y", "b", None, "z")


def test_near_dup_pairs_against_brute_force(spark, tmp_path):
    from tallyvine.plans import catalogue

    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdefgh é漢😀 "), int(n))) for n in rng.integers(1, 400, 50)]
    texts += [t + "a" for t in texts[:30]] + [t[::-1] for t in texts[:10]] + texts[:20] + ["x" * 49, "x" * 51, "y" * 98, "y" * 102, "y" * 103]
    rows = [(i, t, [None, "en", "fr"][i % 3 if i % 2 else 1], [None, "s1", "s2"][i % 3]) for i, t in enumerate([*texts, "", "", None])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.QUERIES["near_dup_pairs"](spark, str(tmp_path)).collect()
    got = {(r.a, r.b): r.ratio for r in found}
    want = {}
    for (i, x, lang, _), (j, y, lang2, _) in itertools.combinations(rows, 2):
        if lang == lang2 and x == y == "":
            want[i, j] = 1.0
        elif lang == lang2 and x and y:
            shared = sum(min(x.count(c), y.count(c)) for c in set(x))
            if 2.0 * shared / (len(x) + len(y)) >= 0.98:
                want[(i, j) if len(x) <= len(y) else (j, i)] = round(2.0 * shared / (len(x) + len(y)), 6)
    assert len(found) == len(got) and got == want
    sources = {r[0]: r[3] for r in rows}
    assert any(sources[a] != sources[b] for a, b in want) and any(rows[a][2] is None for a, _ in want)


def test_likely_copies_in_chunks(spark, monkeypatch):
    """Bands of many chunks give all pairs once, and no pair that is not alike leaves its cell."""
    monkeypatch.setattr(dedup, "CHUNK", 3)
    monkeypatch.setattr(dedup, "COMPARED", 20)
    left = []
    monkeypatch.setattr(dedup, "written", lambda df, label, f=dedup.written: (left.append((label, out := f(df, label))), out)[1])
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdefg漢"), 100 + int(n))) for n in rng.integers(0, 6, 60)]
    texts += texts[:5] + ["a" * 97, "a" * 99, "a" * 101, "a" * 103, "a" * 105, "", "", "z"]
    got = [(r.a, r.b, round(r.ratio, 9)) for r in dedup.likely_copies(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "id int, t string, lang string"), "id", "t", "lang", 0.94).collect()]
    want = {}
    for (i, x), (j, y) in itertools.combinations(enumerate(texts), 2):
        alike = 2.0 * sum(min(x.count(c), y.count(c)) for c in set(x)) / (len(x) + len(y)) if x or y else 1.0
        if alike >= 0.94:
            want[(i, j) if len(x) <= len(y) else (j, i)] = round(alike, 9)
    assert len(got) == len(want) > 20 and {(a, b): r for a, b, r in got} == want
    nodes = {tuple(sorted(t)): i for i, t in reversed(list(enumerate(texts)))}
    alike = [out.count() for label, out in left if label == "alike"]
    assert alike == [sum(1 for i, j in want if {i, j} <= set(nodes.values()))]


def test_greedy_clusters(spark):
    rows = [("g", 0, "aaaa"), ("g", 1, "aaab"), ("g", 2, "zzzz"), ("g", 3, None), ("g", 4, ""), ("h", 0, "aaaa"), (None, 0, "q"), (None, 1, "q"), (None, 2, "é😀")]
    got = {(r.g, r.o): (r.representative, r.is_first) for r in dedup.greedy_clusters(spark.createDataFrame(rows, "g string, o int, t string"), "g", "o", "t").collect()}
    assert got == {("g", 0): (0, True), ("g", 1): (0, False), ("g", 2): (2, True), ("g", 3): (3, True), ("g", 4): (3, False), ("h", 0): (0, True), (None, 0): (0, True), (None, 1): (0, False), (None, 2): (2, True)}
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"[: int(rng.integers(2, 26))]), int(rng.integers(0, 30)))) for _ in range(150)]
    kept, want = [], {}
    for o, t in enumerate(texts):
        alike = lambda u: 2 * sum(min(t.count(c), u.count(c)) for c in set(t)) / (len(t) + len(u)) if t or u else 1.0  # noqa: E731, B023
        want[o] = next((p for p, u in kept if alike(u) >= 0.55), o)
        kept += [(o, t)] * (want[o] == o)
    df = spark.createDataFrame([(1, o, t) for o, t in enumerate(texts)], "g int, o int, t string").repartition(3)
    assert {r.o: r.representative for r in dedup.greedy_clusters(df, "g", "o", "t").collect()} == want


def test_greedy_clusters_of_a_hot_group(spark, monkeypatch):
    """A group of many rounds, whose later rows are dealt into parts, equals the walk through it in order."""
    monkeypatch.setattr(dedup, "FIRST_ROWS", 8)
    monkeypatch.setattr(dedup, "MOST_ROWS", 32)
    monkeypatch.setattr(dedup, "PART_ROWS", 50)
    met = []
    monkeypatch.setattr(dedup, "written", lambda df, label, f=dedup.written: (met.append((label, out := f(df, label))), out)[1])
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz0123456789")
    texts = ["".join(rng.choice(rng.choice(letters, 6), int(rng.integers(0, 25)))) for _ in range(700)]
    rows = [("hot", o, t) for o, t in enumerate(texts)] + [(None, None, "q"), (None, 1, "zz")] + [(f"g{o % 40}", o, texts[o]) for o in range(300)]
    want = []
    for g in {r[0] for r in rows}:
        kept = []
        for _, o, t in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0)):
            alike = lambda u: 2 * sum(min(t.count(c), u.count(c)) for c in set(t)) / (len(t) + len(u)) if t or u else 1.0  # noqa: E731, B023
            found = [p for p, u in kept if alike(u) >= 0.55]
            kept += [] if found else [(o, t)]
            want.append((g, o, found[0] if found else o, not found))
    got = dedup.greedy_clusters(spark.createDataFrame(rows, "g string, o int, t string").repartition(5), "g", "o", "t").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    parts = [df.collect() for label, df in met if label == "sizes"]
    assert len(parts) > 2 and parts[0][0].parts > 10


def test_lines_of_split_files_keep_their_order(spark, tmp_path):
    """Files of many splits: ordinals are line numbers; rows stop at the first malformed line of each file."""
    from tallyvine.sources import files

    schema = T.StructType([T.StructField("n", T.IntegerType())])
    texts = {"a": [f'{{"n": {k}}}' if k % 7 else "" for k in range(3000)], "b": [f'{{"n": {k}}}' if k != 1700 and k != 200 else '{"n": ' for k in range(2500)], "c": ["not json"], "d": [], "e": ['{"n": 1}', "  ", '"text"', '{"n": 2}']}
    for name, lines in texts.items():
        (tmp_path / f"{name}.jsonl").write_text("".join(x + "\n" for x in lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        lines = files.read_lines(spark, str(tmp_path)).collect()
        assert len({r.block for r in files.lines_in_order(spark, str(tmp_path)).where("file like '%a.jsonl'").collect()}) > 5
        rows = files.read_until_bad(spark, str(tmp_path), schema).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    name = lambda r: r.file.rsplit("/", 1)[1][0]
    assert sorted((name(r), r.ordinal, r.value) for r in lines) == sorted((f, k, x) for f, xs in texts.items() for k, x in enumerate(xs))
    got = {f: [r.n for r in sorted((r for r in rows if name(r) == f), key=lambda r: r.place)] for f in texts}
    assert got == {"a": [k for k in range(3000) if k % 7], "b": list(range(200)), "c": [], "d": [], "e": [1]}


def test_contamination(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Say: {item.upper()}.\n ok"), (2, "one two three"), (3, None), (4, "a short Item here"), (5, "abcone two threefour"), (6, "concatenate"), (7, ""), (7, f"x{item}y"), (8, "a b c d a b c d e")]
    items = [(7, item), (8, "short item"), (9, ""), (10, None), (11, "one two three"), (12, "cat"), (13, "b c d e"), (14, "ONE  two"), (15, "t"), (16, "b c d a b c d e f")]
    norm = lambda t: " ".join(t.lower().split())
    want = sorted({(d, i) for d, t in docs for i, u in items if t is not None and u and norm(u) in norm(t)})
    for few in (100_000, 0):  # broadcast, then joined
        monkeypatch.setattr(audit, "FEW", few)
        got = audit.contamination(spark.createDataFrame(docs, "d int, text string"), spark.createDataFrame(items, "i int, text string"), "d", "i")
        assert sorted(map(tuple, got.collect())) == want


def test_broadcasts_are_bounded_by_bytes(spark):
    """Few rows of long texts are no small table; the lookup's join is then a merge join with the same rows."""
    docs = spark.createDataFrame([(1, None, "f"), (2, "kept", "f"), (3, "", "f"), (4, None, "f")], "id int, text string, _found string")
    lookup = spark.createDataFrame([(1, "x" * 5000), (3, "y" * 5000), (3, "z"), (9, "none")], "id int, text string")
    assert select.is_small(lookup) and not select.is_small(lookup, size=9000) and not select.is_small(lookup, rows=3)
    want = [(1, "x" * 5000, "f"), (2, "kept", "f"), (3, "y" * 5000, "f"), (4, None, "f")]
    for size in (select.BROADCAST_BYTES, 9000):
        select.BROADCAST_BYTES, before = size, select.BROADCAST_BYTES
        try:
            found = select.enrich(docs, lookup, "id", "text")
        finally:
            select.BROADCAST_BYTES = before
        assert sorted(tuple(r) for r in found.select("id", "text", "_found").collect()) == want
        assert ("BroadcastHashJoin" in found._jdf.queryExecution().sparkPlan().toString()) == (size > 9000)


def test_rule_counts_and_division(spark):
    all_rules = rules.verifier_rules()
    assert len(all_rules) == 7004 and len(rules.bit_primitives()) == 30 and len(rules.word_rules()) == 30 + 900 + 3 * 465
    image = dict(all_rules)["ROL2 XOR SHR1"]
    xs = [3, 77, 130, 201, 255, 18, 64, 99]
    problems = spark.createDataFrame([("p", [(x, int(image[x])) for x in xs], 41, int(image[41])), ("none", [], 1, 1)], "id string, examples array<struct<x: int, y: int>>, query int, truth int")
    table = rules.rule_table(spark, all_rules)
    found = {r.rule for r in rules.consistent(problems, table).collect()}
    assert found == {n for n, i in all_rules if all(i[x] == image[x] for x in xs)}
    verified = rules.verify(problems, table)
    assert {r.id: (r.rules, r.truth_predicted) for r in verified.collect()} == {"p": (len(found), True), "none": (0, False)}
    report = rules.verify_report(verified).first()
    assert (report.problems, report.rule_found, report.no_rule) == (2, 1, 1)


def test_bit_solvers(spark):
    image = rules.bit_terms()["ROL3"]
    xs = [0, *(1 << k for k in range(8)), *range(11, 256, 13), 255]
    lines = "\n".join(f"{x:08b} -> {int(image[x]):08b}" for x in xs)
    prompts = spark.createDataFrame([("a", f"input -> output:\n{lines}\nNow, determine the output for: 10110001"), ("b", "nothing")], "id string, prompt string")
    assert {r.id: r.answer for r in rules.bit_search(prompts).collect()} == {"a": format(int(image[0b10110001]), "08b"), "b": None}


def columns_by_hand(examples, query):
    """Every rule of every family, tried on every example."""
    ops = {"AND": lambda p, q: p & q, "OR": lambda p, q: p | q, "XOR": lambda p, q: p ^ q}
    bit = lambda v, k: v >> 7 - k & 1

    def family(name, x):
        if name in ("0", "1"):
            return [int(name)]
        if name in ("I", "NOT"):
            return [bit(x, k) ^ (name == "NOT") for k in range(8)]
        op, _, inverted = name.partition("-")
        return [ops[op](bit(x, a), bit(x, b) ^ bool(inverted)) for a in range(8) for b in range(8)]

    fits = {f: [[all(family(f, x)[k] == bit(y, j) for x, y in examples) for k in range(len(family(f, 0)))] for j in range(8)] for f in rules.FAMILIES}
    if not examples or not all(any(any(fits[f][j]) for f in fits) for j in range(8)):
        return None
    by = next(([f] for f in rules.FAMILIES if all(any(fits[f][j]) for j in range(8))), rules.TIE_ORDER)
    out = ""
    for j in range(8):
        votes = [v for f in by for v, ok in zip(family(f, query), fits[f][j]) if ok]
        out += str(int(2 * sum(votes) > len(votes) or (2 * sum(votes) == len(votes) and votes[0])))
    return out


def test_bit_columns(spark):
    rng = np.random.default_rng(6)
    turn = lambda x, k: (x << k | x >> 8 - k) & 255
    kinds = [lambda x: turn(x, 3) ^ x >> 2, lambda x: turn(x, 1) & ~turn(x, 2) & 255, lambda x: x ^ 255, lambda x: 0, lambda x: turn(x, 5) | turn(x, 6), lambda x: x * x % 256, lambda x: 255]
    cases = [([(int(x), f(int(x))) for x in rng.integers(0, 256, n)], int(rng.integers(0, 256))) for f in kinds for n in (0, 1, 2, 4, 9, 70)]
    rows = [(k, "input -> output:\n" + "\n".join(f"{x:08b} -> {y:08b}" for x, y in e) + f"\nNow, determine the output for: {q:08b}") for k, (e, q) in enumerate(cases)]
    prompts = spark.createDataFrame([*rows, *rows[:3], (None, None), (-1, "no question")], "id int, prompt string")
    got = rules.bit_columns(prompts).collect()
    want = {k: columns_by_hand(e, q) for k, (e, q) in enumerate(cases)} | {None: None, -1: None}
    assert len(got) == len(rows) + 5 and all(r.answer == want[r.id] for r in got)
    assert sum(v is not None for v in want.values()) > 20


def test_equation_search(spark):
    ask = lambda lines, q: "examples:\n" + "\n".join(lines) + f"\nNow, determine the result for: {q}"
    prompts = spark.createDataFrame([("add", ask(["12#34 = 46", "50#07 = 57"], "20#22")), ("rev", ask(["12+34 = #64"], "11+22")), ("op", ask(["12#34 = 46", "12*34 = 408"], "11*11")), ("none", ask(["12#34 = zz"], "11#11")), ("empty", "x")], "id string, prompt string")
    prompts = prompts.withColumn("note", F.lit(None).cast("string"))
    prompts = prompts.union(prompts).union(spark.createDataFrame([(None, None, None)], prompts.schema))
    rows = rules.equation_search(prompts).collect()
    got = {r.id: r.answer for r in rows}
    assert len(rows) == 11 and got[None] is None and rules.equation_search(spark.createDataFrame([("t", ask(["12#34 = 46", "20#22 = 440"], "20#22"))] * 2, "id string, prompt string")).where("answer is not null").count() == 0
    assert got["add"] == "42" and got["op"] == "121" and got["none"] is None and got["empty"] is None


def symbols_by_hand(examples, query):
    """All digits of all symbols, tried one after the other."""
    parts = [(left[:2] + left[3:], right) for left, right in examples]
    asked = query[:2] + query[3:]
    symbols = list(dict.fromkeys("".join(a + r for a, r in parts) + asked))
    answers = set()
    for op in (lambda a, b: a + b, lambda a, b: a - b, lambda a, b: abs(a - b), lambda a, b: a * b):
        for digits in itertools.product(range(10), repeat=len(symbols)):
            of, names = dict(zip(symbols, digits)), {}
            for s, d in of.items():
                names.setdefault(str(d), s)
            made = lambda t: "".join(c if c == "-" else names.get(c, "?") for c in str(op(of[t[0]] * 10 + of[t[1]], of[t[2]] * 10 + of[t[3]])))  # noqa: E731, B023
            if all(made(a) == r for a, r in parts) and "?" not in made(asked):
                answers.add(made(asked))
    return answers.pop() if len(answers) == 1 else None


def test_symbols_against_all_digits():
    rng = np.random.default_rng(9)
    some = lambda n: "".join(rng.choice(list("abcd"), n))
    found = set()
    for k in range(60):
        examples = [(some(2) + "+" + some(2), ("-" if rng.random() < 0.15 else "") + some(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(1, 3)))]
        if k % 2:  # one that has a solution
            of = dict(zip("abcd", rng.integers(0, 10, 4)))
            names = {}
            for s in "abcd":
                names.setdefault(str(of[s]), s)
            made = []
            for left, _ in examples:
                value = str([lambda a, b: a + b, lambda a, b: a - b, lambda a, b: a * b][k % 3](of[left[0]] * 10 + of[left[1]], of[left[3]] * 10 + of[left[4]]))
                made.append((left, "".join("-" if c == "-" else names.get(c, "a") for c in value)))
            examples = made
        query = some(2) + "*" + some(2)
        if any(how == [r for _, r in examples] for how in ([x[:2] + x[3:] for x, _ in examples], [x[3:] + x[:2] for x, _ in examples])):
            continue
        want = symbols_by_hand(examples, query)
        found.add(want is not None)
        assert rules.solve_symbols(examples, query) == want, (examples, query)
    assert found == {True, False}
    assert rules.solve_symbols([("db+dc", "dcc"), ("ca+da", "da")], "aa+cc") is None


def test_symbol_solver_and_harness(spark):
    assert rules.solve_symbols([("ab+cd", "abcd")], "xy+zw") == "xyzw"
    assert rules.solve_symbol_prompt("examples:\nab+cd = cdab\nNow, determine the result for: xy+zw") == "zwxy" and rules.solve_symbol_prompt("nothing") is None
    with pytest.raises(TimeoutError):
        rules.solve_symbols([("ab*cd", "ef")], "gh*ab", deadline=time.monotonic() - 1)

    def solve(prompt):
        if prompt == "bad":
            raise ValueError
        if prompt == "end":
            import os

            os._exit(3)
        while prompt == "stuck":
            pass
        return prompt.upper()

    problems = spark.createDataFrame([("1", "x", "X"), ("2", "bad", "?"), ("3", "stuck", "?"), ("4", "y", "z"), ("5", "end", "?"), ("6", None, "?"), ("7", "v", "V")], "id string, prompt string, answer string").coalesce(1)
    got = rules.graded(rules.run_solver(problems, solve, seconds=0.5), problems.select("id", "answer"))
    assert {r.id: r.outcome for r in got.collect()} == {"1": "ok", "2": "error", "3": "timeout", "4": "wrong", "5": "error", "6": "error", "7": "ok"}
    assert rules.answers(problems, "baseline_null").where("answer is null").count() == 7
    null = problems.select(F.lit("s").alias("status"), F.when(rules.null_answer(F.col("prompt")).isNull(), "wrong").alias("outcome"))
    assert metrics.outcomes(null).first().ok == 0


def test_a_prompt_is_solved_once(spark):
    """All rows of one prompt have the outcome of one run of the solver; null prompts stay errors."""
    problems = spark.createDataFrame([(k, "same" if k < 5 else None) for k in range(7)], "id int, prompt string")
    found = {r.id: (r.answer, r.outcome) for r in rules.run_solver(problems, lambda p: str(time.monotonic_ns())).collect()}
    assert len({found[k] for k in range(5)}) == 1 and found[0][1] == "ok" and [found[k] for k in (5, 6)] == [(None, "error")] * 2


def test_null_groups_and_strata(spark):
    rows = [(1, None, 7, "a"), (2, None, 7, "b"), (3, "x", 3, "c")]
    df = spark.createDataFrame(rows, "id int, category string, out_tokens int, note string").withColumn("correct", F.lit(True)).withColumn("error", F.lit(None).cast("string"))
    assert {r.category: r.tok_p50 for r in metrics.yield_table(df, ["category"]).collect()} == {None: 7, "x": 3}
    assert split.stratified(df, "id", "category").count() == 3 and split.split_faults(split.stratified(df, "id", "category"), df, "id").count() == 0
    assert split.capped_sample(df, "id", "category", {}, 1).count() == 2 and sorted(r.place for r in split.round_robin(df, "id", "category", 2).collect()) == [0, 1, 2]


def test_ranks_are_row_numbers(spark):
    from pyspark.sql import Window

    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("s"))
    got = split.ranked(df, "id", "s")
    want = df.withColumn("_rank", F.row_number().over(Window.partitionBy("s").orderBy(split.draw(F.col("id")), "id")).cast("long"))
    assert sorted(map(str, (tuple(r) for r in got.select("id", "s", "_rank").collect()))) == sorted(map(str, (tuple(r) for r in want.select("id", "s", "_rank").collect())))


def test_corpus(spark):
    problems = spark.createDataFrame([("p1", "equation_numeric_guess", "q1", "42"), ("p2", "x", "held", "7"), ("p3", "equation_numeric_guess", "Now, determine the result for: 12-30", "-18")], "id string, category string, prompt string, answer string")
    traces = spark.createDataFrame(
        [("p1", 0, "a", "long way \\boxed{42}", None, None), ("p1", 1, "b", None, "\\boxed{42.0}", None), ("p1", 2, "a", "wrong \\boxed{42.1}", None, None), ("p1", 3, "a", "\\boxed{42}", None, "err"), ("p2", 0, "a", "\\boxed{7}", None, None), ("p1", 4, "z", "\\boxed{42}", None, None), ("p1", 5, "a", "", "", None)],
        "id string, gen int, source string, text string, answer_text string, error string",
    )
    held = spark.createDataFrame([("p2",)], "id string")
    got = corpus.curate(traces, problems, held, {"b": 0, "a": 1}, keep=2)
    assert sorted((r.source, r.generated_cot) for r in got.collect()) == [("bedrock_a", "long way \\boxed{42}"), ("bedrock_b", "\\boxed{42.0}")]
    made = corpus.synthetic(problems).collect()
    assert [(r.id, r.answer, r.source) for r in made] == [("p3", "-18", "solver_rule")]
    records = corpus.chat_records(got, corpus.synthetic(problems), 3)
    assert records.count() == 5
    assert corpus.training_order(records, 2).select("batch").distinct().count() == 3
    content = records.where("id = 'p1'").first().messages[1].content
    assert content.endswith("\n</think>\n\\boxed{42}") and "\\boxed{42.0}" not in content


def test_files(spark, tmp_path):
    (tmp_path / "run_x").mkdir()
    (tmp_path / "_test_y").mkdir()
    good = {"id": "00066667", "gen": 1, "correct": True}
    (tmp_path / "run_x" / "results.jsonl").write_text(json.dumps(good) + "\n\n{broken\n")
    (tmp_path / "_test_y" / "results.jsonl").write_text(json.dumps(good) + "\n")
    assert [(r.id, r.label) for r in files.read_labelled(spark, str(tmp_path), schemas.TRACE).collect()] == [("00066667", "run_x")]
    (tmp_path / "deep" / "eq_model").mkdir(parents=True)
    (tmp_path / "deep" / "eq_model" / "results.jsonl").write_text(json.dumps(good) + "\n")
    tree = files.read_tree(spark, str(tmp_path), schemas.TRACE)
    assert tree.count() == 2 and {r.label for r in tree.collect()} == {"run_x", "model"}
    (tmp_path / "deep" / "glm_existing.jsonl").write_text(json.dumps(good) + "\n")
    tree = files.read_tree(spark, str(tmp_path), schemas.TRACE, "{results.jsonl,*_existing.jsonl}")
    assert sorted((r.label, r.id) for r in tree.collect()) == [("glm", "00066667"), ("model", "00066667"), ("run_x", "00066667")]
    assert files.corrupt_lines(spark, str(tmp_path / "run_x"), schemas.TRACE).first().dropped == 1
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "run_x"), schemas.TRACE, tolerant=False).collect()
    (tmp_path / "t.csv").write_text('﻿id,Prompt\n007,"two\nlines, ""quoted"""\n', encoding="utf-8")
    row = files.read_csv(spark, str(tmp_path / "t.csv")).first()
    assert row.asDict() == {"id": "007", "prompt": 'two\nlines, "quoted"'}
    files.write_ids(spark.createDataFrame([("b",), ("a",)], "id string"), "id", str(tmp_path / "ids"))
    assert sorted(r.id for r in files.read_ids(spark, str(tmp_path / "ids")).collect()) == ["a", "b"]
    found, missing = files.read_registry(spark, {"x": str(tmp_path / "run_x"), "no": str(tmp_path / "no")}, schemas.TRACE)
    assert found.first().source == "x" and missing == ["no"]
    assert files.markdown(spark.createDataFrame([(1, 0.5)], "a int, b double")) == "| a | b |\n|---|---|\n| 1 | 0.500 |"
    state = spark.createDataFrame([("s", "new")], "slug string, status string")
    where = str(tmp_path / "state")
    assert files.load_state(spark, where) is None
    files.save_state(state, where)
    before = files.load_state(spark, where)
    files.save_state(before.withColumn("status", F.lit("done")), where)
    assert files.load_state(spark, where).first().status == "done" and before.first().status == "new"  # readers keep what they read
    files.save_state(state, where)
    assert len(list((tmp_path / "state").glob("version=*"))) == 2
    assert {r.id for r in files.read_whole_files(spark, [str(tmp_path / "run_x"), str(tmp_path / "deep" / "eq_model")], schemas.TRACE).collect()} == {"00066667"} and files.read_whole_files(spark, str(tmp_path / "run_x"), schemas.TRACE).count() == 0
    assert files.fixed_width(spark.createDataFrame([(1, "ab"), (None, "c")], "a int, bcd string").coalesce(1)) == "a  bcd\n1  ab\n   c"
    assert files.result_line(state, "R").first().value == 'R {"slug":"s","status":"new"}'


def test_state_machine(spark, tmp_path):
    start = (work.NEW, 0, None, None)
    assert work.next_state(start, "quota", 1, "q", 3)[:2] == (work.RETRY, 0)
    once = work.next_state(start, "error", 1, "e", 2)
    assert once[:2] == (work.RETRY, 1) and work.next_state(once, "error", 2, "e", 2)[0] == work.FAILED
    done = work.next_state(once, "ok", 3, None, 2)
    assert done[0] == work.DONE and work.next_state(done, "error", 4, "e", 2) == done
    events = [("a", "error", "2024-01-01 00:00:00", "x"), ("a", "ok", "2024-01-01 00:01:00", None), ("a", "error", "2024-01-01 00:02:00", "late"), ("b", "quota", "2024-01-01 00:00:00", "q")]
    spark.createDataFrame(events, "slug string, outcome string, event_time string, err string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("slug string, outcome string, event_time timestamp, err string").json(str(tmp_path / "in"))
    run = work.submissions(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert {r.slug: r.status for r in spark.table("states").collect()} == {"a": work.DONE, "b": work.RETRY}
    merge = work.upsert(str(tmp_path / "table"), "slug", "event_time")
    merge(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "slug string, event_time int, status string"), 0)
    merge(spark.createDataFrame([("a", 1, "old"), ("b", 1, "z")], "slug string, event_time int, status string"), 1)
    assert {r.slug: r.status for r in files.load_state(spark, str(tmp_path / "table")).collect()} == {"a": "y", "b": "z"}


def test_streams(spark, tmp_path):
    """Sentinels, keys that are replayed, traces that are appended, and progress over all batches."""
    for run in ("r1", "r2"):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "x.done").write_text("ok")
    (tmp_path / "runs" / "r1" / "results.jsonl").write_text('{"id": "1"}\n')
    found = work.sentinels(spark, str(tmp_path / "runs")).writeStream.format("memory").queryName("runs").trigger(availableNow=True).start()
    found.awaitTermination()
    assert sorted(r.run for r in spark.table("runs").collect()) == ["r1", "r2"]
    listener = work.Progress(step=4)
    spark.streams.addListener(listener)
    (tmp_path / "traces").mkdir()
    for k in range(3):
        (tmp_path / "traces" / f"{k}.json").write_text("".join('{"id": "%d", "gen": %d}\n' % (i, k % 2) for i in range(3)))
    stream = work.distinct_keys(spark.readStream.schema(schemas.TRACE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "traces")), ["id", "gen"])
    query = stream.writeStream.format("memory").queryName("keys").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("keys").count() == 6
    end = time.monotonic() + 20
    while listener.rows.get(str(query.id), 0) < 9 and time.monotonic() < end:
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert listener.passed(query) == [4, 8]
    assert work.trace_stream(spark, str(tmp_path / "traces"), schemas.TRACE).isStreaming
