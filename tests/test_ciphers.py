"""Ciphers against a search in plain Python, factors, and the report of solved problems."""

import random

import pytest
from pyspark.sql import functions as F

from tallyvine.operators import rules

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def one_to_one(pairs):
    return {(c, p) for c, p in pairs if sum(c == d for d, _ in pairs) == 1 and sum(p == q for _, q in pairs) == 1}


def searched(examples, question, words):
    """Every word of the question against every word of the list, until nothing is learned."""
    votes = {}
    for cipher, plain in examples:
        if len(cipher) == len(plain):
            for c, p in zip(cipher, plain):
                votes.setdefault(c, set()).add(p)
    known = dict(one_to_one({(c, *ps) for c, ps in votes.items() if len(ps) == 1 and c in LETTERS and min(ps) in LETTERS}))
    shape = lambda w: [w.index(c) for c in w]
    tokens = set("".join(c if c in LETTERS else " " for c in question).split())
    while True:
        new = set()
        for t in tokens:
            fits = [w for w in words if shape(w) == shape(t) and all(known[c] == p if c in known else p not in known.values() for c, p in zip(t, w))]
            if len(fits) == 1:
                new |= {(c, p) for c, p in zip(t, fits[0]) if c not in known}
        new = one_to_one(new)
        if not new:
            return "".join(known.get(c, "?") if c in LETTERS else c for c in question)
        known |= dict(new)


def test_ciphers_against_every_word(spark):
    rng, vocabulary = random.Random(11), set()
    while len(vocabulary) < 400:
        vocabulary.add("".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 8))))
    words, examples, questions = sorted(vocabulary), [], []
    for k in range(30):
        table = str.maketrans(LETTERS, "".join(rng.sample(LETTERS, 26)))
        text = " ".join(rng.choices(words, k=rng.randrange(1, 25))) + (" 12, zebra." if k % 3 else "")  # zebra is in no list
        for plain in rng.choices(words, k=k % 4):
            examples.append((k, plain.translate(table), plain))
        questions.append((k, text.translate(table)))
    examples += [(1, "qqq", "abc"), (2, "ab", "xx"), (3, "ab", "a"), (None, "a", "b"), (4, None, "x")]  # contradicting, of unlike lengths, null
    want = {k: searched([(c, p) for i, c, p in examples if i == k and c], q, words) for k, q in questions}
    given = spark.createDataFrame([*questions, (30, None), (None, "abc"), (31, ""), (32, "123 !")], "id int, cipher string").withColumn("_key", F.lit(1))
    listed = spark.createDataFrame([(w,) for w in [*words, *words[:9], None, "", "Upper", "two words"]], "word string")
    found = rules.decipher(spark.createDataFrame(examples, "id int, cipher string, plain string"), given, listed, "id").collect()
    assert {r.id: r.answer for r in found} == want | {30: None, None: None, 31: "", 32: "123 !"} and len(found) == 34
    assert sum("?" not in a for a in want.values()) > 3 and sum("?" in a for a in want.values()) > 3


@pytest.mark.parametrize("part", [1, 1 << 40])
def test_ciphers_by_classes_and_by_letters(spark, monkeypatch, part):
    """All patterns meet the list by their first letters, or by the classes of common sets of letters."""
    monkeypatch.setattr(rules, "COMMON_PART", part)
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("etaoin", k=rng.randrange(1, 6))) for _ in range(300)})
    examples, questions = [], []
    for k in range(12):
        table = str.maketrans(LETTERS, "".join(rng.sample(LETTERS, 26)))
        examples.append((k, "tea".translate(table), "tea"))
        questions.append((k, " ".join(rng.choices(words, k=12)).translate(table)))
    given = spark.createDataFrame(examples, "id int, cipher string, plain string")
    found = rules.decipher(given, spark.createDataFrame(questions, "id int, cipher string"), spark.createDataFrame([(w,) for w in words], "word string"), "id").collect()
    assert {r.id: r.answer for r in found} == {k: searched([(c, p) for i, c, p in examples if i == k], q, words) for k, q in questions}


def test_ciphers_of_empty_tables(spark):
    none, few = spark.createDataFrame([], "id int, cipher string, plain string"), spark.createDataFrame([(1, "abc d")], "id int, cipher string")
    words = spark.createDataFrame([], "word string")
    assert rules.decipher(none, none.select("id", "cipher"), words, "id").count() == 0
    assert rules.decipher(none, few, words, "id").first().answer == "??? ?"


def test_factors(spark):
    shown = spark.createDataFrame([(1, 2.0, 5.0), (1, 4.0, 10.0), (1, 0.0, 3.0), (2, 0.0, 1.0), (None, 1.0, 1.0)], "id int, x double, y double")
    asked = spark.createDataFrame([(1, 3.0), (2, 3.0), (3, 1.0)], "id int, x double")
    assert {r.id: r.answer for r in rules.scalar_ratio(shown, "id", "x", "y", asked).collect()} == {1: 7.5, 2: None, 3: None}


def test_report_of_solved_problems(spark):
    problems = spark.createDataFrame([(1, "determine the result for: 9+4", "5", "x"), (2, "determine the result for: 9+4", "7", "x"), (3, None, "1", None), (4, "nothing", "1", None)], "id int, prompt string, answer string, status string")
    found = rules.solve_report(rules.graded(rules.answers(problems, "equation_guess"), problems.select("id", "answer", "status")), "status").collect()
    assert {r.status: (r.correct, r.total, r.errors, r.timeouts, r.rate) for r in found} == {"x": (1, 2, 0, 0, 50.0), "?": (0, 2, 1, 0, 0.0), "all": (1, 4, 1, 0, 25.0)}
    none = rules.solve_report(spark.createDataFrame([], "status string, outcome string"), "status").collect()
    assert [(r.status, r.total, r.rate) for r in none] == [("all", 0, None)]
