"""The word search's second tier and strides against searches that try every rule."""

import random

from tallyvine.operators import rules

IMAGES = [(name, image.tolist()) for name, image in rules.nested_rules()]


def prompt(examples, query):
    lines = [f"{x:08b} -> {y:08b}" for x, y in examples]
    return "\n".join(["input -> output:", *lines, f"Now, determine the output for: {query:08b}"])


def first_nested(examples, query):
    return next((image[query] for _, image in IMAGES if all(image[x] == y for x, y in examples)), None) if examples else None


def test_nested_rules_are_met_in_the_middle(spark):
    """No, one, few, more than eight examples, repeated and contradicting ones, all outputs 0 or 255."""
    rng, rows = random.Random(3), []
    for k, n in enumerate((0, 1, 2, 3, 8, 9, 10, 17, 10, 4, 4, 3, 9)):
        image = IMAGES[rng.randrange(len(IMAGES))][1]
        xs = [rng.randrange(256) for _ in range(n)]
        examples = [(x, (0 if k == 9 else 255 if k == 10 else image[x])) for x in xs]
        if k == 11:
            examples = [(5, 9), (5, 10), *examples]
        if k == 12:
            examples = [*examples[:8], (examples[8][0], examples[8][1] ^ 1)]  # only the ninth tells
        rows.append((f"p{k}", examples, rng.randrange(256)))
    df = spark.createDataFrame(rows, "id string, examples array<struct<x int, y int>>, query int")
    found = {r.id: r._out for r in rules.nested_answers(df).collect()}
    assert found == {i: out for i, ex, q in rows if (out := first_nested(ex, q)) is not None}
    assert "p0" not in found and "p11" not in found


def test_nested_rules_of_repeated_rows(spark):
    """A prompt that several rows share has one answer."""
    image = IMAGES[60_000][1]
    row = ("p", [(x, image[x]) for x in (3, 77, 130, 201)], 9)
    df = spark.createDataFrame([row, row, row], "id string, examples array<struct<x int, y int>>, query int")
    assert [tuple(r) for r in rules.nested_answers(df).collect()] == [("p", first_nested(*row[1:]))]


def test_bit_search_reaches_the_second_tier(spark):
    first = [image.tolist() for _, image in rules.word_rules()]
    rng = random.Random(5)
    while True:
        image = IMAGES[rng.randrange(len(IMAGES))][1]
        examples = [(x, image[x]) for x in rng.sample(range(256), 10)]
        if not any(all(rule[x] == y for x, y in examples) for rule in first):
            break
    rows = [(prompt(examples, 77), 1), (prompt(examples, 77), 2), (None, 3), (prompt([], 77), 4), ("no bits", 5)]
    found = {r.n: r.answer for r in rules.bit_search(spark.createDataFrame(rows, "prompt string, n int")).collect()}
    out = f"{first_nested(examples, 77):08b}"
    assert found == {1: out, 2: out, 3: None, 4: None, 5: None}
    assert rules.bit_search(spark.createDataFrame([], "prompt string")).count() == 0


def strided(examples, query):
    """The answer by single bits: every stride, every run from either end, every filling."""
    bit = lambda x, j: x >> (7 - j % 8) & 1
    table = [(f, a, b, [[bit(int(image[x]), j) for j in range(8)] for x in range(256)]) for f, a, b, image in rules.stride_rules()]
    holds = [[all(of[x][j] == bit(y, j) for x, y in examples) for j in range(8)] for *_, of in table]
    run = lambda h: next((n for n, ok in enumerate(h) if not ok), 8)
    left, right = [run(h) for h in holds], [run(h[::-1]) for h in holds]
    n, m = max(left), max(right)
    if not examples or n == m == 0:
        return None
    one, two = left.index(n), right.index(m)
    _, a, b, _ = table[one if n >= m else two]
    n, m = (n, min(m, 8 - n)) if n >= m else (min(n, 8 - m), m)
    middle = [k for k, (_, c, d, _) in enumerate(table) if all(i is None or i in (a, b) for i in (c, d)) and all(holds[k][n : 8 - m])]
    by = [one if j < n else two if j >= 8 - m else middle[0] if middle else None for j in range(8)]
    return "".join("1" if k is None else str(table[k][3][query][j]) for j, k in enumerate(by))


def test_strides_against_single_bits(spark):
    rng, rows = random.Random(7), []
    table = [image.tolist() for *_, image in rules.stride_rules()]
    for k in range(40):
        one, two, three = (table[rng.randrange(len(table))] for _ in range(3))
        n, m = rng.randrange(9), rng.randrange(9)
        high, low = 255 - (255 >> n), (1 << m) - 1
        made = lambda x: one[x] & high | two[x] & low & ~high | (three[x] if k % 2 else rng.randrange(256)) & ~high & ~low  # noqa: E731, B023
        examples = [(x, made(x) if k % 8 else rng.randrange(256)) for x in rng.sample(range(256), rng.choice((1, 6, 10)))]
        rows.append((k, examples, rng.randrange(256)))
    rows += [(40, [], 9), (41, [(1, 2), (1, 253), (2, 1)], 9)]
    given = [(k, prompt(ex, q)) for k, ex, q in rows] + [(50, None), (51, "words")]
    found = {r.k: r.answer for r in rules.stride_search(spark.createDataFrame(given, "k int, prompt string")).collect()}
    assert found == {k: strided(ex, q) for k, ex, q in rows} | {50: None, 51: None}
    assert found[40] is None and found[41] is None
