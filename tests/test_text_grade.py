"""Scalar functions: the grader's cases, its traps, boxes, bits and equations."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyvine.functions import grade, text


def values(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


#: Replies by the rule that decides them: bits are equal or wrong, numbers may be off by a hundredth, texts by case.
REPLIES = [
    ("thus \\boxed{0110}", "0110", True), ("thus \\boxed{0111}", "0110", False), ("\\boxed{110}", "0110", False), ("\\boxed{1.0}", "1", False),
    ("\\boxed{200}", "201.5", True), ("\\boxed{200}", "203", False), ("\\boxed{0.000012}", "0.000019", True), ("\\boxed{-7}", "7", False), ("\\boxed{2e3}", "2000", True), ("\\boxed{2_000}", "2000", False), ("\\boxed{7f}", "7.0", False),
    ("\\boxed{Roma}", "rOMA", True), ("\\boxed{ Roma\t}", "Roma", True), ("\\boxed{Rome}", "Roma", False), ("\\boxed{nan}", "nan", False),
    ("no 5, \\boxed{x}, no: \\boxed{8}", "8", True), ("\\boxed{6} or \\boxed{9", "6", True), ("\\boxed{u \\boxed{v} w", "v", True), ("from 12 to 17", "17", True), ("only 9, \\boxed{ }", "9", True), (None, "9", False), ("nothing", "9", False),
]


def test_grader(spark):
    got = values(spark, [(r, t) for r, t, _ in REPLIES], "r string, t string", "r", grade.is_correct(text.extract_answer(F.col("r")), F.col("t")))
    assert got == [(r, want) for r, _, want in REPLIES]


def last_box(t):
    """The content of the box that opens last among those that close."""
    found = None
    for m in re.finditer(r"\\boxed\s*\{", t):
        depth = 1
        for i in range(m.end(), len(t)):
            depth += (t[i] == "{") - (t[i] == "}")
            if not depth:
                found = t[m.end() : i]
                break
    return (found or "").strip() or None


def test_boxes_of_any_depth(spark):
    """Removed whole, the outer one with those inside it; a box that never closes stays, one inside it goes."""
    deep = "{" * 9 + "7" + "}" * 9
    box = "\\boxed{"
    texts = ["x " + box + "\\frac" + deep + "{2}} end", box + deep + "} } { " + box + "a" + box + deep + "}}  ", "open " + box + " then " + box + deep + "} on {", "\\boxed {7} {{{{{}}}}}", "a\\b {{{{}}}} " + box + "{{1}}}", None]
    rows = [(t,) for t in texts]
    got = values(spark, rows, "c string", text.strip_boxed(F.col("c")), text.strip_boxed(F.col("c"), compat=True), text.extract_boxed(F.col("c")))
    assert [g[0] for g in got] == ["x  end", " } {", "open " + box + " then  on {", texts[3], "a\\b {{{{}}}}", None]
    assert got[0][1] == "x " + "}" * 8 + "{2}} end" and got[4][1] == "a\\b {{{{}}}} }}"
    assert [g[2] for g in got] == ["\\frac" + deep + "{2}", deep, deep, "7", "{{1}}", None]


def test_quick_ratio_is_the_library_bound(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("aab", "ab"), ("hello world", "word hello"), ("x", "")]
    got = values(spark, pairs, "a string, b string", text.quick_ratio(F.col("a"), F.col("b")))
    for (a, b), (x,) in zip(pairs, got):
        assert x == pytest.approx(difflib.SequenceMatcher(None, a, b).quick_ratio())


def test_bits_and_equations(spark):
    got = values(spark, [(0b10010110,)], "x int", text.to_bits(F.col("x")), text.reverse_bits(F.col("x")), text.rotl(F.col("x"), 3), text.not8(F.col("x")), text.neighbours(F.col("x"), True), text.hamming(F.col("x"), F.lit(0)))
    x = 0b10010110
    left, right = (x << 1 | x >> 7) & 255, (x >> 1 | x << 7) & 255
    assert got == [("10010110", 0b01101001, (x << 3 | x >> 5) & 255, x ^ 255, left ^ x ^ right, 4)]
    rows = [("12", "-", "30"), ("12", "*", "30"), ("12", "/", "30"), ("12", "#", "30")]
    assert [r[0] for r in values(spark, rows, "a string, o string, b string", text.typographic(F.col("a"), F.col("o"), F.col("b")))] == ["-18", "3012", "360", "18"]
    assert values(spark, [(1994,), (0,), (49,)], "n int", text.roman(F.col("n"))) == [("MCMXCIV",), (None,), ("XLIX",)]
    assert values(spark, [("-12",), ("12",)], "c string", text.signed_reverse(F.col("c"))) == [("-21",), ("21",)]


def test_prompts(spark):
    prompt = "input -> output:\n00000001 -> 00000010\n11110000 -> 11100001\nNow, determine the output for: 10000000"
    got = values(spark, [(prompt,)], "p string", text.bit_examples(F.col("p")), text.bit_query(F.col("p")), text.operands(F.lit("what is 12 and 7?")))[0]
    assert [(e.x, e.y) for e in got[0]] == [(1, 2), (240, 225)] and got[1] == 128 and tuple(got[2]) == (12, 7)
    labels = values(spark, [("eq_deepseek",), ("glm_existing",)], "n string", text.run_label(F.col("n")))
    assert labels == [("deepseek",), ("glm",)]
