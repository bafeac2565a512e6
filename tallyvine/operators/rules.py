"""Rule hypotheses: grammars as dimension tables, relational division over examples, solvers and their harness.

A bit rule is the image of all 256 words. Instead of joining every problem with every rule, problems meet the rules
that map their first example's input to its output (an equality join), and only those are held against the others.
"""

from __future__ import annotations

import itertools
import multiprocessing
import os
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grade import is_correct, num_eq
from ..functions.text import bit_examples, bit_query, equation_examples, equation_query, signed_reverse, to_bits, typographic
from ..sources.scratch import written

_WORDS = np.arange(256, dtype=np.int64)


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << k | x >> (8 - k)) & 255


def _mirror(x: np.ndarray) -> np.ndarray:
    return np.packbits(np.unpackbits(x.astype(np.uint8)[:, None], axis=1)[:, ::-1], axis=1)[:, 0].astype(np.int64)


def bit_terms() -> dict[str, np.ndarray]:
    """Images of the 34 terms of the verifier's grammar."""
    x, left, right = _WORDS, _turn(_WORDS, 1), _turn(_WORDS, 7)
    out = {"x": x, "NOT": x ^ 255, "REV": _mirror(x)}
    for k in range(1, 8):
        out |= {f"ROL{k}": _turn(x, k), f"ROR{k}": _turn(x, 8 - k), f"SHL{k}": x << k & 255, f"SHR{k}": x >> k}
    return out | {"NB_XOR": left ^ right, "NB_XOR3": left ^ x ^ right, "NB_MAJ": left & right | left & x | right & x}


def bit_primitives() -> dict[str, np.ndarray]:
    """Images of the 30 primitives of the word search."""
    terms = bit_terms()
    return {"id": terms["x"]} | {n: terms[n] for k in range(1, 8) for n in (f"ROL{k}", f"ROR{k}", f"SHL{k}", f"SHR{k}")} | {"not": terms["NOT"]}


_COMBINE: dict[str, Callable] = {"AND": np.bitwise_and, "OR": np.bitwise_or, "XOR": np.bitwise_xor}


def verifier_rules() -> list[tuple[str, np.ndarray]]:
    """68 single and 6,936 binary rules, each plain and negated."""
    terms = bit_terms()
    out = []
    for name, image in terms.items():
        out += [(name, image), (f"~{name}", image ^ 255)]
    for (a, x), (b, y), op in itertools.product(terms.items(), terms.items(), _COMBINE):
        out += [(f"{a} {op} {b}", _COMBINE[op](x, y)), (f"~({a} {op} {b})", _COMBINE[op](x, y) ^ 255)]
    return out


def word_rules() -> list[tuple[str, np.ndarray]]:
    """The word search's first tier: primitives, chains of two, combined pairs."""
    prims = bit_primitives()
    out = list(prims.items())
    out += [(f"{b}({a})", y[x]) for (a, x), (b, y) in itertools.product(prims.items(), prims.items())]
    names = list(prims)
    out += [(f"{a} {op} {b}", _COMBINE[op](prims[a], prims[b])) for op in ("XOR", "OR", "AND") for i, a in enumerate(names) for b in names[i:]]
    return out


def nested_rules() -> Iterator[tuple[str, np.ndarray]]:
    """The second tier: a primitive combined with a combined pair, in the order of the search."""
    prims = bit_primitives()
    names = list(prims)
    for op, inner, a in itertools.product(("XOR", "OR", "AND"), ("XOR", "OR", "AND"), names):
        for i, b in enumerate(names):
            for c in names[i:]:
                yield f"{a} {op} ({b} {inner} {c})", _COMBINE[op](prims[a], _COMBINE[inner](prims[b], prims[c]))


def rule_table(spark: SparkSession, rules: list[tuple[str, np.ndarray]]) -> DataFrame:
    """rule, ordinal and image (array of 256) of a grammar: a dimension of fixed size."""
    return spark.createDataFrame(pd.DataFrame({"ordinal": range(len(rules)), "rule": [n for n, _ in rules], "image": [i.astype(np.int32).tolist() for _, i in rules]}), "ordinal int, rule string, image array<int>")


def consistent(problems: DataFrame, rules: DataFrame, key: str = "id", examples: str = "examples") -> DataFrame:
    """problems with each rule that is true of all their examples (array<struct<x, y>>); none without examples.

    Problems meet ordinals alone; images, of a grammar's fixed size, are fetched by ordinal for the pairs that are left.
    """
    entries = rules.select("ordinal", F.posexplode("image").alias("x0", "y0"))
    first = problems.where(F.size(examples) > 0).withColumn("x0", F.get(F.col(examples), F.lit(0))["x"]).withColumn("y0", F.get(F.col(examples), F.lit(0))["y"])
    met = first.join(entries, ["x0", "y0"]).drop("x0", "y0").join(F.broadcast(rules.select("ordinal", "rule", "image")), "ordinal")
    return met.where(F.forall(examples, lambda e: F.get(F.col("image"), e["x"]) == e["y"]))


def verify(problems: DataFrame, rules: DataFrame) -> DataFrame:
    """Per problem (id, examples, query, truth): matching rules, distinct predictions, and whether truth is one."""
    found = consistent(problems, rules).withColumn("prediction", F.get(F.col("image"), F.col("query")))
    per = found.groupBy("id").agg(F.count(F.lit(1)).alias("rules"), F.sort_array(F.collect_set("prediction")).alias("predictions"))
    joined = problems.join(per, "id", "left")
    return joined.select("id", F.coalesce("rules", F.lit(0)).alias("rules"), F.coalesce(F.size("predictions"), F.lit(0)).alias("n_predictions"), F.coalesce(F.array_contains("predictions", F.col("truth")), F.lit(False)).alias("truth_predicted"))


def verify_report(verified: DataFrame) -> DataFrame:
    c = F.col
    return verified.agg(F.count(F.lit(1)).alias("problems"), F.count_if(c("rules") > 0).alias("rule_found"), F.count_if(c("rules") == 0).alias("no_rule"), F.count_if(c("n_predictions") > 1).alias("ambiguous"), F.count_if("truth_predicted").alias("truth_predicted"), F.count_if((c("rules") > 0) & ~c("truth_predicted")).alias("mismatch"))


# operator family of two-digit equations

#: Names, and their order, which decides between hypotheses.
_ARITHMETIC = ("concat", "revconcat", "add", "absdiff", "negabsdiff", "sub", "revsub", "mul", "mul+1", "mul-1", "add+1", "add-1", "sub+1", "sub-1", "maxmodmin", "div", "mod", "revdiv", "revmod", "digabsdiff", "digaddmod10", "digsubmod10", "crossmul", "crossmulrev", "digmul", "digmulrev", "digsumdiff", "digsumsum", "digproddiff", "digprodsum", "det", "absdet")
#: Declared but never searched: they have no value for zero operands.
GUARDED = ("maxmodmin", "div", "mod", "revdiv", "revmod")


def arithmetic(a: Column, b: Column) -> dict[str, Column]:
    """All 32 operations on two operands of digits, as texts; null on a zero divisor and where there are no digits."""
    x, y = a.try_cast("long"), b.try_cast("long")
    p, q, r, s = (F.substring(c, k, 1).try_cast("long") for c in (a, b) for k in (1, 2))
    ten = lambda v: F.pmod(v, F.lit(10))
    floor = lambda n, d: F.when(d != 0, F.floor(n / d).cast("long"))
    rest = lambda n, d: F.when(d != 0, F.pmod(n, d))
    pair = lambda u, v: F.concat(u.cast("string"), v.cast("string"))
    text = lambda v: v.cast("string")
    values = (F.concat(a, b), F.concat(b, a), text(x + y), text(F.abs(x - y)), text(-F.abs(x - y)), text(x - y), text(y - x), text(x * y), text(x * y + 1), text(x * y - 1), text(x + y + 1), text(x + y - 1), text(x - y + 1), text(x - y - 1), text(rest(F.greatest(x, y), F.least(x, y))), text(floor(x, y)), text(rest(x, y)), text(floor(y, x)), text(rest(y, x)), pair(F.abs(p - r), F.abs(q - s)), pair(ten(p + r), ten(q + s)), pair(ten(p - r), ten(q - s)), text(p * r + q * s), text(p * s + q * r), pair(p * r, q * s), pair(p * s, q * r), text(p + q - r - s), text(p + q + r + s), text(p * q - r * s), text(p * q + r * s), text(p * s - q * r), text(F.abs(p * s - q * r)))
    return dict(zip(_ARITHMETIC, values))


def _bases(a: Column, b: Column, guarded: bool) -> Column:
    """Results of all operations on both orders of the operands."""
    plain, swapped = arithmetic(a, b), arithmetic(b, a)
    return F.array(*[made[name] for name in _ARITHMETIC if guarded or name not in GUARDED for made in (plain, swapped)])


def _hypothesis(bases: Column, op: Column, h: Column) -> Column:
    """The result of hypothesis h: base h div 4, reversed if bit 1 is set, the operator in front if bit 0 is."""
    base = F.get(bases, F.shiftright(h, 2))
    value = F.when(h.bitwiseAND(F.lit(2)) > 0, signed_reverse(base)).otherwise(base)
    return F.when(h.bitwiseAND(F.lit(1)) > 0, F.concat(op, value)).otherwise(value)


def equation_search(problems: DataFrame, prompt: str = "prompt", guarded: bool = False) -> DataFrame:
    """problems with the answer of the first of 216 hypotheses that all examples obey (those with the question's
    operator if there are any) and that has a value for the question. guarded: search the five guarded operations as
    well, 256 hypotheses. Each row is searched by itself, inside arrays; null prompts get no answer."""
    count = (len(_ARITHMETIC) - (0 if guarded else len(GUARDED))) * 8
    rows = problems.withColumn("_all", equation_examples(F.col(prompt))).withColumn("_q", equation_query(F.col(prompt)))
    same = F.filter("_all", lambda e: e["op"] == F.col("_q.op"))
    rows = rows.withColumn("_used", F.when(F.size(same) > 0, same).otherwise(F.col("_all")))
    # lambdas keep the many expressions out of the generated code, whose size is limited
    made = lambda es: F.transform(es, lambda e: F.struct(_bases(e["a"], e["b"], guarded).alias("bases"), e["op"].alias("op"), e["out"].alias("out")))
    asked = F.array(F.struct("_q.a", "_q.op", "_q.b", F.lit("").alias("out")))
    rows = rows.withColumn("_made", made(F.col("_used"))).withColumn("_asked", F.get(made(asked), F.lit(0)))
    obeyed = lambda h: F.forall("_made", lambda e: F.coalesce(_hypothesis(e["bases"], e["op"], h) == e["out"], F.lit(False)))
    found = F.filter(F.sequence(F.lit(0), F.lit(count - 1)), lambda h: obeyed(h) & _hypothesis(F.col("_asked.bases"), F.col("_asked.op"), h).isNotNull())
    first = F.get(found, F.lit(0))
    answer = F.when((F.col("_q.a") != "") & (F.size("_used") > 0), F.element_at(F.transform(F.array(first), lambda h: _hypothesis(F.col("_asked.bases"), F.col("_asked.op"), h)), 1))
    return rows.withColumn("answer", answer).drop("_all", "_q", "_used", "_made", "_asked")


def typographic_answer(prompt: Column) -> Column:
    """The rule that an unseen operator means what its sign suggests."""
    q = equation_query(prompt)
    return F.when(q["a"] != "", typographic(q["a"], q["op"], q["b"]))


def null_answer(prompt: Column) -> Column:
    return F.lit(None).cast("string")


#: Solvers that are expressions of the prompt.
EXPRESSIONS: dict[str, Callable[[Column], Column]] = {"baseline_null": null_answer, "equation_guess": typographic_answer}


#: Places of the combiners in the order of the word search.
_XOR, _OR, _AND = range(3)
#: Examples of eight-bit words that a long holds.
_PACKED = 8


def _combined(op: Column, a: Column, b: Column) -> Column:
    return F.when(op == _XOR, a.bitwiseXOR(b)).when(op == _OR, a.bitwiseOR(b)).otherwise(a.bitwiseAND(b))


def _word_table(spark: SparkSession, images: list[np.ndarray]) -> DataFrame:
    """x, v: the values of all images at each of the 256 words."""
    return F.broadcast(spark.createDataFrame([(x, [int(i[x]) for i in images]) for x in range(256)], "x int, v array<int>"))


def nested_answers(rows: DataFrame) -> DataFrame:
    """id, _out: what the first rule `a op (b inner c)` of the word search that all examples obey says of the question,
    for rows of (id, examples, query); rows without examples or without such a rule have none. Repeated rows are one.

    The two halves meet in the middle. A primitive's values on the first eight examples are one long; pairs (b inner c)
    are built once per row. For XOR the outer primitive says which long the pair must be, an equality join; for OR and
    AND only outer primitives whose bits all lie in the outputs', or hold them, can do. Pairs that meet are then tested
    on all examples. A row has 1,395 pairs, whatever the table.
    """
    spark, images = rows.sparkSession, list(bit_primitives().values())
    n, words = len(images), _word_table(rows.sparkSession, images)
    rows = rows.select("id", "examples", "query").distinct().withColumn("h", F.unhex(F.md5(F.col("id").cast("binary"))))
    tests = rows.select("h", F.posexplode("examples").alias("at", "_e")).select("h", "at", F.col("_e.x").alias("x"), F.col("_e.y").alias("y"))
    packed = lambda c: F.bit_or(F.call_function("shiftleft", c.cast("long"), F.col("at") * 8))
    longs = tests.where(F.col("at") < _PACKED).join(words, "x").groupBy("h").agg(packed(F.col("y")).alias("y"), *[packed(F.get("v", F.lit(k))).alias(f"p{k}") for k in range(n)])
    longs = longs.select("h", "y", F.array(*[f"p{k}" for k in range(n)]).alias("p"))
    places = [(k, b, c) for k, (b, c) in enumerate(itertools.combinations_with_replacement(range(n), 2))]
    pairs = F.broadcast(spark.createDataFrame(places, "pair int, b int, c int"))
    inner = longs.select("h", "p", F.explode(F.sequence(F.lit(0), F.lit(len(places) - 1))).alias("pair")).join(pairs, "pair").select("h", "pair", "b", "c", F.get("p", F.col("b")).alias("pb"), F.get("p", F.col("c")).alias("pc"), F.explode(F.array(*map(F.lit, (_XOR, _OR, _AND)))).alias("inner"))
    inner = inner.select("h", "pair", "b", "c", "inner", _combined(F.col("inner"), F.col("pb"), F.col("pc")).alias("value"))
    outer = longs.select("h", "y", F.posexplode("p").alias("a", "pa"))
    by_xor = outer.select("h", "a", F.lit(_XOR).alias("op"), F.col("y").bitwiseXOR(F.col("pa")).alias("value")).join(inner, ["h", "value"])
    some = outer.where(F.col("pa").bitwiseAND(F.bitwise_not("y")) == 0).withColumn("op", F.lit(_OR)).unionByName(outer.where(F.col("y").bitwiseAND(F.bitwise_not("pa")) == 0).withColumn("op", F.lit(_AND)))
    others = some.join(inner, "h").where(_combined(F.col("op"), F.col("pa"), F.col("value")) == F.col("y"))
    names = ("h", "op", "inner", "a", "b", "c", "pair")
    met = by_xor.select(*names).unionByName(others.select(*names)).withColumn("ordinal", ((F.col("op") * 3 + F.col("inner")) * n + F.col("a")) * len(places) + F.col("pair"))
    asked = rows.select("h", F.col("query").cast("int").alias("x"), F.lit(None).cast("int").alias("y"))
    shown = tests.select("h", "x", "y").unionByName(asked).join(words, "x").drop("x")
    made = _combined(F.col("op"), F.get("v", F.col("a")), _combined(F.col("inner"), F.get("v", F.col("b")), F.get("v", F.col("c"))))
    tested = met.join(shown, "h").select("h", "ordinal", "y", made.alias("made")).groupBy("h", "ordinal").agg(F.bool_and(F.coalesce(F.col("made") == F.col("y"), F.lit(True))).alias("fits"), F.max(F.when(F.col("y").isNull(), F.col("made"))).alias("guess"))
    return tested.where("fits").groupBy("h").agg(F.min_by("guess", "ordinal").alias("_out")).join(rows.select("h", "id"), "h").select("id", "_out")


def bit_search(problems: DataFrame, prompt: str = "prompt") -> DataFrame:
    """problems with the answer of the word search: a vote of all first-tier rules (ties to the earliest), else the
    first nested rule. Each prompt is searched once; the nested tier sees only unresolved ones. Null prompts get none."""
    spark = problems.sparkSession
    rows = problems.select(F.col(prompt).alias("id")).where("id is not null").distinct().withColumn("examples", bit_examples(F.col("id"))).withColumn("query", bit_query(F.col("id"))).where("query is not null")
    found = consistent(rows, rule_table(spark, word_rules())).withColumn("_out", F.get(F.col("image"), F.col("query")))
    votes = found.groupBy("id", "_out").agg(F.count(F.lit(1)).alias("_n"), F.min("ordinal").alias("_first"))
    best = votes.groupBy("id").agg(F.max_by("_out", F.struct("_n", -F.col("_first"))).alias("_out"))
    left = rows.join(best, "id", "left_anti")

    both = best.select("id", "_out").unionByName(nested_answers(left))
    answers = both.select(F.col("id").alias("_prompt"), to_bits(F.col("_out")).alias("answer"))
    return problems.join(answers, F.col(prompt) == F.col("_prompt"), "left").drop("_prompt")


#: The order in which a family common to all columns is preferred, and the order in which rules of all
#: families decide a tie of one column.
FAMILIES = ("XOR", "AND", "OR", "XOR-NOT", "AND-NOT", "OR-NOT", "NOT", "I", "0", "1")
TIE_ORDER = ("I", "NOT", "0", "1", "AND", "OR", "XOR", "AND-NOT", "OR-NOT", "XOR-NOT")


def _bit_family(family: str, bits: np.ndarray) -> np.ndarray:
    """Values of all rules of a family (one column each) for rows of eight bits."""
    if family in "01":
        return np.full((len(bits), 1), int(family), np.uint8)
    if family == "I":
        return bits
    if family == "NOT":
        return 1 - bits
    op, _, inverted = family.partition("-")
    other = 1 - bits if inverted else bits
    return _COMBINE[op](bits[:, :, None], other[:, None, :]).reshape(len(bits), 64)


def family_table(spark: SparkSession) -> DataFrame:
    """word, values: for each of the 256 words and each family a bitmap of what its rules (64, 8 or 1) give, the first
    rule in the lowest bit."""
    words = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    packed = [(made.astype(np.uint64) << np.arange(made.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64) for made in (_bit_family(f, words) for f in FAMILIES)]
    return spark.createDataFrame([(x, [int(v[x]) for v in packed]) for x in range(256)], "word int, values array<long>")


def bit_columns(problems: DataFrame, prompt: str = "prompt") -> DataFrame:
    """problems with the answer that rules of single output bits give, each over one or two input bits.

    Each example says which rules of a family are right about an output bit: the family's bitmap for its input, or the
    bitmap's complement. bit_and over the examples leaves the rules that fit. The first family that fits every output
    bit decides all of them, else all families vote on each; a vote counts the fitting rules that give 1 for the
    question, a tie goes to the first of them. Null prompts, prompts without examples or question, and those with an
    output bit that no rule fits get no answer.
    """
    table = F.broadcast(family_table(problems.sparkSession))  # 256 rows
    rows = problems.select(F.col(prompt).alias("_prompt")).where("_prompt is not null").distinct().withColumn("_query", bit_query(F.col("_prompt"))).where("_query is not null")
    shown = rows.select("_prompt", F.explode(bit_examples(F.col("_prompt"))).alias("_e")).join(table, F.col("_e.x") == F.col("word"))
    shown = shown.select("_prompt", F.col("_e.y").alias("_y"), "values", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_j"))
    right = F.call_function("shiftright", F.col("_y"), 7 - F.col("_j")).bitwiseAND(F.lit(1)) == 1
    width = {"I": 255, "NOT": 255, "0": 1, "1": 1}
    fits = [F.bit_and(F.when(right, F.get("values", F.lit(k))).otherwise(F.bitwise_not(F.get("values", F.lit(k))).bitwiseAND(F.lit(width.get(f, -1)).cast("long")))) for k, f in enumerate(FAMILIES)]
    columns = shown.groupBy("_prompt", "_j").agg(*[c.alias(f"f{k}") for k, c in enumerate(fits)]).select("_prompt", "_j", F.array(*[f"f{k}" for k in range(len(fits))]).alias("fits"))
    per = columns.groupBy("_prompt").agg(F.sort_array(F.collect_list(F.struct("_j", "fits"))).alias("_columns"))  # eight each
    per = per.join(rows, "_prompt").join(table, F.col("_query") == F.col("word"))

    common = F.get(F.filter(F.sequence(F.lit(0), F.lit(len(FAMILIES) - 1)), lambda f: F.forall("_columns", lambda c: F.get(c["fits"], f) != 0)), F.lit(0))
    per = per.withColumn("_by", F.coalesce(F.transform(F.array(common), lambda f: F.when(f.isNotNull(), F.array(f)))[0], F.array(*[F.lit(FAMILIES.index(f)) for f in TIE_ORDER])))
    per = per.where(F.forall("_columns", lambda c: F.exists(c["fits"], lambda v: v != 0)))

    def bit(column: Column) -> Column:
        of = F.filter(F.transform("_by", lambda f: F.struct(F.get(column["fits"], f).alias("fit"), F.get(F.col("values"), f).alias("value"))), lambda x: x["fit"] != 0)
        count = lambda g: F.aggregate(of, F.lit(0), lambda n, x: n + F.bit_count(g(x)))
        lead = count(lambda x: x["fit"].bitwiseAND(x["value"])) * 2 - count(lambda x: x["fit"])
        first = F.get(F.transform(F.slice(of, 1, 1), lambda x: F.substring(F.reverse(F.lpad(F.bin(x["value"]), 64, "0")), F.locate("1", F.reverse(F.bin(x["fit"]))), F.lit(1))), F.lit(0))
        return F.when(lead > 0, "1").when(lead < 0, "0").otherwise(first)

    answers = per.select("_prompt", F.array_join(F.transform("_columns", bit), "").alias("answer"))
    return problems.join(answers, F.col(prompt) == F.col("_prompt"), "left").drop("_prompt")


#: The families of strides, in the order that decides ties.
STRIDES = ("I", "NOT", "0", "1", "AND", "OR", "XOR", "AND-NOT", "OR-NOT", "XOR-NOT")


def stride_rules() -> list[tuple[str, int | None, int | None, np.ndarray]]:
    """Family, first and second input bit for output bit 0, and image of all 354 strides: output bit j is made of the
    input bits j places further (mod 8), so a stride's image is that of the word turned."""
    out: list[tuple[str, int | None, int | None, np.ndarray]] = []
    for family in STRIDES:
        op, _, inverted = family.partition("-")
        if family in "01":
            out.append((family, None, None, np.full(256, 255 * int(family))))
        elif family in ("I", "NOT"):
            out += [(family, a, None, _turn(_WORDS, a) ^ (255 if family == "NOT" else 0)) for a in range(8)]
        else:
            out += [(family, a, b, _COMBINE[op](_turn(_WORDS, a), _turn(_WORDS, b) ^ (255 if inverted else 0))) for a, b in itertools.permutations(range(8), 2)]
    return out


def stride_search(problems: DataFrame, prompt: str = "prompt") -> DataFrame:
    """problems with the answer that strides give: rules of one or two input bits that move on by one with each output bit.

    The strides that hold on the longest runs of output bits from the left and from the right end decide these bits; a
    tie goes to the first stride. Where the runs overlap the longer one (the left of equals) keeps its bits. Bits between
    them go to the first stride over the input bits of the longer run, in any family and order, that holds on all of
    them, and are 1 if none does. Prompts without examples or question, and those of which no stride holds at either
    end, get no answer; null prompts neither.

    Where a stride holds on an example is a mask of eight bits; bit_and over the examples leaves its runs, and their
    lengths at the ends are bit counts.
    """
    spark, rules = problems.sparkSession, stride_rules()
    words = _word_table(spark, [image for *_, image in rules])
    among = lambda a, b: [k for k, (_, c, d, _) in enumerate(rules) if {c, d} - {None} <= {a, b} - {None}]
    near = F.broadcast(spark.createDataFrame([(k, among(a, b)) for k, (_, a, b, _) in enumerate(rules)], "lead int, near array<int>"))
    rows = problems.select(F.col(prompt).alias("_prompt")).where("_prompt is not null").distinct().withColumn("query", bit_query(F.col("_prompt")).cast("int")).where("query is not null")
    shown = rows.select("_prompt", F.explode(bit_examples(F.col("_prompt"))).alias("_e")).select("_prompt", F.col("_e.x").alias("x"), F.col("_e.y").alias("y")).join(words, "x")
    masks = shown.select("_prompt", "y", F.posexplode("v").alias("k", "made")).groupBy("_prompt", "k").agg(F.bit_and(255 - F.col("made").bitwiseXOR(F.col("y"))).alias("mask"))
    missed = 255 - F.col("mask")
    ends = masks.withColumn("left", F.when(missed == 0, 8).otherwise(8 - F.length(F.bin(missed)))).withColumn("right", F.when(missed == 0, 8).otherwise(F.bit_count(missed.bitwiseAND(-missed) - 1)))
    best = lambda n: F.max(F.struct(F.col(n).alias("n"), (-F.col("k")).alias("k"))).alias(n)
    per = ends.groupBy("_prompt").agg(best("left"), best("right"), F.sort_array(F.collect_list(F.struct("k", "mask"))).alias("masks"))  # 354 each
    by_left = F.col("left.n") >= F.col("right.n")
    per = per.where("left.n > 0 or right.n > 0").withColumn("lead", F.when(by_left, -F.col("left.k")).otherwise(-F.col("right.k"))).join(near, "lead").join(rows, "_prompt").join(words, F.col("query") == F.col("x"))
    n_left = F.when(by_left, F.col("left.n")).otherwise(F.least(F.col("left.n"), 8 - F.col("right.n")))
    n_right = F.when(by_left, F.least(F.col("right.n"), 8 - F.col("left.n"))).otherwise(F.col("right.n"))
    per = per.withColumn("from_left", 255 - F.call_function("shiftright", F.lit(255), n_left)).withColumn("from_right", F.call_function("shiftleft", F.lit(1), n_right) - 1)
    per = per.withColumn("between", 255 - F.col("from_left") - F.col("from_right"))
    fit = F.get(F.filter("near", lambda k: F.get(F.col("masks"), k)["mask"].bitwiseAND(F.col("between")) == F.col("between")), F.lit(0))
    per = per.withColumn("fit", fit)
    bits = lambda value, mask: value.bitwiseAND(F.col(mask))
    out = bits(F.get("v", -F.col("left.k")), "from_left") + bits(F.get("v", -F.col("right.k")), "from_right") + bits(F.when(F.col("fit").isNull(), 255).otherwise(F.get("v", F.col("fit"))), "between")
    answers = per.select("_prompt", to_bits(out).alias("answer"))
    return problems.join(answers, F.col(prompt) == F.col("_prompt"), "left").drop("_prompt")


_SYMBOL_OPS: dict[str, Callable] = {"add": np.add, "sub": np.subtract, "absdiff": lambda a, b: np.abs(a - b), "mul": np.multiply}
#: Rows of a relation that are joined at once.
_SYMBOL_ROWS = 200_000


def _digits(value: np.ndarray, size: int) -> np.ndarray:
    """Decimal digits, highest first, of numbers below 10**size."""
    return value[:, None] // 10 ** np.arange(size - 1, -1, -1) % 10


def _size(value: np.ndarray) -> np.ndarray:
    return np.searchsorted([10, 100, 1000, 10_000], value, "right") + 1


def _example_relation(op: Callable, left: str, right: str) -> tuple[list[str], np.ndarray]:
    """All digits of the symbols of one example that make it true, a column per symbol."""
    known = list(dict.fromkeys(left))
    grid = np.indices((10,) * len(known)).reshape(len(known), -1).T
    a, b, c, d = (grid[:, known.index(s)] for s in left)
    value = op(a * 10 + b, c * 10 + d)
    symbols = known + [s for s in dict.fromkeys(right) if s not in known]
    found = []
    for sign, body in ((1, right), (-1, right[1:] if right[:1] == "-" else "")):
        rows = np.flatnonzero((value * sign > 0 if sign < 0 else value >= 0) & (_size(np.abs(value)) == len(body)))
        if not body or not len(rows):
            continue
        made = np.full((len(rows), len(symbols)), -1)
        made[:, : len(known)] = grid[rows]
        fits = np.ones(len(rows), bool)
        for s, digit in zip(body, _digits(np.abs(value[rows]), len(body)).T):
            at = symbols.index(s)
            fits &= (made[:, at] < 0) | (made[:, at] == digit)
            made[:, at] = digit
        made = made[fits]
        for at in np.flatnonzero(np.any(made < 0, axis=0)) if len(made) else ():  # a sign that no digit needs
            made = np.repeat(made, 10, axis=0)
            made[:, at] = np.tile(np.arange(10), len(made) // 10)
        found.append(made)
    return symbols, np.concatenate(found) if found else np.zeros((0, len(symbols)), int)


def _joined(one: tuple[list[str], np.ndarray], two: tuple[list[str], np.ndarray]) -> tuple[list[str], np.ndarray]:
    """The natural join of two relations."""
    shared = [s for s in two[0] if s in one[0]]
    new = [k for k, s in enumerate(two[0]) if s not in one[0]]
    code = lambda r: r[1][:, [r[0].index(s) for s in shared]] @ 10 ** np.arange(len(shared)) if shared else np.zeros(len(r[1]), int)
    a, b = code(one), code(two)
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = high - low
    at = np.arange(int(n.sum())) + np.repeat(low - np.cumsum(n) + n, n)
    return one[0] + [two[0][k] for k in new], np.concatenate([np.repeat(one[1], n, axis=0), two[1][order[at]][:, new]], axis=1)


def _symbol_answers(op: Callable, parts: list[tuple[str, str]], query: str, symbols: list[str], deadline: float) -> set[str]:
    """Answers of all consistent digits, at least two of them if there are more than one.

    A digit is written by the first symbol that stands for it, so a symbol on a right side differs from all before it.
    Examples' relations are joined, the smallest first, in pieces.
    """
    written = {s for _, right in parts for s in right}
    relations = sorted((_example_relation(op, left, right) for left, right in parts), key=lambda r: len(r[1]))
    relations += [([s], np.arange(10)[:, None]) for s in symbols if not any(s in r[0] for r in relations)]
    answers: set[str] = set()

    def first_written(relation: tuple[list[str], np.ndarray]) -> tuple[list[str], np.ndarray]:
        names, rows = relation
        ok = np.ones(len(rows), bool)
        for k, s in enumerate(names):
            if s in written:
                for j, t in enumerate(names):
                    if symbols.index(t) < symbols.index(s):
                        ok &= rows[:, j] != rows[:, k]
        return names, rows[ok]

    def answered(names: list[str], rows: np.ndarray) -> None:
        digit = rows[:, [names.index(s) for s in symbols]]
        a, b, c, d = (digit[:, symbols.index(s)] for s in query)
        value = op(a * 10 + b, c * 10 + d)
        writer = np.full((len(rows), 10), -1)
        for k in range(len(symbols) - 1, -1, -1):
            writer[np.arange(len(rows)), digit[:, k]] = k
        for sign, size in itertools.product((1, -1), range(1, 5)):
            some = np.flatnonzero(((value < 0) == (sign < 0)) & (_size(np.abs(value)) == size))
            made = writer[some[:, None], _digits(np.abs(value[some]), size)]
            answers.update("-" * (sign < 0) + "".join(symbols[k] for k in row) for row in np.unique(made[(made >= 0).all(axis=1)], axis=0)[:2])

    def go_on(relation: tuple[list[str], np.ndarray], k: int) -> None:
        if time.monotonic() > deadline:
            raise TimeoutError
        names, rows = first_written(relation)
        for a in range(0, len(rows), _SYMBOL_ROWS if k == len(relations) else 2000):
            if len(answers) > 1:
                return
            if k == len(relations):
                answered(names, rows[a : a + _SYMBOL_ROWS])
            else:
                go_on(_joined((names, rows[a : a + 2000]), relations[k]), k + 1)

    go_on(([], np.zeros((1, 0), int)), 0)
    return answers


def solve_symbols(examples: list[tuple[str, str]], query: str, deadline: float = float("inf")) -> str | None:
    """Symbols stand for digits, several perhaps for one: the only answer that all consistent digits give under one of
    four operations, else None. A result is written with the first symbol, in order of appearance, of each digit.

    examples: five-character left sides (operator in the middle) and right sides, where a minus may be a sign. Puzzles
    of more than 11 symbols are left alone. All solutions count. Raises TimeoutError after the deadline.
    """
    if not examples or len(query) != 5:
        return None
    for how in (lambda t: t[:2] + t[3:], lambda t: t[3:] + t[:2]):
        if all(how(left) == right for left, right in examples):
            return how(query)
    parts, asked = [(left[:2] + left[3:], right) for left, right in examples], query[:2] + query[3:]
    symbols = list(dict.fromkeys("".join(left + right for left, right in parts) + asked))
    if len(symbols) > 11:
        return None
    answers: set[str] = set()
    for op in _SYMBOL_OPS.values():
        answers |= _symbol_answers(op, parts, asked, symbols, deadline)
        if len(answers) > 1:
            return None
    return next(iter(answers), None)


class _Apart:
    """A solver in a process of its own, which is killed when it is late."""

    def __init__(self, solve: Callable[[str], str | None]) -> None:
        self.solve, self.process, self.pipe = solve, None, None

    def _serve(self, pipe) -> None:
        while True:
            try:
                prompt = pipe.recv()
            except EOFError:
                os._exit(0)
            try:
                answer = self.solve(prompt)
                pipe.send((None if answer is None else str(answer), "ok"))
            except TimeoutError:
                pipe.send((None, "timeout"))
            except Exception:
                pipe.send((None, "error"))

    def ask(self, prompt: str | None, seconds: float) -> tuple[str | None, str]:
        if self.process is None:
            context = multiprocessing.get_context("fork")
            self.pipe, other = context.Pipe()
            self.process = context.Process(target=self._serve, args=(other,), daemon=True)
            self.process.start()
            other.close()
        self.pipe.send(prompt)
        try:
            if self.pipe.poll(seconds):
                return self.pipe.recv()
            outcome = None, "timeout"
        except EOFError:  # the solver ended its process
            outcome = None, "error"
        self.stop()
        return outcome

    def stop(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
            self.process = None


#: Solvers by name: expressions of the prompt, and Python functions of it.
SOLVERS: dict[str, Callable[[str], str | None]] = {}


def solver(name: str) -> Callable:
    """Registers a Python solver."""

    def keep(solve: Callable[[str], str | None]) -> Callable[[str], str | None]:
        SOLVERS[name] = solve
        return solve

    return keep


@solver("symbols")
def solve_symbol_prompt(prompt: str) -> str | None:
    body = prompt.rsplit("examples:", 1)[-1].split("Now,")[0]
    sides = [[s.strip() for s in line.split(" = ")] for line in body.split("\n") if line.count(" = ") == 1]
    return solve_symbols([(a, b) for a, b in sides if len(a) == 5], prompt.rsplit("determine the result for:", 1)[-1].strip())


def answers(problems: DataFrame, name: str, seconds: float = 5.0, key: str = "id") -> DataFrame:
    """key, answer, outcome of a registered solver; null prompts are errors."""
    if name in EXPRESSIONS:
        return problems.select(key, EXPRESSIONS[name](F.col("prompt")).alias("answer"), F.when(F.col("prompt").isNull(), "error").otherwise("ok").alias("outcome"))
    return run_solver(problems, SOLVERS[name], seconds, key)


def run_solver(problems: DataFrame, solve: Callable[[str], str | None], seconds: float = 5.0, key: str = "id") -> DataFrame:
    """key, answer, outcome (ok, error, timeout) of a Python solver that sees prompts alone.

    The solver runs in a process beside each task; one that does not answer in time is killed, so it can neither hold a
    task nor end it. Each prompt is solved once, whatever the rows that have it, and has one outcome. Null prompts reach
    no solver and are errors.
    """

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apart = _Apart(solve)
        try:
            for frame in frames:
                yield pd.DataFrame([(p, *apart.ask(p, seconds)) for p in frame["prompt"]], columns=["_prompt", "answer", "outcome"])
        finally:
            apart.stop()

    # so many tasks are not merged by the size of their rows, of which each may take `seconds`
    asked = problems.select("prompt").where("prompt is not null").distinct().repartition(problems.sparkSession.sparkContext.defaultParallelism)
    solved = written(asked.mapInPandas(rows, "_prompt string, answer string, outcome string"), "solved")
    joined = problems.select(key, "prompt").join(solved, F.col("prompt") == F.col("_prompt"), "left")
    return joined.select(key, "answer", F.coalesce("outcome", F.lit("error")).alias("outcome"))


def graded(solved: DataFrame, truths: DataFrame, key: str = "id") -> DataFrame:
    """Solver results with outcome ok or wrong by the raw answer (not one extracted from it)."""
    joined = truths.join(solved.withColumnRenamed("answer", "given"), key, "left")
    good = is_correct(F.col("given"), F.col("answer")) | num_eq(F.col("given"), F.col("answer"))
    return joined.withColumn("outcome", F.when(F.col("outcome").isin("error", "timeout"), F.col("outcome")).when(good, "ok").otherwise("wrong"))


def scalar_ratio(examples: DataFrame, key: str, x: str, y: str, query: DataFrame) -> DataFrame:
    """One factor per problem, the mean of y over x of its examples, applied to its query value."""
    factor = examples.where(F.col(x) != 0).groupBy(key).agg(F.avg(F.col(y) / F.col(x)).alias("factor"))
    return query.join(factor, key, "left").withColumn("answer", F.bround(F.col("factor") * F.col("x"), 2))


def substitution(pairs: DataFrame, key: str, cipher: str, plain: str) -> DataFrame:
    """key with map cipher character -> plain character from aligned example texts; characters that stand for more
    than one are left out."""
    at = pairs.where(F.length(cipher) == F.length(plain)).select(key, F.posexplode(F.split(cipher, "")).alias("i", "c"), plain).withColumn("p", F.substring(F.col(plain), F.col("i") + 1, F.lit(1)))
    one = at.where("c <> ''").groupBy(key, "c").agg(F.min("p").alias("p"), F.count_distinct("p").alias("n")).where("n = 1")
    return one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("c", "p"))).alias("mapping"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _shape(w: Column) -> Column:
    """Which letters of a word are equal: for each the place where it first stands."""
    return F.array_join(F.transform(F.regexp_extract_all(w, F.lit("(.)"), 1), lambda c: F.call_function("instr", w, c)), ",")


def _seen(w: Column, known: Column, stands_for: Column) -> Column:
    """A word with its known letters in upper case, as what they stand for, and a mark for each other one."""
    return F.regexp_replace(F.call_function("translate", w, known, F.upper(stands_for)), "[a-z]", "_")


#: A set of letters with a COMMON_PART-th as many patterns as the list has words has the whole list classed for it.
COMMON_PART = 400


def _places(word: Column) -> Column:
    """The keys by which patterns may ask for a word: no letter, each letter, and each two letters, in their places."""
    one = F.transform(F.regexp_extract_all(word, F.lit("(.)"), 1), lambda c, i: F.concat(F.lpad((i + 1).cast("string"), 3, "0"), F.upper(c)))
    two = F.flatten(F.transform(one, lambda a: F.transform(F.filter(one, lambda b: b > a), lambda b: F.concat(a, b))))
    return F.flatten(F.array(F.array(F.lit("")), one, two))


def _place(seen: Column) -> Column:
    """The key by which a pattern asks for words: its first two known letters in their places."""
    known = F.filter(F.transform(F.regexp_extract_all(seen, F.lit("(.)"), 1), lambda c, i: F.concat(F.lpad((i + 1).cast("string"), 3, "0"), c)), lambda x: ~F.endswith(x, F.lit("_")))
    return F.array_join(F.slice(known, 1, 2), "")


def decipher(examples: DataFrame, questions: DataFrame, words: DataFrame, key: str, rounds: int = len(_LETTERS)) -> DataFrame:
    """questions (key, cipher) with the answer in plain letters, `?` where a letter stays unknown.

    Letters a to z are enciphered one for one, all else stands for itself. examples (key, cipher, plain) show letters;
    the others come from words (word): a word of the question that one word of the list fits, by its shape, its known
    letters and the plain letters that are taken, shows its letters. That is repeated until no question learns a letter,
    which is at most once for each letter. Letters on which examples or such words disagree are left out.

    All that matters of a word of a question is its pattern: its shape, its known letters and the plain letters that are
    taken. Where many patterns have one set of taken letters (those of COMMON_PART of the list or more), the list is
    classed by its words' own patterns under that set and the two are met by equality. Other patterns meet the list by
    shape and their first two known letters in their places (one or none if there are no more). A question that learned
    nothing in a round learns nothing later and is set aside. Null ids and texts have no answer; questions with one id
    share what they learn; the list's repeated words count once.
    """
    kind = dict(questions.dtypes)[key]
    asked = questions.where(F.col(key).isNotNull() & F.col("cipher").isNotNull())
    tokens = asked.select(key, F.explode(F.regexp_extract_all("cipher", F.lit("([a-z]+)"), 1)).alias("w")).distinct()
    tokens = written(tokens.withColumn("shape", _shape(F.col("w"))), "tokens")
    listed = written(words.where(F.col("word").rlike("^[a-z]+$")).select("word").distinct().repartition(words.sparkSession.sparkContext.defaultParallelism).withColumn("shape", _shape(F.col("word"))), "listed")
    index = written(listed.select("shape", "word", F.explode(_places(F.col("word"))).alias("place")), "index")
    least = max(1, listed.count() // COMMON_PART)
    shown = examples.where(F.col(key).isNotNull()).select(key, "cipher", "plain")
    shown = substitution(shown, key, "cipher", "plain").select(key, F.explode("mapping").alias("c", "p")).where(F.col("c").rlike("^[a-z]$") & F.col("p").rlike("^[a-z]$"))
    letters = written(_one_to_one(shown, key), "letters")

    def tables(letters: DataFrame) -> DataFrame:
        per = letters.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("c", "p"))).alias("_l"))  # 26 at most
        return per.select(key, F.array_join("_l.c", "").alias("known"), F.array_join("_l.p", "").alias("plain"), F.array_join(F.array_sort("_l.p"), "").alias("taken"))

    filled = lambda df: df.fillna("", ["known", "plain", "taken"])
    chars = lambda c: F.regexp_extract_all(c, F.lit("(.)"), 1)
    by = ["taken", "shape", "seen"]
    for _ in range(rounds):
        open_ = filled(tokens.join(tables(letters), key, "left")).withColumn("seen", _seen(F.col("w"), F.col("known"), F.col("plain"))).where(F.contains("seen", F.lit("_")))
        open_ = written(open_.select(key, "w", *by), "open")
        patterns = written(open_.select(*by).distinct(), "patterns")
        common = patterns.groupBy("taken").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("taken")
        classed = listed.crossJoin(F.broadcast(common)).select("word", "taken", "shape", _seen(F.col("word"), F.col("taken"), F.col("taken")).alias("seen"))
        rare = patterns.join(F.broadcast(common), "taken", "left_anti").withColumn("place", _place(F.col("seen")))
        fits = rare.join(index, ["shape", "place"]).where(_seen(F.col("word"), F.col("taken"), F.col("taken")) == F.col("seen"))
        single = lambda df: df.groupBy(*by).agg(F.min("word").alias("word"), F.max("word").alias("_other")).where("word = _other").drop("_other")
        # all words of a question whose patterns are of one word show their letters
        sure = open_.join(single(classed).unionByName(single(fits)), by)
        new = sure.select(key, F.explode(F.arrays_zip(chars("w").alias("c"), chars("word").alias("p"), chars("seen").alias("s"))).alias("_z")).where("_z.s = '_'").select(key, "_z.c", "_z.p").distinct()
        new = written(_one_to_one(new, key), "new")
        if new.isEmpty():
            break
        learned = new.select(key).distinct()
        tokens = open_.select(key, "w", "shape").join(learned, key, "left_semi")
        letters = letters.unionByName(new)
    out = filled(questions.withColumn("_key", F.col(key).cast(kind)).join(tables(letters).withColumnRenamed(key, "_key"), "_key", "left")).drop("_key", "taken")
    rest = F.call_function("translate", F.lit(_LETTERS), F.col("known"), F.lit(""))
    answer = F.call_function("translate", F.col("cipher"), F.concat("known", rest), F.rpad("plain", len(_LETTERS), "?"))
    return out.withColumn("answer", F.when(F.col(key).isNotNull(), answer)).drop("known", "plain")


def _one_to_one(letters: DataFrame, key: str) -> DataFrame:
    """The rows of distinct (key, c, p) that share neither c nor p with another."""
    once = letters.groupBy(key, "c").agg(F.min("p").alias("p"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    taken = letters.groupBy(key, "p").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return once.join(taken, [key, "p"], "left_semi").select(key, "c", "p")


def solve_report(graded: DataFrame, status: str) -> DataFrame:
    """status (`all` for the last line), correct, total, errors, timeouts and rate (percent) of graded() results; a
    problem without status counts as `?`."""
    of = F.coalesce(F.col(status), F.lit("?"))
    counted = graded.select(of.alias("status"), "outcome").groupBy("status").agg(*[F.count_if(F.col("outcome") == o).alias(n) for n, o in (("correct", "ok"), ("errors", "error"), ("timeouts", "timeout"))], F.count(F.lit(1)).alias("total"))
    names = ("correct", "total", "errors", "timeouts")
    every = counted.agg(F.lit("all").alias("status"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return counted.select("status", *names).unionByName(every).withColumn("rate", F.bround(100 * F.col("correct") / F.nullif("total", F.lit(0)), 1))
