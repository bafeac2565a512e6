"""Text expressions as Column -> Column functions: answers in boxes, normal forms, markers, prompts, similarities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and texts that results depend on.
NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
PROMPT_SUFFIX = "\nPlease put your final answer inside `\\boxed{}`. For example: `\\boxed{your answer}`"
GUESS_WORDS = ("guess", "plausible", "stuck", "running out", "most likely", "maybe", "symmetry", "struggling")
VERIFY_WORDS = ("matches all", "perfect match")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalise(c: Column) -> Column:
    """Lower case, runs of white space as one blank, stripped."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def first_non_empty(*cs: Column) -> Column:
    """The first that is neither null nor empty, else an empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def _balanced(depth: int) -> str:
    inner = r"[^{}]*"
    for _ in range(depth):
        inner = r"[^{}]*(?:\{" + inner + r"\}[^{}]*)*"
    return inner


def box_pattern(depth: int = 3) -> str:
    """The last box that closes, with braces nested up to a depth. The greedy prefix finds the last opening."""
    return r"(?s)^.*\\boxed\s*\{(" + _balanced(depth) + r")\}"


def _any_depth(c: Column) -> Column:
    """Content of the last box that closes, by one pass over the braces with a stack of those that are open."""
    tokens = F.regexp_extract_all(c, F.lit(r"(?s)(\\boxed\s*\{|[{}]|[^{}\\]+|\\)"), 1)
    none = "array<struct<at: int, box: boolean>>"
    start = F.struct(F.lit(0).alias("i"), F.array().cast(none).alias("open"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def on(s: Column, t: Column) -> Column:
        top, deep = F.get(s["open"], F.size(s["open"]) - 1), F.size(s["open"])
        closes = (t == "}") & (deep > 0)
        opened = F.when(t.endswith("{"), F.concat(s["open"], F.array(F.struct(s["i"].alias("at"), (t != "{").alias("box"))))).when(closes, F.slice(s["open"], 1, deep - 1)).otherwise(s["open"])
        better = closes & top["box"] & (top["at"] > s["first"])
        return F.struct((s["i"] + 1).alias("i"), opened.alias("open"), F.when(better, top["at"]).otherwise(s["first"]).alias("first"), F.when(better, s["i"]).otherwise(s["last"]).alias("last"))

    found = F.aggregate(tokens, start, on)
    content = lambda f: F.when(f["first"] >= 0, F.array_join(F.slice(tokens, f["first"] + 2, f["last"] - f["first"] - 1), ""))
    return F.element_at(F.transform(F.array(found), content), 1)


def _from_box(c: Column) -> Column:
    """The text from its first box on; braces before it never decide which box is the last, or which closes."""
    return F.substring(c, F.greatest(F.locate("\\boxed", c), F.lit(1)), F.length(c))


def _deep(c: Column, depth: int) -> Column:
    """Whether more braces than `depth` follow the first box."""
    return F.regexp_count(F.regexp_extract(c, r"(?s)\\boxed\s*\{(.*)", 1), F.lit(r"\{")) > depth


def extract_boxed(c: Column, depth: int = 3) -> Column:
    """Stripped content of the last closed box, with braces nested to any depth; null without one or if it is empty.

    Texts with no more braces behind their first box than `depth` allows are read by a pattern, others brace by brace.
    """
    found = strip(F.when(_deep(c, depth), _any_depth(_from_box(c))).otherwise(F.regexp_extract(c, box_pattern(depth), 1)))
    return F.get(F.filter(F.array(found), lambda x: x != ""), F.lit(0))  # evaluates it once


def last_number(c: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit("(" + NUMBER + ")"), 1), F.lit(-1))


def extract_answer(c: Column, depth: int = 3) -> Column:
    """The last box's content, else the last number, else null."""
    return F.coalesce(extract_boxed(c, depth), last_number(c))


def _without_boxes(c: Column) -> Column:
    """Without the boxes that close, by one pass over the braces; a box inside a removed one goes with it."""
    tokens = F.regexp_extract_all(c, F.lit(r"(?s)(\\boxed\{|[{}]|[^{}\\]+|\\)"), 1)
    start = F.struct(F.lit(0).alias("i"), F.array().cast("array<struct<at: int, box: boolean>>").alias("open"), F.array().cast("array<struct<at: int, to: int>>").alias("gone"))

    def on(s: Column, t: Column) -> Column:
        top, deep = F.get(s["open"], F.size(s["open"]) - 1), F.size(s["open"])
        closes = (t == "}") & (deep > 0)
        opened = F.when(t.endswith("{"), F.concat(s["open"], F.array(F.struct(s["i"].alias("at"), (t != "{").alias("box"))))).when(closes, F.slice(s["open"], 1, deep - 1)).otherwise(s["open"])
        gone = F.when(closes & top["box"], F.concat(F.filter(s["gone"], lambda g: g["at"] < top["at"]), F.array(F.struct(top["at"].alias("at"), s["i"].alias("to"))))).otherwise(s["gone"])
        return F.struct((s["i"] + 1).alias("i"), opened.alias("open"), gone.alias("gone"))

    gone = F.aggregate(tokens, start, on)["gone"]
    return F.array_join(F.flatten(F.transform(F.array(gone), lambda g: F.filter(tokens, lambda t, i: ~F.exists(g, lambda x: (x["at"] <= i) & (i <= x["to"]))))), "")


def strip_boxed(c: Column, compat: bool = False, depth: int = 3) -> Column:
    """Without boxes and trailing white space. compat ends a box at its first closing brace; by default boxes are
    balanced, with braces nested to any depth: by a pattern up to `depth`, else brace by brace."""
    if compat:
        rest = F.regexp_replace(c, r"\\boxed\{[^}]*\}", "")
    else:
        rest = F.when(_deep(c, depth), _without_boxes(c)).otherwise(F.regexp_replace(c, r"\\boxed\{" + _balanced(depth) + r"\}", ""))
    return F.regexp_replace(rest, r"\s+$", "")


def has_box(c: Column) -> Column:
    return F.coalesce(c.contains("\\boxed{"), F.lit(False))


def has_text(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def usable_cot(c: Column, least: int = 5) -> Column:
    """Not empty, not the literal `nan`, and not shorter than `least` when stripped."""
    return F.coalesce((strip(c) != "nan") & (F.length(strip(c)) >= least), F.lit(False))


def lexicon_hit(c: Column, words: tuple[str, ...] = GUESS_WORDS) -> Column:
    """Whether any of the words (plain texts) occurs, letter case aside."""
    low = F.lower(c)
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w.lower())
    return F.coalesce(hit, F.lit(False))


def verified_without_guess(c: Column, marks: tuple[str, ...] = VERIFY_WORDS, guesses: tuple[str, ...] = GUESS_WORDS, tail: int = 400) -> Column:
    """A verification mark occurs and no guess word does near the end."""
    return lexicon_hit(c, marks) & ~lexicon_hit(F.right(c, F.lit(tail)), guesses)


def estimated_tokens(c: Column) -> Column:
    """Four characters a token, rounded up: the fallback where no tokenizer is given."""
    return F.ceil(F.coalesce(F.length(c), F.lit(0)) / 4).cast("long")


def head_tail(c: Column, limit: int = 2000, gap: str = "\n...\n") -> Column:
    """The text, or its first and last half of the limit."""
    half = limit // 2
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.left(c, F.lit(half)), F.lit(gap), F.right(c, F.lit(half))))


def slug(run: Column, epoch: Column) -> Column:
    return F.concat(F.translate(run, "_", "-"), F.lit("-ep"), epoch.cast("string"))


def run_label(name: Column) -> Column:
    """A source's name without its capture prefix or `_existing`."""
    return F.regexp_replace(F.regexp_replace(name, "^(eq|bm)_", ""), "_existing$", "")


def user_prompt(prompt: Column, suffix: str = PROMPT_SUFFIX) -> Column:
    return F.concat(prompt, F.lit(suffix))


def assistant_reply(cot: Column, answer: Column) -> Column:
    return F.concat(cot, F.lit("\n</think>\n\\boxed{"), answer, F.lit("}"))


def chat(prompt: Column, cot: Column, answer: Column) -> Column:
    """messages: array<struct<role, content>>."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("user", user_prompt(prompt)), message("assistant", assistant_reply(strip_boxed(cot), answer)))


def render_chat(messages: Column) -> Column:
    """A literal role-tagged rendering, the default chat template."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n"))), "")


def char_counts(c: Column) -> Column:
    """map<char, count> of a text."""
    chars = F.split(c, "")
    one = F.filter(chars, lambda x: x != "")
    return F.map_from_entries(F.transform(F.array_distinct(one), lambda x: F.struct(x, F.size(F.filter(one, lambda y: y == x)))))


def quick_ratio(a: Column, b: Column) -> Column:
    """Upper bound of sequence likeness: twice the multiset overlap of characters over the sum of lengths."""
    ca, cb = char_counts(a), char_counts(b)
    both = F.aggregate(F.map_keys(ca), F.lit(0), lambda s, k: s + F.least(F.try_element_at(ca, k), F.coalesce(F.try_element_at(cb, k), F.lit(0))))
    size = F.length(a) + F.length(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(2.0 * both / size)


def category(prompt: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The first category whose text occurs in the prompt."""
    out = F.lit(other)
    for text, name in reversed(rules):
        out = F.when(F.lower(prompt).contains(text), F.lit(name)).otherwise(out)
    return out


# prompts that show examples and ask for one more


def example_block(prompt: Column) -> Column:
    """The part of a prompt before the question."""
    return F.element_at(F.split(prompt, "Now,"), 1)


def bit_examples(prompt: Column) -> Column:
    """array<struct<x, y>> of `00001111 -> 11110000` lines."""
    found = F.regexp_extract_all(example_block(prompt), F.lit(r"([01]{8}\s*->\s*[01]{8})"), 1)
    word = lambda t, n: F.conv(F.regexp_extract(t, r"([01]{8})\s*->\s*([01]{8})", n), 2, 10).cast("int")
    return F.transform(found, lambda t: F.struct(word(t, 1).alias("x"), word(t, 2).alias("y")))


def bit_query(prompt: Column) -> Column:
    return F.conv(F.nullif(F.regexp_extract(prompt, r"determine the output for:\s*([01]{8})", 1), F.lit("")), 2, 10).cast("int")


def equation_examples(prompt: Column) -> Column:
    """array<struct<a, op, b, out>> of `12#34 = 46` lines."""
    line = r"(\d{2})(\D)(\d{2}) = (\S+)"
    found = F.regexp_extract_all(example_block(prompt), F.lit("(?m)^(" + line + r")\s*$"), 1)
    return F.transform(found, lambda t: F.struct(*[F.regexp_extract(t, line, k).alias(n) for k, n in enumerate(("a", "op", "b", "out"), 1)]))


def equation_query(prompt: Column) -> Column:
    """struct<a, op, b>; fields are empty where the prompt asks nothing of this form."""
    line = r"determine the result for:\s*(\d+)(\D)(\d+)"
    return F.struct(*[F.regexp_extract(prompt, line, k).alias(n) for k, n in enumerate(("a", "op", "b"), 1)])


def operands(prompt: Column) -> Column:
    """struct<a, b>: of the first `A op B` (the second may be negative), else the first two numbers of one to six digits
    that stand alone, else nulls."""
    line = r"\b(-?\d+)\s*[-+*/÷×]\s*(-?\d+)\b"
    numbers = F.regexp_extract_all(prompt, F.lit(r"\b(\d{1,6})\b"), 1)
    spare = lambda k: F.when(F.size(numbers) > 1, F.get(numbers, F.lit(k - 1)))
    pick = lambda k: F.when(prompt.rlike(line), F.regexp_extract(prompt, line, k)).otherwise(spare(k)).try_cast("long")
    return F.struct(pick(1).alias("a"), pick(2).alias("b"))


# eight-bit words


def to_bits(word: Column) -> Column:
    return F.lpad(F.bin(word), 8, "0")


def from_bits(bits: Column) -> Column:
    return F.conv(bits, 2, 10).cast("int")


def reverse_bits(word: Column) -> Column:
    return from_bits(F.reverse(to_bits(word)))


def rotl(word: Column, k: int) -> Column:
    return (F.shiftleft(word, k).bitwiseOR(F.shiftright(word, 8 - k))).bitwiseAND(F.lit(255))


def not8(word: Column) -> Column:
    return word.bitwiseXOR(F.lit(255))


def majority(a: Column, b: Column, c: Column) -> Column:
    return a.bitwiseAND(b).bitwiseOR(a.bitwiseAND(c)).bitwiseOR(b.bitwiseAND(c))


def neighbours(word: Column, with_self: bool) -> Column:
    """Each bit as the parity of its two cyclic neighbours (and itself): rules 90 and 150."""
    out = rotl(word, 1).bitwiseXOR(rotl(word, 7))
    return out.bitwiseXOR(word) if with_self else out


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


# equations


def signed_reverse(c: Column) -> Column:
    """Reversed digits behind a leading minus sign."""
    return F.when(c.startswith("-"), F.concat(F.lit("-"), F.reverse(F.substr(c, F.lit(2))))).otherwise(F.reverse(c))


def typographic(a: Column, op: Column, b: Column) -> Column:
    """`-` subtracts, `*` concatenates the second and first operand, `/` multiplies, any other gives the distance."""
    x, y = a.cast("long"), b.cast("long")
    return F.when(op == "-", (x - y).cast("string")).when(op == "*", F.concat(b, a)).when(op == "/", (x * y).cast("string")).otherwise(F.abs(x - y).cast("string"))


def roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999, else null."""
    parts = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    out, left = F.lit(""), n.cast("int")
    for value, sign in parts:
        out, left = F.concat(out, F.repeat(F.lit(sign), F.floor(left / value).cast("int"))), F.pmod(left, F.lit(value))
    return F.when(n.between(1, 3999), out)


# time


def parse_time(c: Column) -> Column:
    """UTC times with or without fractions of a second and a final Z; null for anything else."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(form)) for form in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]X", "yyyy-MM-dd'T'HH:mm:ss[.SSS]X", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")])


def stamp() -> Column:
    """The present time as text."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
