"""Grading of answers: the policy with its tolerance, exact equality, and checkers by type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalise, strip

REL, ABS = 1e-2, 1e-5
#: What counts as a number: Spark's own casts also take type suffixes, so the text is matched first.
_FINITE = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
_SPECIAL = r"(?i)^\s*[-+]?(inf|infinity|nan)\s*$"


def number(c: Column) -> Column:
    """The double that a text denotes, else null."""
    return F.when(c.rlike(_FINITE) | c.rlike(_SPECIAL), F.trim(c).try_cast("double"))


def close(a: Column, b: Column, rel: float = REL, absolute: float = ABS) -> Column:
    """Equal within the larger of both tolerances. NaN equals nothing; an infinity only itself."""
    infinite = (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    apart = F.abs(a - b)
    limit = F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.when(F.isnan(a) | F.isnan(b), F.lit(False)).when(a == b, F.lit(True)).when(infinite, F.lit(False)).otherwise(apart <= limit)


def is_correct(pred: Column, truth: Column, rel: float = REL, absolute: float = ABS) -> Column:
    """Null predictions are wrong. Truths of only 0 and 1 want the same text, numbers are close, other texts equal
    with letter case aside."""
    p, t = strip(pred), strip(truth)
    same = F.lower(p) == F.lower(t)
    x, y = number(p), number(t)
    return F.coalesce(F.when(t.rlike("^[01]+$"), same).when(x.isNotNull() & y.isNotNull(), close(x, y, rel, absolute)).otherwise(same), F.lit(False))


def num_eq(pred: Column, truth: Column) -> Column:
    """The same text with letter case aside, or exactly the same number."""
    p, t = strip(pred), strip(truth)
    x, y = number(p), number(t)
    return F.coalesce((F.lower(p) == F.lower(t)) | F.coalesce((x == y) & ~F.isnan(x), F.lit(False)), F.lit(False))


def by_type(kind: Column, pred: Column, truth: Column) -> Column:
    """Checkers by type: binary texts exactly, numbers within 0.05 or 0.5 %, Roman numerals and texts with letter case
    aside, all else exactly."""
    x, y = number(pred), number(truth)
    numeric = F.when(x.isNotNull() & y.isNotNull(), close(x, y, 0.005, 0.05)).otherwise(F.lit(False))
    folded = normalise(pred) == normalise(truth)
    verdict = F.when(kind == "bit_manipulation", strip(pred) == strip(truth)).when(kind.isin("gravity", "unit_conversion"), numeric).when(kind.isin("numeral", "cipher"), folded).otherwise(pred == truth)
    return F.coalesce(verdict, F.lit(False))
