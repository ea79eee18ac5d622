"""Number expressions: text to number, booleans, bins, bounds, rounding."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from grainmill.functions.text import strip

# Signs removed before a text is read as a number.
NUMBER_NOISE = r"[$€£¥,%'\s]"
CURRENCY_NOISE = r"[$€£¥₹₩₽,%\s]"
CURRENCY_SIGNS = r"[$€£¥₹₩₽]"

# Words read as true and false.
TRUE_WORDS = ("yes", "y", "1", "true", "t")
FALSE_WORDS = ("no", "n", "0", "false", "f")


# Every text that the cast reads as a double, and few others.
NUMERIC = r"^[+-]?(?:[0-9.]+(?:[eE][+-]?[0-9]+)?[dDfF]?|0[xX].*|(?i:inf|infinity|nan))$"


def read_double(c: Column) -> Column:
    """Stripped text to double, null where it is no number. The pattern is asked first, as a failed cast costs an exception."""
    return F.when(c.rlike(NUMERIC), c.try_cast("double"))


def to_double(c: Column) -> Column:
    """Plain conversion; null when the text is not a number."""
    return read_double(strip(c))


def to_number(c: Column) -> Column:
    """Text to double: currency, percent, commas and spaces dropped, `(1,250)` read as -1250, failures null."""
    cleaned = F.regexp_replace(c, NUMBER_NOISE, "")
    negative = F.regexp_replace(cleaned, r"^\((.*)\)$", "-$1")
    return read_double(negative)


def to_number_plain(c: Column) -> Column:
    """Text to double without the parenthesis rule, with the longer list of currency signs."""
    return read_double(F.regexp_replace(c, CURRENCY_NOISE, ""))


def to_integer(c: Column) -> Column:
    """Text to a whole number, halves rounded to even."""
    return F.bround(to_number(c)).cast("long")


def to_boolean(c: Column, true_words: Iterable[str] = TRUE_WORDS, false_words: Iterable[str] = FALSE_WORDS) -> Column:
    word = F.lower(strip(c.cast("string")))
    return F.when(word.isin([w.strip().lower() for w in true_words]), True).when(
        word.isin([w.strip().lower() for w in false_words]), False
    )


def band(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins `(edges[i], edges[i+1]]`; the last bin is open; values at or under the first edge are null."""
    expression = F.when(c <= edges[0], F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        expression = expression.when(c <= upper, label)
    return expression.when(c.isNotNull(), labels[len(edges) - 1])


def clip(c: Column, low: Column, high: Column) -> Column:
    """Bound a value; null stays null and a null bound does not bind."""
    return F.when(c < low, low).when(c > high, high).otherwise(c)


def compare(c: Column, op: str, limit) -> Column:
    """`c op limit`, never true for null."""
    tests = {
        "<": c < limit,
        "<=": c <= limit,
        ">": c > limit,
        ">=": c >= limit,
        "==": c == limit,
        "!=": c != limit,
    }
    return c.isNotNull() & tests[op]


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero."""
    return F.try_divide(a, b)


def fixed(c: Column, digits: int) -> Column:
    """Round for output. The tiny bias keeps exact halves from depending on the last bit of a sum."""
    scale = 10.0**digits
    return F.floor(c.cast("double") * F.lit(scale) + F.lit(0.5001)).cast("double") / F.lit(scale)
