"""Text expressions: blanks, trimming, case, character classes, find and replace, split and merge."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# ASCII white space as trimmed by the cleaning functions.
WHITE_SPACE = " \t\n\r\f\x0b"

# Character classes removed by the special-character cleaner.
NON_ALPHANUMERIC = r"[^A-Za-z0-9\s]"
PUNCTUATION = r"""[!@#$%^&*()_+=\[\]{};':"\\|,.<>?/`~\-]"""
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}"
    r"\x{FE00}-\x{FE0F}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}\x{200D}\x{2B50}]+"
)
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFD}]"
CHARACTER_CLASSES = {
    "alphanumeric": NON_ALPHANUMERIC,
    "punctuation": PUNCTUATION,
    "emoji": EMOJI,
    "control": CONTROL,
}


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    """Null when the text is empty or white space only, else the text unchanged."""
    return F.when(strip(c) != "", c)


def is_blank(c: Column) -> Column:
    """True for null and for white space."""
    return F.coalesce(strip(c) == "", F.lit(True))


def squeeze(c: Column) -> Column:
    """Strip both ends and turn every run of two or more white-space characters into one space."""
    return F.regexp_replace(strip(c), r"\s{2,}", " ")


def title_case(c: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere (`mid-cap` gives `Mid-Cap`)."""
    pieces = F.split(c, r"(?<=[^\p{L}])")
    return F.array_join(F.transform(pieces, lambda piece: F.initcap(piece)), "")


def recase(c: Column, case: str) -> Column:
    if case == "upper":
        return F.upper(c)
    if case == "lower":
        return F.lower(c)
    if case == "title":
        return title_case(c)
    raise ValueError(f"unknown case {case!r}")


def capitalise(c: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def remove_characters(c: Column, mode: str) -> Column:
    return squeeze(F.regexp_replace(c, CHARACTER_CLASSES[mode], ""))


def find_replace(
    c: Column, rules: Iterable[tuple[str, str]], use_regex: bool = False, case_sensitive: bool = True
) -> Column:
    """Apply `(find, replacement)` rules in order."""
    for find, replacement in rules:
        if not find:
            continue
        if not use_regex and case_sensitive:
            c = F.replace(c, F.lit(find), F.lit(replacement))
            continue
        pattern = find if use_regex else re.escape(find)
        if not use_regex:
            replacement = replacement.replace("\\", "\\\\").replace("$", "\\$")
        c = F.regexp_replace(c, pattern if case_sensitive else f"(?i){pattern}", replacement)
    return c


def split_part(c: Column, delimiter: str, index: int) -> Column:
    """Part `index` (from 0) after splitting on a literal delimiter; null when there are fewer parts."""
    parts = F.split(c, re.escape(delimiter), -1)
    return F.get(parts, F.lit(index))


def merge_parts(cols: Iterable[Column], separator: str) -> Column:
    """Join the stripped non-blank parts."""
    return F.concat_ws(separator, *[blank_to_null(strip(c.cast("string"))) for c in cols])


def zero_pad(c: Column, width: int) -> Column:
    """Pad with zeros up to `width`; longer text is kept whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def word_count(c: Column) -> Column:
    stripped = strip(c)
    return F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, r"\s+")))


def null_if_sentinel(c: Column, sentinels: Iterable[str]) -> Column:
    values = [s.strip().lower() for s in sentinels]
    return F.when(~F.lower(strip(c)).isin(values), c)


def within_one_edit(a: Column, b: Column) -> Column:
    """True when the lower-cased texts differ by exactly one insertion, deletion or substitution."""
    return F.levenshtein(F.lower(a), F.lower(b), 1) == 1
