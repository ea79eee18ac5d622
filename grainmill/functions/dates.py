"""Date expressions: mixed-format parsing, format classification, date parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from grainmill.functions.text import strip

# Accepted text forms, tried in this order. Ambiguous slashes and dashes are month first;
# day first is tried when the month would be over 12.
PARSE_RULES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ("yyyy-M-d",)),
    (r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$", ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ("M/d/yyyy", "d/M/yyyy")),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ("M-d-yyyy", "d-M-yyyy")),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", ("M.d.yyyy", "d.M.yyyy")),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ("yyyy/M/d",)),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4}$", ("MMM d, yyyy", "MMM d yyyy")),
    (r"^[A-Za-z]{4,} \d{1,2},? \d{4}$", ("MMMM d, yyyy", "MMMM d yyyy")),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", ("d MMM yyyy",)),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", ("d MMMM yyyy",)),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", ("d-MMM-yyyy",)),
    (r"^\d{8}$", ("yyyyMMdd",)),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", ("M/d/yy", "d/M/yy")),
)

LONGEST = 32  # no accepted form is longer

# The seven named date forms of the format check.
FORMAT_NAMES = (
    (r"\d{4}-\d{2}-\d{2}", "YYYY-MM-DD"),
    (r"\d{2}/\d{2}/\d{4}", "MM/DD/YYYY"),
    (r"\d{2}-\d{2}-\d{4}", "MM-DD-YYYY"),
    (r"\d{2}\.\d{2}\.\d{4}", "DD.MM.YYYY"),
    (r"\d{4}/\d{2}/\d{2}", "YYYY/MM/DD"),
    (r"[A-Za-z]+ \d{1,2},? \d{4}", "Month DD, YYYY"),
    (r"\d{1,2} [A-Za-z]+ \d{4}", "DD Month YYYY"),
)

# Output patterns offered by the date cleaner.
TARGET_FORMATS = {"iso": "yyyy-MM-dd", "us": "MM/dd/yyyy", "european": "dd/MM/yyyy", "slash": "yyyy/MM/dd"}


def parse_mixed(c: Column) -> Column:
    """Text in any accepted form to a timestamp without zone; null when none fits.

    A pattern is matched before its formatter runs, so a value costs one parse and no caught exception per wrong form.
    """
    text = strip(c)
    result = None
    for pattern, formats in PARSE_RULES:
        tries = [F.try_to_timestamp(text, F.lit(fmt)) for fmt in formats]
        parsed = F.coalesce(*tries) if len(tries) > 1 else tries[0]
        condition = text.rlike(pattern)
        result = F.when(condition, parsed) if result is None else result.when(condition, parsed)
    # Texts that are long or without a digit skip the list of patterns.
    plausible = (F.length(text) <= LONGEST) & text.rlike("[0-9]")
    return F.when(plausible, result).cast("timestamp_ntz")


def format_name(c: Column) -> Column:
    """The name of the date form that fits the whole text, null when none does."""
    text = strip(c)
    result = None
    for pattern, name in FORMAT_NAMES:
        condition = text.rlike(f"^(?:{pattern})$")
        result = F.when(condition, name) if result is None else result.when(condition, name)
    return result


def looks_like_date(c: Column) -> Column:
    return c.rlike("|".join(f"(?:{pattern})" for pattern, _ in FORMAT_NAMES))


def date_parts(c: Column) -> dict[str, Column]:
    """Calendar attributes; weekday counts Monday as 0."""
    return {
        "year": F.year(c),
        "quarter": F.quarter(c),
        "month": F.month(c),
        "day": F.dayofmonth(c),
        "hour": F.hour(c),
        "weekday": F.weekday(c),
        "is_weekend": F.weekday(c) >= 5,
        "iso_week": F.weekofyear(c),
        "month_name": F.date_format(c, "MMMM"),
        "day_name": F.date_format(c, "EEEE"),
    }


def years_before(c: Column, years: int) -> Column:
    """The same day `years` earlier; 29 February becomes 28 February."""
    return F.add_months(c, -12 * years)


def iso_year_week(c: Column) -> Column:
    """Year and ISO week together, e.g. 2024 week 1 as 202401."""
    iso_year = F.extract(F.lit("YEAROFWEEK"), c)
    return iso_year * 100 + F.weekofyear(c)
