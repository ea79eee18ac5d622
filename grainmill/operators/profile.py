"""Quality profile: detectors, health score, column reports.

Three passes serve all detectors, whatever the number of columns:

* one unpivot and aggregate for everything that is a count per column,
* one unpivot and shuffle of (column, value) for distinct counts, repeats, spellings and typos,
* one shuffle of row fingerprints for exact and near duplicates.

Issues come out as rows (id, column, severity, affected_count, affected_pct, example); only those few rows ever reach
the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from grainmill.functions import text
from grainmill.functions.dates import parse_mixed
from grainmill.functions.numbers import read_double
from grainmill.functions.stats import count_if
from grainmill.operators.dedup import near_duplicate_count
from grainmill.operators.explore import melt_row, numeric_columns, one_left_out, similar_pairs, text_columns
from grainmill.operators.positions import sorted_ranges
from grainmill.operators.quantiles import column_quantiles
from grainmill.session import cut_lineage

# Name parts that give a column its role.
DATE_WORDS = ("date", "time", "created", "updated")
KEY_WORDS = ("id", "key", "code", "uuid", "email", "phone", "pk", "fk")
EMAIL_WORDS = ("email",)
PHONE_WORDS = ("phone", "tel")
URL_WORDS = ("url", "link", "website")
POSITIVE_WORDS = ("age", "salary", "price", "revenue", "cost")

# Accepted forms.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = r"^\+?[\d\s\-()]{7,20}$"
URL_PATTERN = r"^https?://[^\s/$.?#].[^\s]*$"
BOOLEAN_TEXTS = ("true", "false", "yes", "no", "t", "f", "y", "n", "1", "0", "1.0", "0.0")

# Weight and least deduction of an issue by severity.
WEIGHTS = {"critical": (15.0, 1.5), "warning": (5.0, 0.5), "info": (1.0, 0.1)}

ISSUE_SCHEMA = (
    "id string, column string, severity string, affected_count long, affected_pct double, example string"
)


def named(columns: Sequence[str], words: Sequence[str]) -> list[str]:
    return [c for c in columns if any(w in c.lower() for w in words)]


KINDS = ("int", "float", "bool", "date", "text")


def kind_of(stripped: Column, moment: Column) -> Column:
    """What a stripped, lower-cased text value reads as: int, float, bool, date or text."""
    return (
        F.when(stripped.rlike(r"^[+-]?\d+$"), "int")
        .when(stripped.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)(e[+-]?\d+)?$"), "float")
        .when(stripped.isin("true", "false", "yes", "no"), "bool")
        .when(moment.isNotNull(), "date")
        .when(stripped.isNotNull(), "text")
    )


COUNT_NAMES = (
    "rows", "missing", "blanks", "spaced", "multi_spaced", "control", "numeric", "kinds", "bad_dates", "odd_years",
    "bad_emails", "bad_phones", "bad_urls", "negatives", "present", "bools", "dates", "marked",
)


def column_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column with every per-column count the detectors use; null where a count does not apply.

    Every cell becomes a row of one form, so the tests are written and compiled once, not once per column: a wide
    aggregate of all columns outgrows what the virtual machine compiles. Counts combine before the shuffle.
    """
    columns = list(columns or df.columns)
    texts, numbers = set(text_columns(df)), set(numeric_columns(df))
    roles = {
        "date": set(named(columns, DATE_WORDS)) - numbers,
        "email": set(named(columns, EMAIL_WORDS)) & texts,
        "phone": set(named(columns, PHONE_WORDS)) & texts,
        "url": set(named(columns, URL_WORDS)) & texts,
        "positive": set(named(columns, POSITIVE_WORDS)) & numbers,
    }
    moments = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))}
    cells = []
    for c in columns:
        v = F.col(f"`{c}`")
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                v.isNotNull().alias("there"),
                (v if c in texts else F.lit(None)).cast("string").alias("v"),
                (F.year(v) if c in moments else F.lit(None)).cast("int").alias("year"),
                (v < 0 if c in roles["positive"] else F.lit(None)).cast("boolean").alias("negative"),
                *[F.lit(c in roles[r]).alias(r) for r in ("date", "email", "phone", "url")],
            )
        )
    rows = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    v = F.col("v")
    rows = rows.withColumns({"s": text.strip(v), "d": parse_mixed(v)})
    rows = rows.withColumns({"low": F.lower("s"), "year": F.coalesce("year", F.year("d"))}).withColumn("kind", kind_of(F.col("low"), F.col("d")))
    there, s, written = F.col("there"), F.col("s"), F.col("v").isNotNull()
    seen = [F.max(F.when(F.col("kind") == k, 1).otherwise(0)) for k in KINDS]
    found = {
        "rows": F.count(F.lit(1)),
        "missing": count_if(~there),
        "blanks": count_if(s == ""),
        "spaced": count_if(s != v),
        "multi_spaced": count_if(v.rlike(r"\s{2,}")),
        "control": count_if(v.rlike(text.CONTROL)),
        "numeric": F.count(read_double(s)),
        "kinds": reduce(lambda a, b: a + b, seen),
        "bad_dates": count_if(F.col("date") & there & F.col("year").isNull()),
        "odd_years": count_if(F.col("date") & ((F.col("year") < 1800) | (F.col("year") > 2100))),
        "bad_emails": count_if(F.col("email") & written & ~v.rlike(EMAIL_PATTERN)),
        "bad_phones": count_if(F.col("phone") & written & ~v.rlike(PHONE_PATTERN)),
        "bad_urls": count_if(F.col("url") & written & ~v.rlike(URL_PATTERN)),
        "negatives": count_if(F.col("negative")),
        "present": count_if(there),
        "bools": count_if(F.col("low").isin(*BOOLEAN_TEXTS)),
        "dates": F.count("d"),
        "marked": count_if(F.col("low").rlike("[-/:]")),
    }
    counted = rows.groupBy("column").agg(*[value.cast("long").alias(name) for name, value in found.items()])
    # A count is null for columns that its test is not for.
    column = F.col("column")
    of_text = ("blanks", "spaced", "multi_spaced", "control", "numeric", "kinds", "bools", "dates", "marked")
    meant = {name: texts for name in of_text} | {"bad_dates": roles["date"], "odd_years": roles["date"], "negatives": roles["positive"]}
    meant |= {"bad_emails": roles["email"], "bad_phones": roles["phone"], "bad_urls": roles["url"]}
    kept = [F.when(column.isin(*meant[n]), F.col(n)).alias(n) if n in meant else F.col(n) for n in COUNT_NAMES]
    return counted.select("column", *kept)


def outlier_counts(df: DataFrame, columns: Sequence[str] | None = None, reach: float = 1.5) -> DataFrame:
    """Per numeric column: quartile bounds and values outside; needs over five values and a spread."""
    columns = list(columns or numeric_columns(df))
    q = column_quantiles(df, columns, {"q1": 0.25, "q3": 0.75})
    margin = reach * (F.col("q3") - F.col("q1"))
    bounds = q.where(F.col("q3") > F.col("q1")).select(
        "column", (F.col("q1") - margin).alias("low"), (F.col("q3") + margin).alias("high")
    )
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]
    long = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    # One row of bounds per column of the table, so the broadcast is bounded by its width.
    rows = long.join(F.broadcast(bounds), "column").groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("v").alias("present"),
        F.first("low").alias("low"),
        F.first("high").alias("high"),
        count_if((F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))).alias("outside"),
    )
    return rows.where(F.col("present") > 5)


def value_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: present, distinct and repeated values, distinct trimmed spellings with and without case.

    A cell is shuffled as its trimmed text and a 128-bit hash of the whole value; trimmed texts longer than a digest
    as digests. Counts combine map-side, so a value filling a third of the table costs one row per task.
    """
    cells = []
    for c in columns:
        v = F.col(c).cast("string")
        stripped = text.strip(v)
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                *_hashes(v),
                _short(stripped).alias("trimmed"),
                F.when(F.length(stripped) > DIGEST, F.sha2(F.lower(stripped), 256)).alias("long"),
            )
        )
    counted = (
        df.select(F.explode(F.array(*cells)).alias("c"))
        .select("c.*")
        .where(F.col("trimmed").isNotNull())
        .groupBy("column", "h1", "h2", "trimmed", "long")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_spelling = counted.groupBy("column", F.coalesce("long", F.lower("trimmed")).alias("lowered"), "trimmed").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("values")
    )
    by_lower = by_spelling.groupBy("column", "lowered").agg(
        F.sum("n").alias("n"), F.sum("values").alias("values"), F.count(F.lit(1)).alias("spellings"),
        F.min("trimmed").alias("a"), F.max("trimmed").alias("b"),
    )
    clash = F.when(F.col("spellings") > 1, F.struct("lowered", "a", "b"))
    return by_lower.groupBy("column").agg(
        F.sum("n").alias("present"),
        F.sum("values").alias("distinct_values"),
        (F.sum("n") - F.sum("values")).alias("repeated"),
        F.sum("spellings").alias("trimmed_values"),
        (F.sum("spellings") - F.count(F.lit(1))).alias("case_variants"),
        F.min(clash).alias("clash"),
    )


DIGEST = 64


def _short(v: Column) -> Column:
    return F.when(F.length(v) > DIGEST, F.sha2(v, 256)).otherwise(v)


def _hashes(v: Column) -> tuple[Column, Column]:
    return F.xxhash64(v).alias("h1"), F.xxhash64(F.lit("second"), v).alias("h2")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: present, distinct and repeated values. Only 128-bit hashes of the cells are shuffled."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("there"), *_hashes(F.col(c))) for c in columns]
    counted = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("there")
    counted = counted.groupBy("column", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("column").agg(
        F.sum("n").alias("present"),
        F.count(F.lit(1)).alias("distinct_values"),
        (F.sum("n") - F.count(F.lit(1))).alias("repeated"),
    )


def typo_pairs(df: DataFrame, columns: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    """Pairs of trimmed values one edit apart; with `most`, only in columns of at most so many distinct values."""
    return similar_pairs(_trimmed_values(df, columns, most), ["column", "k"], "value")


def _trimmed_values(df: DataFrame, columns: Sequence[str] | None, most: int | None) -> DataFrame:
    """Distinct trimmed values (column, value) of columns with two or more, with their number `k`."""
    columns = list(columns or text_columns(df))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text.strip(F.col(c)).alias("value")) for c in columns]))
    distinct = df.select(cells.alias("c")).select("c.*").where(F.col("value").isNotNull()).distinct()
    sizes = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1)
    if most is not None:
        sizes = sizes.where(F.col("k") <= most)
    return distinct.join(sizes, "column")


def typo_counts(df: DataFrame, columns: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    """Per column with `typo_pairs`: `k` distinct values, `n` pairs, and `e`, the smallest pair as text. Runs jobs.

    Pairs are counted without being made, as values in a row (keys, numbered names) have very many: texts that differ at
    one place meet in the form without that place, n of them being n (n - 1) / 2 pairs, and a text with one character
    more meets the shorter one in the form that is the shorter one. So the work grows with the values, not the pairs.
    """
    ranked = sorted_ranges(_trimmed_values(df, columns, most), ["column", "value"])
    low = F.lower("value").alias("low")
    words = ranked.groupBy("column", low).agg(F.count(F.lit(1)).alias("c"), F.min("_at").alias("at"), F.max("k").alias("k"))
    shorter = F.slice(one_left_out(F.col("low")), F.lit(1), F.length("low"))  # an empty text has none

    def cell(own, at, form) -> Column:
        return F.struct(F.lit(own).alias("own"), at.cast("int").alias("place"), form.alias("form"))

    cells = F.concat(
        F.array(cell(True, F.lit(0), F.col("low"))),
        F.transform(F.array_distinct(shorter), lambda form: cell(False, F.lit(0), form)),
        F.transform(shorter, lambda form, i: cell(False, i + 1, form)),
    )
    rows = words.select("column", "k", "c", "at", F.explode(cells).alias("f")).select("column", "k", "c", "at", "f.*")
    own, longer, c = F.col("own"), ~F.col("own") & (F.col("place") == 0), F.col("c")
    changed = F.when(F.col("place") > 0, c).otherwise(0)
    meeting = rows.groupBy("column", *_hashes(F.struct("place", "form"))).agg(
        F.sum(F.when(own, c).otherwise(0)).alias("own"), F.sum(F.when(longer, c).otherwise(0)).alias("longer"),
        F.sum(changed).alias("all"), F.sum(changed * changed).alias("same"), F.min("at").alias("at"), F.max("k").alias("k"),
    )
    pairs = F.col("own") * F.col("longer") + F.shiftright(F.col("all") * F.col("all") - F.col("same"), 1)
    found = meeting.withColumn("n", pairs).where("n > 0")
    found = found.groupBy("column").agg(F.max("k").alias("k"), F.sum("n").alias("n"), F.min("at").alias("_at"))

    # The smallest value of any pair is the first of its own pairs. From here on there is one row per column.
    values = ranked.select("column", "value", "_at")
    first = values.join(F.broadcast(found), ["column", "_at"]).select("column", "k", "n", F.col("value").alias("first"))
    others = values.join(F.broadcast(first), "column").where(text.within_one_edit(F.col("first"), F.col("value")))
    pair = F.concat_ws(" vs ", "first", F.min("value"))
    counted = cut_lineage(others.groupBy("column", "k", "n", "first").agg(pair.alias("e")))
    # As texts, only pairs of a value that goes on where `first` ends may be smaller: by a character under the space.
    value = F.col("value")
    rivals = values.join(F.broadcast(counted), "column").where(value.startswith(F.col("first")) & (value > F.col("first")))
    rivals = rivals.where(F.concat(value, F.lit(" vs ")) <= F.col("e")).select("column", "value")
    counted = counted.drop("first")
    if rivals.isEmpty():
        return counted
    smallest = similar_pairs(values.select("column", "value"), ["column"], "value", rivals).groupBy("column").agg(
        F.min(F.concat_ws(" vs ", "first", "second")).alias("_e")
    )
    return counted.join(smallest, "column", "left").select("column", "k", "n", F.least("e", "_e").alias("e"))


def issues(
    df: DataFrame,
    ignore: Sequence[str] = (),
    header: Sequence[str] | None = None,
    categories: int | None = None,
) -> DataFrame:
    """All issues of a table as rows. `header` is the raw header line, for repeated column names.

    Every text column is looked through for spellings one edit apart, whatever its number of values; `categories`
    leaves out columns of more distinct values than that, where a caller wants the finding for categories alone.
    """
    data = df.drop(*ignore)
    columns = data.columns
    parts = [
        _flatten(column_counts(data), _column_cells(len(columns))),
        _outlier_issues(data),
        _value_issues(data, categories),
        _row_issues(data),
    ]
    parts = [p for p in parts if p is not None]
    repeated = repeated_names(header if header is not None else columns)
    if repeated:
        pct = len(repeated) * 100.0 / len(header or columns)
        row = [("duplicate_columns", None, "critical", len(repeated), pct, repeated[0])]
        parts.append(df.sparkSession.createDataFrame(row, ISSUE_SCHEMA))
    return reduce(DataFrame.unionByName, parts)


def repeated_names(header: Sequence[str]) -> list[str]:
    """Names that occur again, or that carry the `.1`, `.2` suffix a reader gave to a repeat."""
    import re

    seen: set[str] = set()
    repeats = []
    for name in header:
        if name in seen or re.search(r"\.\d+$", name):
            repeats.append(name)
        seen.add(name)
    return repeats


def _issue(id_: str, severity, count, pct, example) -> Column:
    return F.struct(
        F.lit(id_).alias("id"),
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        count.cast("long").alias("affected_count"),
        pct.cast("double").alias("affected_pct"),
        (example if isinstance(example, Column) else F.lit(example)).cast("string").alias("example"),
    )


def percent(count: Column, rows: Column) -> Column:
    return F.coalesce(F.try_divide(count * 100.0, rows), F.lit(0.0))


def _flatten(rows: DataFrame, cells: Sequence[Column], column: Column | None = None) -> DataFrame:
    name = F.col("column") if column is None else column
    return (
        rows.select(name.cast("string").alias("column"), F.explode(F.array(*cells)).alias("i"))
        .select("i.id", "column", "i.severity", "i.affected_count", "i.affected_pct", "i.example")
        .where(F.col("affected_count") > 0)
    )


def _column_cells(width: int) -> list[Column]:
    """Issues of a row of `column_counts`."""
    rows = F.col("rows")
    pct = lambda name: percent(F.col(name), rows)
    present = rows - F.col("missing")
    failed = F.when((F.col("numeric") > 0) & (F.col("numeric") < 0.95 * present), present - F.col("numeric"))
    odd = F.col("bad_dates") + F.col("odd_years")
    # A column whose values read as several kinds; int beside float is one kind.
    mixed = F.when((F.col("kinds") > 1) & (F.col("numeric") < present), F.col("kinds"))
    return [
        _issue("missing_values", F.when(pct("missing") > 30.0, "critical").otherwise("warning"), F.col("missing"), pct("missing"), "null"),
        _issue("blank_strings", "warning", F.col("blanks"), pct("blanks"), "blank text"),
        _issue("mixed_types", "critical", mixed, percent(mixed, F.lit(width)), "several kinds of value"),
        _issue("invalid_dates", "warning", odd, percent(odd, rows), "unreadable or far-off date"),
        _issue("numeric_failures", "warning", failed, percent(failed, rows), "text among numbers"),
        _issue("whitespace_ends", "warning", F.col("spaced"), pct("spaced"), "space at an end"),
        _issue("whitespace_multiple", "info", F.col("multi_spaced"), pct("multi_spaced"), "repeated spaces"),
        _issue("special_characters", "warning", F.col("control"), pct("control"), "control character"),
        _issue("empty_columns", "critical", F.when(F.col("missing") == rows, rows), F.lit(100.0), "null"),
        _issue("email_pattern", "warning", F.col("bad_emails"), pct("bad_emails"), "not an e-mail address"),
        _issue("phone_pattern", "warning", F.col("bad_phones"), pct("bad_phones"), "not a phone number"),
        _issue("url_pattern", "warning", F.col("bad_urls"), pct("bad_urls"), "not a web address"),
        _issue("business_rules", "warning", F.col("negatives"), pct("negatives"), "negative number"),
    ]


def _outlier_issues(df: DataFrame) -> DataFrame | None:
    if not numeric_columns(df):
        return None
    rows = outlier_counts(df)
    example = F.format_string("outside %.1f to %.1f", F.col("low"), F.col("high"))
    return _flatten(rows, [_issue("outliers", "warning", F.col("outside"), percent(F.col("outside"), F.col("rows")), example)])


def valued_columns(df: DataFrame) -> list[str]:
    """Columns whose values are counted: texts and keys."""
    return list(dict.fromkeys([*text_columns(df), *named(df.columns, KEY_WORDS)]))


def _valued_stats(df: DataFrame) -> DataFrame:
    """`value_stats` of the texts; keys that are no text have no spellings, so theirs are counted by hashes alone."""
    texts = [c for c in valued_columns(df) if c in text_columns(df)]
    keys = [c for c in valued_columns(df) if c not in texts]
    found = [value_stats(df, texts)] if texts else []
    if keys:
        found.append(distinct_counts(df.select(*[F.col(c).cast("string").alias(c) for c in keys]), keys))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    if not texts:
        no_text = {"trimmed_values": "bigint", "case_variants": "bigint", "clash": "struct<lowered:string,a:string,b:string>"}
        rows = rows.withColumns({name: F.lit(None).cast(kind) for name, kind in no_text.items()})
    return rows


def _value_cells(df: DataFrame) -> list[Column]:
    """Issues of a row of `_valued_stats`."""
    total = df.agg(F.count(F.lit(1))).scalar()
    is_key, is_text = F.col("column").isin(*named(df.columns, KEY_WORDS)), F.col("column").isin(*text_columns(df))
    repeated = F.when(is_key, F.col("repeated"))
    variants = F.when(is_text, F.col("case_variants"))
    clash = F.concat_ws(" / ", "clash.a", "clash.b")
    return [
        _issue("uniqueness_violations", "critical", repeated, percent(repeated, total), "repeated key"),
        _issue("case_inconsistent", "warning", variants, percent(variants, F.col("trimmed_values")), clash),
    ]


def _typo_issues(df: DataFrame, categories: int | None) -> DataFrame | None:
    if not text_columns(df):
        return None
    grouped = typo_counts(df, text_columns(df), categories)
    return _flatten(grouped, [_issue("category_inconsistent", "warning", F.col("n"), percent(F.col("n"), F.col("k")), F.col("e"))])


def _value_issues(df: DataFrame, categories: int | None) -> DataFrame | None:
    if not valued_columns(df):
        return None
    found = _flatten(_valued_stats(df), _value_cells(df))
    typos = _typo_issues(df, categories)
    return found if typos is None else found.unionByName(typos)


def row_counts(df: DataFrame) -> DataFrame:
    """One row: rows, surplus exact copies, near copies, empty rows. One shuffle of fingerprints for both kinds of copy."""
    empty = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in df.columns])
    base = df.agg(F.struct(F.count(F.lit(1)).alias("rows"), count_if(empty).alias("empty")).alias("s")).scalar()
    near = near_duplicate_count(df, include_exact=True)
    return near.agg(
        F.max(F.when(F.col("column") == "", F.col("near_duplicates"))).alias("duplicates"),
        F.sum(F.when((F.col("column") != "") & (F.col("near_duplicates") > 0), F.col("near_duplicates"))).alias("near"),
    ).select(
        base.getField("rows").alias("rows"),
        F.coalesce("duplicates", F.lit(0)).alias("duplicates"),
        F.coalesce("near", F.lit(0)).alias("near_duplicates"),
        base.getField("empty").alias("empty_rows"),
    )


def _row_issues(df: DataFrame) -> DataFrame:
    rows = row_counts(df)
    n = F.col("rows")
    dup = percent(F.col("duplicates"), n)
    near = F.when(F.lit(len(df.columns) > 2), F.col("near_duplicates"))
    cells = [
        _issue("duplicate_rows", F.when(dup > 20.0, "critical").otherwise("warning"), F.col("duplicates"), dup, "whole row repeated"),
        _issue("near_duplicates", "warning", near, percent(near, n), "rows equal but for one column"),
        _issue("empty_rows", "critical", F.col("empty_rows"), percent(F.col("empty_rows"), n), "null"),
    ]
    return _flatten(rows, cells, F.lit(None))


def health_score(found: DataFrame) -> DataFrame:
    """100 less a weighted deduction per issue (with a least deduction by severity), cut to 0..100 and truncated."""
    severity = F.col("severity")
    weight = F.when(severity == "critical", WEIGHTS["critical"][0]).when(severity == "warning", WEIGHTS["warning"][0]).otherwise(WEIGHTS["info"][0])
    least = F.when(severity == "critical", WEIGHTS["critical"][1]).when(severity == "warning", WEIGHTS["warning"][1]).otherwise(WEIGHTS["info"][1])
    # Percentages enter rounded to one digit, as they are shown.
    deduction = F.greatest(weight * F.round("affected_pct", 1) / 100.0, least)
    penalty = F.round(F.coalesce(F.sum(deduction), F.lit(0.0)), 9)
    return found.agg(F.greatest(F.lit(0), F.least(F.lit(100), (100 - penalty).cast("int"))).alias("health_score"))


def run_metrics(df: DataFrame, found: DataFrame) -> DataFrame:
    rows = df.agg(F.count(F.lit(1))).scalar()
    by_severity = [count_if(F.col("severity") == s).alias(f"{s}_count") for s in WEIGHTS]
    return found.agg(*by_severity, F.count(F.lit(1)).alias("total_issues")).select(
        rows.alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        (rows * len(df.columns)).alias("total_cells"),
        "*",
    )


def compare_health(before: DataFrame, after: DataFrame) -> DataFrame:
    """Health of two issue frames side by side."""
    was = health_score(before).scalar()
    return health_score(after).select(
        was.alias("before"), F.col("health_score").alias("after"), (F.col("health_score") - was).alias("gain")
    )


# ---------------------------------------------------------------- column reports


def detected_types(df: DataFrame) -> DataFrame:
    """Per column: empty, boolean, number, date, mixed or text, decided from counts of what its values read as."""
    return column_counts(df).select("column", "rows", "present", _detected(df).alias("detected"))


def _detected(df: DataFrame) -> Column:
    """The kind that a row of `column_counts` speaks for."""
    declared = {
        f.name: "boolean" if isinstance(f.dataType, T.BooleanType)
        else "date" if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        else "number" if isinstance(f.dataType, T.NumericType)
        else None
        for f in df.schema.fields
    }
    known = {c: k for c, k in declared.items() if k}
    by_schema = F.lit(None).cast("string")
    for c, k in known.items():
        by_schema = F.when(F.col("column") == c, k).otherwise(by_schema)
    present, marked, numbers = F.col("present"), F.col("marked") > 0, F.col("numeric")
    by_values = (
        F.when(F.col("bools") == present, "boolean")
        .when(numbers == present, "number")
        .when(marked & (F.col("dates") == present), "date")
        .when(numbers > 0, "mixed")
        .when(marked & (F.col("dates") > 0), "mixed")
        .otherwise("text")
    )
    return F.when(present == 0, "empty").otherwise(F.coalesce(by_schema, by_values))


def column_report(df: DataFrame) -> DataFrame:
    """Per column: detected type, missing cells (blanks included for text), repeated values, issues, status.

    The issues are those of `issues` that concern a column. Counts and value statistics are read once each, for the
    figures and the issues alike; whole-row checks are not made.
    """

    def many(cells: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, [F.when(c.getField("affected_count") > 0, 1).otherwise(0) for c in cells])

    rows = column_counts(df).select(
        "column", "rows", "missing", F.coalesce("blanks", F.lit(0)).alias("blanks"),
        _detected(df).alias("detected"), many(_column_cells(len(df.columns))).alias("i0"),
    )
    valued = valued_columns(df)
    rest = [c for c in df.columns if c not in valued]
    repeats = []
    if valued:
        repeats.append(_valued_stats(df).select("column", "repeated", many(_value_cells(df)).alias("i1")))
    if rest:
        repeats.append(distinct_counts(df, rest).select("column", "repeated", F.lit(0).alias("i1")))
    rows = rows.join(reduce(DataFrame.unionByName, repeats), "column", "left")
    for name, part in (("i2", _outlier_issues(df)), ("i3", _typo_issues(df, None))):
        if part is None:
            rows = rows.withColumn(name, F.lit(0))
        else:
            rows = rows.join(part.groupBy("column").agg(F.count(F.lit(1)).alias(name)), "column", "left")
    issues_found = reduce(lambda a, b: a + b, [F.coalesce(f"i{k}", F.lit(0)) for k in range(4)])
    rows = rows.withColumns({"repeated": F.coalesce("repeated", F.lit(0)), "issues": issues_found.cast("long")})
    missing = F.col("missing") + F.when(F.col("detected").isin("text", "mixed"), F.col("blanks")).otherwise(0)
    pct = percent(missing, F.col("rows"))
    status = (
        F.when((F.round(pct, 1) > 30.0) | (F.col("detected") == "empty"), "critical")
        .when((F.round(pct, 1) > 5.0) | (F.col("issues") > 0), "attention")
        .otherwise("clean")
    )
    return rows.select(
        "column",
        "detected",
        missing.alias("missing"),
        pct.alias("missing_pct"),
        F.col("repeated").alias("duplicate_values"),
        "issues",
        status.alias("status"),
    )


def classify_columns(df: DataFrame) -> DataFrame:
    """Per column: numeric, categorical, datetime, identifier or text."""
    texts, numbers = text_columns(df), numeric_columns(df)
    stats = distinct_counts(df, df.columns).select("column", "present", "distinct_values")
    aggregates, fields = [F.count(F.lit(1)).alias("rows")], {}
    for c in df.columns:
        v = text.strip(F.col(c))
        found = (
            {
                "avg_length": F.avg(F.length(v)),
                "avg_words": F.avg(text.word_count(F.col(c))),
                "dates": F.count(parse_mixed(F.col(c))),
            }
            if c in texts
            else {}
        )
        fields[c] = {"rows": "rows"}
        for name in ("avg_length", "avg_words", "dates"):
            aggregates.append(found.get(name, F.lit(None)).cast("double").alias(f"{c}|{name}"))
            fields[c][name] = f"{c}|{name}"
    rows = melt_row(df.agg(*aggregates), fields).join(stats, "column", "left")
    moments = [c for c, k in df.dtypes if k in ("date", "timestamp", "timestamp_ntz")]
    number_keys = named(numbers, ("id", "key", "code", "index", "pk"))
    text_keys = named(texts, ("id", "key", "code", "pk"))
    near_unique = F.col("distinct_values") >= F.col("rows") * 0.9
    name = F.col("column")
    wordy = (F.col("avg_words") > 3) | ((F.col("avg_length") > 30) & (F.col("distinct_values") > 0.5 * F.col("rows")))
    role = (
        F.when(name.isin(*moments) | ((F.col("present") > 0) & (F.col("dates") == F.col("present"))), "datetime")
        .when(name.isin(*number_keys) & ((F.col("distinct_values") == F.col("present")) | near_unique), "identifier")
        .when(name.isin(*numbers), "numeric")
        .when(name.isin(*text_keys) & near_unique, "identifier")
        .when(name.isin(*texts) & wordy, "text")
        .otherwise("categorical")
    )
    return rows.select("column", role.alias("role"))


def schema_roles(df: DataFrame) -> dict[str, str]:
    """numeric, datetime or categorical from the schema alone."""
    roles = {}
    for name, kind in df.dtypes:
        if kind in ("date", "timestamp", "timestamp_ntz"):
            roles[name] = "datetime"
        elif name in numeric_columns(df):
            roles[name] = "numeric"
        else:
            roles[name] = "categorical"
    return roles
