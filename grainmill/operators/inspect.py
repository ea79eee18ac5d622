"""Inspection: findings by severity, in the order they are reported.

A finding is a row (severity, column, issue, count, percentage, details). Structure comes from the schema, the rest
from the same few passes as the quality profile, over whole columns rather than the first rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.functions import text
from grainmill.functions.dates import FORMAT_NAMES, looks_like_date, parse_mixed
from grainmill.functions.numbers import CURRENCY_SIGNS, to_double, to_number
from grainmill.functions.stats import count_if
from grainmill.operators.clean import header_overlap, unnamed_columns
from grainmill.operators.dedup import duplicate_count
from grainmill.operators.explore import melt_row, numeric_columns, text_columns
from grainmill.operators.profile import distinct_counts, named, percent, value_stats

# Words read as booleans, and their spelling groups.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "1", "0", "t", "f", "on", "off")
BOOLEAN_GROUPS = (("true", "false"), ("yes", "no"), ("1", "0"), ("y", "n"))

# Name parts of columns that hold no negatives, and of columns that hold unique values.
POSITIVE_WORDS = (
    "age", "price", "cost", "amount", "quantity", "qty", "count", "total", "salary", "revenue", "weight", "height",
    "distance", "size", "area", "volume", "fee",
)
UNIQUE_WORDS = (
    "id", "email", "phone", "ssn", "passport", "license", "username", "account_id", "order_id", "transaction_id",
    "employee_id", "customer_id", "user_id", "sku",
)

# Placeholders proposed as missing, postal column words, date forms outside the standard list.
CUSTOM_SENTINELS = ("--", "tbd", "pending", "n.a.", "not applicable", "to be determined", "n.a")
POSTAL_WORDS = ("pincode", "zip", "postal", "post_code")
DATE_WORDS = ("date", "dt", "time", "created", "updated")
EXOTIC_DATES = {"d-MMM-yyyy": r"^\d{1,2}-\w{3}-\d{4}$", "yyyyMMdd": r"^\d{8}$", "M/d/yy": r"^\d{1,2}/\d{1,2}/\d{2}$"}

FINDING_SCHEMA = "severity string, column string, issue string, count long, percentage double, details string"
SEVERITIES = ("critical", "moderate", "minor", "outlier")

PERCENT_NUMBER = r"^\s*-?\d+\.?\d*\s*%\s*$"
COMMA_NUMBER = r"^\s*-?[\d,]+\.?\d*\s*$"


def _normal_name(column: str) -> str:
    return column.lower().replace(" ", "_").replace("-", "_")


def _named(columns: Sequence[str], words: Sequence[str]) -> list[str]:
    return [c for c in columns if any(w in _normal_name(c) for w in words)]


def _finding(severity, issue: str, count: Column, percentage: Column, details=None) -> Column:
    return F.struct(
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        F.lit(issue).alias("issue"),
        count.cast("long").alias("count"),
        percentage.cast("double").alias("percentage"),
        (details if isinstance(details, Column) else F.lit(details)).cast("string").alias("details"),
    )


def _rows(frame: DataFrame, cells: Sequence[Column], column: Column | None = None) -> DataFrame:
    name = F.col("column") if column is None else column
    return (
        frame.select(name.alias("column"), F.explode(F.array(*cells)).alias("f"))
        .select("f.severity", "column", "f.issue", "f.count", "f.percentage", "f.details")
        .where(F.col("count") > 0)
    )


def structural(df: DataFrame, order: str | None = None) -> DataFrame:
    """Unnamed columns, trailing empty rows (needs the row id) and rows that repeat the header."""
    data = [c for c in df.columns if c != order]
    unnamed = [c for c in unnamed_columns(df) if c != order]
    empty = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in data])
    trailing = F.lit(0)
    if order is not None:
        last = df.agg(F.max(F.when(~empty, F.col(order)))).scalar()
        trailing = count_if(F.col(order) > last)
    headers = count_if(header_overlap(df, data, [order] if order else []) > len(data) * 0.5)
    counts = df.agg(F.count(F.lit(1)).alias("rows"), trailing.alias("trailing"), headers.alias("headers"))
    zero = F.lit(0.0)
    cells = [
        _finding("moderate", "unnamed_columns", F.lit(len(unnamed)), zero, ", ".join(unnamed)),
        _finding("minor", "trailing_empty_rows", F.col("trailing"), zero),
        _finding("moderate", "embedded_headers", F.when(F.col("rows") > 1, F.col("headers")), zero),
    ]
    return _rows(counts, cells, F.lit("All columns"))


def completeness(df: DataFrame) -> DataFrame:
    """Missing cells per column (blank texts count), empty columns, rows of which more than half is null."""
    texts = text_columns(df)
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in df.columns])
    aggregates = [F.count(F.lit(1)).alias("rows"), count_if(nulls > len(df.columns) * 0.5).alias("mostly")]
    fields = {}
    for c in df.columns:
        missing = text.is_blank(F.col(c)) if c in texts else F.col(c).isNull()
        aggregates.append(count_if(missing).alias(f"c|{c}"))
        fields[c] = {"rows": "rows", "missing": f"c|{c}"}
    wide = df.agg(*aggregates)
    per_column = melt_row(wide, fields)
    pct = percent(F.col("missing"), F.col("rows"))
    severity = F.when(pct > 50, "critical").when(pct > 10, "moderate").otherwise("minor")
    whole = F.col("missing") == F.col("rows")
    columns = _rows(
        per_column,
        [
            _finding("critical", "empty_column", F.when(whole, F.col("missing")), F.lit(100.0)),
            _finding(severity, "missing_values", F.when(~whole, F.col("missing")), pct),
        ],
    )
    rows = _rows(
        wide,
        [_finding("moderate", "mostly_missing_rows", F.col("mostly"), percent(F.col("mostly"), F.col("rows")))],
        F.lit("All columns"),
    )
    return columns.unionByName(rows)


def duplicates(df: DataFrame) -> DataFrame:
    """Copies of whole rows, and repeated values in columns named like keys."""
    whole = duplicate_count(df)
    found = _rows(
        whole,
        [_finding("critical", "duplicate_rows", F.col("duplicates"), percent(F.col("duplicates"), F.col("rows")))],
        F.lit("All columns"),
    )
    keys = _named(df.columns, UNIQUE_WORDS)
    if not keys:
        return found
    stats = distinct_counts(df, keys)
    repeats = _finding("critical", "duplicate_unique_values", F.col("repeated"), F.lit(0.0))
    return found.unionByName(_rows(stats, [repeats]))


def text_types(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """What text columns really hold: numbers with signs, percents or commas, dates, mixed booleans, mixed types.

    The first rule that applies to a column is the one reported, as a chain of conditions over one aggregate.
    """
    texts = [c for c in text_columns(df) if c not in ignore]
    aggregates, fields = [F.count(F.lit(1)).alias("rows")], {}
    for c in texts:
        v = F.col(c)
        low = F.lower(text.strip(v))
        names = [F.when(text.strip(v).rlike(f"^(?:{p})$"), n) for p, n in FORMAT_NAMES]
        measures = {
            "present": F.count(v),
            "currency": count_if(v.rlike(CURRENCY_SIGNS)),
            "percents": count_if(v.rlike(PERCENT_NUMBER)),
            "commas": count_if(v.rlike(COMMA_NUMBER) & v.contains(",")),
            "dated": count_if(looks_like_date(v)),
            "numeric": F.count(to_double(v)),
            # Bounded sets: seven format names, twelve boolean words and a count of anything else.
            "formats": F.array_sort(F.array_compact(F.array(*[F.max(n) for n in names]))),
            "words": F.array_sort(F.array_compact(F.array(*[F.max(F.when(low == w, w)) for w in BOOLEAN_WORDS]))),
        }
        fields[c] = {"rows": "rows"}
        for name, m in measures.items():
            aggregates.append(m.alias(f"{c}|{name}"))
            fields[c][name] = f"{c}|{name}"
    if not texts:
        return df.sparkSession.createDataFrame([], FINDING_SCHEMA)
    lowered = (F.col("trimmed_values") - F.col("case_variants")).alias("lowered")
    stats = value_stats(df, texts).select("column", F.col("distinct_values").alias("distinct"), lowered)
    rows = melt_row(df.agg(*aggregates), fields).join(stats, "column", "left")
    present = F.col("present")
    groups = sum(
        (F.when(F.arrays_overlap("words", F.array(*[F.lit(w) for w in g])), 1).otherwise(0) for g in BOOLEAN_GROUPS),
        F.lit(0),
    )
    is_currency = F.col("currency") > present * 0.3
    is_percent = F.col("percents") > present * 0.3
    is_comma = F.col("commas") > present * 0.3
    is_date = F.col("dated") > present * 0.4
    is_boolean = (F.size("words") >= 2) & (F.col("lowered") <= 6) & (groups > 1)
    is_mixed = (F.col("numeric") > 0) & (F.col("numeric") < present) & (F.col("numeric") > present * 0.3)
    formats = F.array_join("formats", ", ")
    finding = (
        F.when(is_currency, _finding("moderate", "numeric_with_symbols", F.col("currency"), percent(F.col("currency"), present)))
        .when(is_percent, _finding("moderate", "numeric_with_percent", F.col("percents"), F.lit(0.0)))
        .when(is_comma, _finding("moderate", "numeric_with_commas", F.col("commas"), F.lit(0.0)))
        .when(is_date & (F.size("formats") > 1), _finding("moderate", "inconsistent_dates", present, F.lit(0.0), formats))
        .when(is_date & (F.size("formats") == 1), _finding("minor", "date_as_text", present, F.lit(0.0), formats))
        .when(is_date, F.lit(None))
        .when(is_boolean, _finding("moderate", "boolean_inconsistency", present, F.lit(0.0), F.array_join("words", ", ")))
        .when(is_mixed, _finding("moderate", "mixed_types", present - F.col("numeric"), F.lit(0.0)))
    )
    return _rows(rows.where(present > 0), [finding])


def formatting(df: DataFrame) -> DataFrame:
    """Spaces at the ends, and values spelled in several cases."""
    texts = text_columns(df)
    if not texts:
        return df.sparkSession.createDataFrame([], FINDING_SCHEMA)
    wide = df.agg(*[count_if(text.strip(F.col(c)) != F.col(c)).alias(c) for c in texts])
    spaced = melt_row(wide, {c: {"spaced": c} for c in texts})
    stats = value_stats(df, texts)
    return _rows(spaced, [_finding("minor", "whitespace", F.col("spaced"), F.lit(0.0))]).unionByName(
        _rows(stats, [_finding("moderate", "inconsistent_casing", F.col("case_variants"), F.lit(0.0))])
    )


def outliers(df: DataFrame, columns: Sequence[str] | None = None, sigmas: float = 3.0) -> DataFrame:
    """Values beyond three deviations and negatives where none belong. Texts are read as numbers first."""
    columns = list(columns or [*numeric_columns(df), *text_columns(df)])
    texts = text_columns(df)
    data = df.select(*[(to_number(F.col(c)) if c in texts else F.col(c).cast("double")).alias(c) for c in columns])
    stats = data.agg(
        F.struct(
            *[
                F.struct(F.count(c).alias("n"), F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c)
                for c in columns
            ]
        ).alias("x")
    ).scalar()
    positive = _named(columns, POSITIVE_WORDS)
    aggregates, fields = [], {}
    for c in columns:
        s = stats.getField(c)
        far = count_if((s.getField("s") > 0) & (F.abs(F.col(c) - s.getField("m")) > sigmas * s.getField("s")))
        negative = count_if(F.col(c) < 0) if c in positive else F.lit(0)
        for name, m in {"n": F.count(c), "far": far, "negative": negative}.items():
            aggregates.append(m.cast("long").alias(f"{c}|{name}"))
        fields[c] = {name: f"{c}|{name}" for name in ("n", "far", "negative")}
    rows = melt_row(data.agg(*aggregates), fields).where(F.col("n") >= 10)
    return _rows(
        rows,
        [
            _finding("outlier", "statistical_outlier", F.col("far"), F.lit(0.0)),
            _finding("outlier", "negative_in_positive", F.col("negative"), F.lit(0.0)),
        ],
    )


def date_outliers(df: DataFrame, now, columns: Sequence[str] | None = None) -> DataFrame:
    """Dates after `now` and before 1900, for columns with at least five readable dates.

    `now` is an argument so that a run can be repeated. Numeric columns are not read as dates.
    """
    texts = text_columns(df)
    numbers = numeric_columns(df)
    columns = [c for c in (columns or df.columns) if c not in numbers]
    aggregates, fields = [], {}
    for c in columns:
        moment = parse_mixed(F.col(c)) if c in texts else F.col(c).cast("timestamp_ntz")
        limit = F.lit(now).cast("timestamp_ntz")
        measures = {
            "n": F.count(moment),
            "future": count_if(moment > limit),
            "ancient": count_if(moment < F.lit("1900-01-01").cast("timestamp_ntz")),
        }
        for name, m in measures.items():
            aggregates.append(m.alias(f"{c}|{name}"))
        fields[c] = {name: f"{c}|{name}" for name in measures}
    rows = melt_row(df.agg(*aggregates), fields).where(F.col("n") >= 5)
    return _rows(
        rows,
        [
            _finding("outlier", "future_dates", F.col("future"), F.lit(0.0)),
            _finding("outlier", "ancient_dates", F.col("ancient"), F.lit(0.0)),
        ],
    )


def inspect(df: DataFrame, now, order: str | None = None) -> DataFrame:
    """All findings of a table. `order` names the row id, which is not inspected itself."""
    data = df.drop(order) if order else df
    parts = [
        structural(df, order),
        completeness(data),
        duplicates(data),
        text_types(data),
        formatting(data),
        outliers(data),
    ]
    if set(data.columns) - set(numeric_columns(data)):
        parts.append(date_outliers(data, now))
    return reduce(DataFrame.unionByName, parts)


def clean_columns(df: DataFrame, findings: DataFrame) -> DataFrame:
    """Columns without a finding."""
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    return names.join(findings.select("column").distinct(), "column", "left_anti")


def propose_rules(df: DataFrame) -> DataFrame:
    """Patterns outside the built-in checks: uneven postal code lengths, unusual placeholders, unusual date forms.

    Rows (rule, column, share, detail). Code lengths are counted per length first, so the modal length is one more
    small aggregate.
    """
    texts = text_columns(df)
    parts = []
    for c in _named(df.columns, POSTAL_WORDS):
        lengths = df.where(F.col(c).isNotNull()).groupBy(F.length(F.col(c).cast("string")).alias("l")).agg(
            F.count(F.lit(1)).alias("n")
        )
        best = F.min_by("l", F.struct(-F.col("n"), F.col("l")))
        rows = lengths.agg(best.alias("modal"), F.sum("n").alias("total"), F.max("n").alias("top"))
        parts.append(
            rows.where((F.col("total") >= 5) & ((F.col("total") - F.col("top")) / F.col("total") > 0.10)).select(
                F.lit("leading_zero_postal_code").alias("rule"),
                F.lit(c).alias("column"),
                ((F.col("total") - F.col("top")) / F.col("total")).alias("share"),
                F.col("modal").cast("string").alias("detail"),
            )
        )
    if texts:
        aggregates, fields = [F.count(F.lit(1)).alias("rows")], {}
        for c in texts:
            low = F.lower(text.strip(F.col(c)))
            for i, s in enumerate(CUSTOM_SENTINELS):
                aggregates.append(count_if(low == s).alias(f"{c}|s{i}"))
            aggregates.append(F.count(c).alias(f"{c}|n"))
            fields[c] = {"rows": "rows", "n": f"{c}|n"} | {f"s{i}": f"{c}|s{i}" for i in range(len(CUSTOM_SENTINELS))}
            for i, p in enumerate(EXOTIC_DATES.values()):
                exotic = count_if(F.col(c).rlike(p)) if c in named([c], DATE_WORDS) else F.lit(0).cast("long")
                aggregates.append(exotic.alias(f"{c}|d{i}"))
                fields[c][f"d{i}"] = f"{c}|d{i}"
        rows = melt_row(df.agg(*aggregates), fields).where(F.col("n") >= 5)
        sentinels = [
            F.struct(
                F.lit("sentinel_value").alias("rule"),
                (F.col(f"s{i}") / F.col("rows")).alias("share"),
                F.lit(s).alias("detail"),
                F.lit(0.05).alias("above"),
            )
            for i, s in enumerate(CUSTOM_SENTINELS)
        ]
        exotic = [
            F.struct(
                F.lit("exotic_date_format").alias("rule"),
                (F.col(f"d{i}") / F.col("n")).alias("share"),
                F.lit(name).alias("detail"),
                F.lit(0.5).alias("above"),
            )
            for i, name in enumerate(EXOTIC_DATES)
        ]
        parts.append(
            rows.select("column", F.explode(F.array(*sentinels, *exotic)).alias("p"))
            .where(F.col("p.share") > F.col("p.above"))
            .select("p.rule", "column", "p.share", "p.detail")
        )
    if not parts:
        return df.sparkSession.createDataFrame([], "rule string, column string, share double, detail string")
    return reduce(DataFrame.unionByName, parts)
