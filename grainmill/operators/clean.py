"""Cleaning operators. Each returns `Cleaned(df, metrics)`.

`df` stays lazy. `metrics` is a lazy one-row frame (counts of changed cells or removed rows); it costs a job only when
it is read. Table-wide statistics (means, quantile bounds, text shares) enter as scalar subqueries, so a cleaning step
never visits the driver, with two documented exceptions that must know the schema: `drop_missing` (empty columns) and
plan building.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from grainmill.functions import numbers, text
from grainmill.functions.dates import TARGET_FORMATS, parse_mixed
from grainmill.functions.mapping import map_values
from grainmill.functions.stats import count_if
from grainmill.operators import dedup, ordered
from grainmill.operators.quantiles import quantiles
from grainmill.operators.values import mode_by

# Share of numbers above which a text column is left alone by find and replace.
NUMERIC_TEXT_SHARE = 0.95

# Spellings of the three transaction kinds and the accepted enumerations.
TRANSACTION_SYNONYMS = {
    "sip": "SIP",
    "systematic investment plan": "SIP",
    "s i p": "SIP",
    "lumpsum": "Lumpsum",
    "lump sum": "Lumpsum",
    "one time": "Lumpsum",
    "redemption": "Redemption",
    "redeem": "Redemption",
    "withdrawal": "Redemption",
}
TRANSACTION_KINDS = ("SIP", "Lumpsum", "Redemption")
KYC_STATUSES = ("Verified", "Pending")


class Cleaned(NamedTuple):
    """A cleaned frame and its metrics; `counters` are the same metrics as aggregates over the step's input, and
    `constants` those known beforehand, where a step can be measured while it runs (`plans.cleaning.run_plan`)."""

    df: DataFrame
    metrics: DataFrame
    counters: dict[str, Column] | None = None
    constants: dict[str, int] = {}


def measured(before: DataFrame, after: DataFrame, counters: dict[str, Column], **constants: int) -> Cleaned:
    known = [F.lit(v).alias(name) for name, v in constants.items()]
    if counters:
        metrics = before.agg(*[c.alias(name) for name, c in counters.items()])
        metrics = metrics.select("*", *known) if known else metrics
    else:
        metrics = before.sparkSession.range(1).select(*known)
    return Cleaned(after, metrics, counters, constants)


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def _known(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def _missing(df: DataFrame, column: str) -> Column:
    return text.is_blank(F.col(column)) if is_text(df, column) else F.col(column).isNull()


def _as_missing(df: DataFrame, column: str) -> Column:
    """The column with blanks as null."""
    return text.blank_to_null(F.col(column)) if is_text(df, column) else F.col(column)


def _total(counts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, counts, F.lit(0)).cast("long")


def _change_cells(df: DataFrame, new: dict[str, Column], metric: str = "cells_modified", changed=None) -> Cleaned:
    """Replace columns; a cell counts as changed when its text form differs (or by the given tests)."""
    tests = changed or {
        c: ~F.col(c).cast("string").eqNullSafe(expression.cast("string")) for c, expression in new.items()
    }
    counters = {metric: _total([count_if(test) for test in tests.values()])}
    return measured(df, df.withColumns(new) if new else df, counters)


def _filter_rows(df: DataFrame, keep: Column, metric: str = "rows_removed") -> Cleaned:
    kept = F.coalesce(keep, F.lit(False))
    return measured(df, df.where(kept), {metric: count_if(~kept)})


def _counted(before: DataFrame, after: DataFrame) -> DataFrame:
    left = after.agg(F.count(F.lit(1))).scalar()
    return before.agg((F.count(F.lit(1)) - left).alias("rows_removed"))


# ---------------------------------------------------------------- missing data


def empty_columns(df: DataFrame, columns: Sequence[str] | None = None, blanks: bool = True) -> list[str]:
    """Names of columns without any value. Runs one aggregate job."""
    columns = list(columns or df.columns)
    tests = {c: _as_missing(df, c) if blanks else F.col(c) for c in columns}
    counts = df.agg(*[F.count(tests[c]).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c] == 0]


def drop_missing(
    df: DataFrame,
    rows: bool = True,
    columns: bool = True,
    critical: Sequence[str] = (),
    ignore: Sequence[str] = (),
) -> Cleaned:
    """Drop rows and columns without any value and rows lacking a critical one; blanks count as missing.

    `ignore` names bookkeeping columns such as the row id. Dropping columns runs one aggregate job.
    """
    judged = [c for c in df.columns if c not in ignore]
    empty = empty_columns(df, judged) if columns else []
    keep = F.lit(True)
    if rows:
        keep = keep & reduce(lambda a, b: a | b, [~_missing(df, c) for c in judged], F.lit(False))
    for c in _known(df, critical):
        keep = keep & ~_missing(df, c)
    result = _filter_rows(df, keep)
    return measured(df, result.df.drop(*empty), result.counters, cols_dropped=len(empty))


def fill_default(df: DataFrame, columns: Sequence[str], placeholder, as_text: bool = False) -> Cleaned:
    """Fill missing and blank cells. A text placeholder leaves a numeric column alone unless `as_text` casts it."""
    new, tests = {}, {}
    for c in _known(df, columns):
        value = placeholder
        if is_number(df, c) and not as_text:
            try:
                value = float(placeholder) if "." in str(placeholder) else int(placeholder)
            except ValueError:
                continue
        current = F.col(c).cast("string") if as_text else F.col(c)
        new[c] = F.when(_missing(df, c), F.lit(value)).otherwise(current)
        tests[c] = _missing(df, c)
    return _change_cells(df, new, "cells_filled", tests)


def fill_statistic(df: DataFrame, columns: Sequence[str], strategy: str) -> Cleaned:
    """Fill with the mean, median or mode of the column's numbers; whole-number columns take the rounded value."""
    new, tests = {}, {}
    for c in _known(df, columns):
        value = numbers.to_double(F.col(c)) if is_text(df, c) else F.col(c).cast("double")
        data = df.select(value.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
        if strategy == "mean":
            fill = data.agg(F.avg("v")).scalar()
        elif strategy == "median":
            fill = quantiles(data, [], "v", [0.5], ["m"]).scalar()
        elif strategy == "mode":
            fill = mode_by(data, [], "v", "m").scalar()
        else:
            raise ValueError("strategy is 'mean', 'median' or 'mode'")
        kind = df.schema[c].dataType
        if isinstance(kind, T.IntegralType):
            fill = F.bround(fill)
        new[c] = F.coalesce(_as_missing(df, c), fill.cast(kind))
        tests[c] = _missing(df, c) & fill.isNotNull()
    return _change_cells(df, new, "cells_filled", tests)


def fill_direction(
    df: DataFrame, columns: Sequence[str], direction: str, order: str, keys: Sequence[str] = ()
) -> Cleaned:
    """Forward or backward fill along the row id."""
    columns = _known(df, columns)
    filled = ordered.fill(df, columns, order, keys, direction)
    after = filled.agg(F.struct(*[count_if(F.col(c).isNull()).alias(c) for c in columns]).alias("s")).scalar()
    done = [count_if(_missing(df, c)) - F.first(after.getField(c)) for c in columns]
    return Cleaned(filled, df.agg(_total(done).alias("cells_filled")))


def drop_rows_missing(df: DataFrame, column: str) -> Cleaned:
    return _filter_rows(df, F.col(column).isNotNull())


def drop_trailing_empty(df: DataFrame, order: str) -> Cleaned:
    """Drop the empty rows after the last row that has a value."""
    data = [c for c in df.columns if c != order]
    filled = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in data])
    last = df.agg(F.max(F.when(filled, F.col(order)))).scalar()
    return _filter_rows(df, F.col(order) <= last)


def header_overlap(df: DataFrame, names: Sequence[str] | None = None, ignore: Sequence[str] = ()) -> Column:
    """Number of distinct cell values of a row that equal a column name."""
    columns = [c for c in df.columns if c not in ignore]
    headers = F.array(*[F.lit(n.strip().lower()) for n in (names or columns)])
    cells = F.array(*[F.lower(text.strip(F.col(c).cast("string"))) for c in columns])
    return F.size(F.array_intersect(F.array_compact(cells), headers))


def drop_embedded_headers(df: DataFrame, names: Sequence[str] | None = None, ignore: Sequence[str] = ()) -> Cleaned:
    """Drop rows of which more than half the columns repeat column names."""
    width = len([c for c in df.columns if c not in ignore])
    return _filter_rows(df, header_overlap(df, names, ignore) <= width * 0.5)


# ---------------------------------------------------------------- duplicates


def remove_duplicates(
    df: DataFrame,
    exact: bool = True,
    subset: Sequence[str] = (),
    keep: str = "first",
    order: str | None = None,
) -> Cleaned:
    """Whole-row duplicates (row id left out of the comparison), then duplicates over a subset."""
    rows = df
    if exact:
        rows = dedup.drop_duplicates(rows, None, keep, order, ignore=[order] if order else [])
    if _known(df, subset):
        rows = dedup.drop_duplicates(rows, _known(df, subset), keep, order)
    return Cleaned(rows, _counted(df, rows))


# ---------------------------------------------------------------- text


def _map_texts(df: DataFrame, columns: Sequence[str], fn) -> Cleaned:
    return _change_cells(df, {c: fn(F.col(c)) for c in _known(df, columns) if is_text(df, c)})


def trim_whitespace(df: DataFrame, columns: Sequence[str]) -> Cleaned:
    return _map_texts(df, columns, text.squeeze)


def trim_ends(df: DataFrame, columns: Sequence[str]) -> Cleaned:
    return _map_texts(df, columns, text.strip)


def blanks_to_null(df: DataFrame, columns: Sequence[str]) -> Cleaned:
    """Trim, and turn what is left empty into null."""
    return _map_texts(df, columns, lambda c: text.blank_to_null(text.squeeze(c)))


def normalize_case(df: DataFrame, columns: Sequence[str], case: str = "upper") -> Cleaned:
    return _map_texts(df, columns, lambda c: text.recase(c, case))


def standardize_casing(df: DataFrame, columns: Sequence[str], case: str = "title") -> Cleaned:
    """Strip and recase."""
    return _map_texts(df, columns, lambda c: text.recase(text.strip(c), case))


def remove_special(df: DataFrame, columns: Sequence[str], mode: str = "punctuation") -> Cleaned:
    return _map_texts(df, columns, lambda c: text.remove_characters(c, mode))


def find_replace(
    df: DataFrame,
    columns: Sequence[str],
    rules: Sequence[tuple[str, str]],
    use_regex: bool = False,
    case_sensitive: bool = True,
) -> Cleaned:
    """Rules in order on text columns. A column of which over 95% of the values are numbers stays as it is."""
    targets = [c for c in _known(df, columns) if is_text(df, c)]
    if not targets:
        return _change_cells(df, {})
    shares = df.agg(
        F.struct(
            *[F.try_divide(F.count(numbers.to_double(F.col(c))), F.count(c)).alias(c) for c in targets]
        ).alias("s")
    ).scalar()
    new = {}
    for c in targets:
        replaced = text.find_replace(F.col(c), rules, use_regex, case_sensitive)
        numeric = F.coalesce(shares.getField(c) > NUMERIC_TEXT_SHARE, F.lit(False))
        new[c] = F.when(numeric, F.col(c)).otherwise(replaced)
    return _change_cells(df, new)


def split_column(
    df: DataFrame, column: str, delimiter: str, names: Sequence[str], drop_original: bool = True
) -> Cleaned:
    """Parts of a text in named columns; extra parts are dropped, missing parts are null."""
    if column not in df.columns or not names:
        rows, split = df, 0
    else:
        rows = df.withColumns({n: text.split_part(F.col(column), delimiter, i) for i, n in enumerate(names)})
        rows = rows.drop(column) if drop_original and column not in names else rows
        split = 1
    return measured(
        df, rows, {}, columns_split=split, columns_added=len(names) * split, columns_dropped=int(drop_original) * split
    )


def merge_columns(
    df: DataFrame, columns: Sequence[str], separator: str, name: str, drop_original: bool = False
) -> Cleaned:
    """Join the stripped non-blank parts of several columns."""
    columns = _known(df, columns)
    rows = df.withColumn(name, text.merge_parts([F.col(c) for c in columns], separator)) if columns else df
    dropped = [c for c in columns if c != name] if drop_original else []
    return measured(
        df, rows.drop(*dropped), {}, columns_merged=len(columns), columns_added=int(bool(columns)), columns_dropped=len(dropped)
    )


# ---------------------------------------------------------------- types


def standardize_dates(df: DataFrame, columns: Sequence[str], target: str = "iso") -> Cleaned:
    """Dates in mixed forms to one text form; what cannot be read becomes null. `target` is a name or a pattern."""
    pattern = TARGET_FORMATS.get(target, target)
    new = {}
    for c in _known(df, columns):
        moment = parse_mixed(F.col(c)) if is_text(df, c) else F.col(c)
        new[c] = F.date_format(moment, pattern)
    return _change_cells(df, new)


def parse_dates(df: DataFrame, columns: Sequence[str]) -> Cleaned:
    """Mixed text forms to timestamps."""
    new = {c: parse_mixed(F.col(c)) for c in _known(df, columns) if is_text(df, c)}
    return _change_cells(df, new, changed={c: F.col(c).isNotNull() for c in new})


def _numeric(df: DataFrame, columns: Sequence[str], convert) -> Cleaned:
    """A cell counts as modified when it was not a plain number already, or could not be read."""
    new, tests = {}, {}
    for c in _known(df, columns):
        if not is_text(df, c):
            new[c] = F.col(c).cast("double")
            tests[c] = F.lit(False)
            continue
        new[c] = convert(F.col(c))
        tests[c] = F.col(c).isNotNull() & ~F.col(c).try_cast("double").eqNullSafe(new[c].cast("double"))
        tests[c] = tests[c] | (F.col(c).isNotNull() & new[c].isNull())
    result = _change_cells(df, new, changed=tests)
    return measured(df, result.df, result.counters, columns_converted=len(new))


def convert_numeric(df: DataFrame, columns: Sequence[str]) -> Cleaned:
    return _numeric(df, columns, numbers.to_number)


def convert_integer(df: DataFrame, columns: Sequence[str]) -> Cleaned:
    return _numeric(df, columns, numbers.to_integer)


def convert_numeric_plain(df: DataFrame, columns: Sequence[str]) -> Cleaned:
    """Longer list of currency signs, no parentheses rule."""
    return _numeric(df, columns, numbers.to_number_plain)


def normalize_booleans(
    df: DataFrame,
    columns: Sequence[str],
    true_words: Sequence[str] = numbers.TRUE_WORDS,
    false_words: Sequence[str] = numbers.FALSE_WORDS,
    keep_others: bool = False,
) -> Cleaned:
    """Words to booleans, others to null; with `keep_others` to the texts 'true' / 'false', others unchanged."""
    new = {}
    for c in _known(df, columns):
        value = numbers.to_boolean(F.col(c), true_words, false_words)
        new[c] = F.coalesce(value.cast("string"), F.col(c).cast("string")) if keep_others else value
    return _change_cells(df, new)


# ---------------------------------------------------------------- ranges and outliers


def validate_ranges(df: DataFrame, rules: Sequence[tuple[str, str, float, str]]) -> Cleaned:
    """Rules `(column, op, limit, 'drop' | 'null' | 'cap')` in order; rows to drop are gathered and dropped last.

    A later rule on the same column sees the value an earlier one left.
    """
    state = {c: F.col(c) for c in df.columns}
    changed, dropped = [], F.lit(False)
    for column, op, limit, action in rules:
        if column not in df.columns:
            continue
        current = state[column]
        value = current.try_cast("double") if is_text(df, column) else current
        bad = numbers.compare(value, op, F.lit(limit))
        if action == "drop":
            dropped = dropped | bad
            continue
        changed.append(count_if(bad))
        target = df.schema[column].dataType
        if isinstance(target, T.IntegralType) and action == "cap" and isinstance(limit, float):
            current, target = current.cast("double"), T.DoubleType()
        replacement = F.lit(None) if action == "null" else F.lit(limit).cast(target)
        state[column] = F.when(bad, replacement).otherwise(current)
    counters = {"cells_modified": _total(changed), "rows_removed": count_if(dropped)}
    touched = {rule[0] for rule in rules if rule[3] != "drop" and rule[0] in df.columns}
    rows = df.withColumn("_drop", dropped).withColumns({c: state[c] for c in touched}).where(~F.col("_drop"))
    return measured(df, rows.select(*df.columns), counters)


def parse_range_rules(lines: str) -> list[tuple[str, str, float, str]]:
    """Rules from text lines such as `age < 0 -> null`; lines that do not fit are skipped."""
    import re

    rules = []
    for line in lines.strip().splitlines():
        m = re.match(r"^\s*([\w\s\-]+?)\s+(<=|>=|==|!=|<|>)\s+(\S+)\s*->\s*(drop|null|cap)\s*$", line, re.IGNORECASE)
        if not m:
            continue
        try:
            number = float(m.group(3))
            # A whole limit stays whole, so that capping does not turn a whole-number column into doubles.
            limit = int(number) if re.fullmatch(r"[+-]?[0-9]+", m.group(3)) else number
            rules.append((m.group(1), m.group(2), limit, m.group(4).lower()))
        except ValueError:
            continue
    return rules


def apply_range_rules(df: DataFrame, rules: Sequence[tuple[str, str, float, str]]) -> Cleaned:
    """The same rules with drops applied at once: a dropped row is not seen by the rules after it.

    All rules are folded into one projection and their counts into one aggregate, whatever their number.
    """
    state = {c: F.col(c) for c in df.columns}
    alive, counts = F.lit(True), {"drop": [], "null": [], "cap": []}
    for column, op, limit, action in rules:
        if column not in df.columns:
            continue
        kind = df.schema[column].dataType
        value = numbers.to_double(state[column]) if isinstance(kind, T.StringType) else state[column]
        bad = alive & F.coalesce(numbers.compare(value, op, F.lit(limit)), F.lit(False))
        counts[action].append(count_if(bad))
        if action == "drop":
            alive = alive & ~bad
            continue
        current = state[column]
        if isinstance(kind, T.IntegralType) and action == "cap" and isinstance(limit, float):
            current, kind = current.cast("double"), T.DoubleType()
        state[column] = F.when(bad, F.lit(None) if action == "null" else F.lit(limit).cast(kind)).otherwise(current)
    names = {"rows_removed": "drop", "cells_nulled": "null", "cells_capped": "cap"}
    counters = {name: _total(counts[action]) for name, action in names.items()}
    rows = df.select(*[state[c].alias(c) for c in df.columns], alive.alias("_alive")).where("_alive")
    return measured(df, rows.select(*df.columns), counters)


def outlier_bounds(df: DataFrame, column: str, method: str, threshold: float) -> Column:
    """Struct (low, high) as a scalar subquery; nulls when there is no spread by the z-score method."""
    value = numbers.to_double(F.col(column)) if is_text(df, column) else F.col(column).cast("double")
    data = df.select(value.alias("v"))
    if method == "iqr":
        q = quantiles(data, [], "v", [0.25, 0.75], ["q1", "q3"])
        reach = threshold * (F.col("q3") - F.col("q1"))
        bounds = F.struct((F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
        return q.select(bounds.alias("b")).scalar()
    if method == "zscore":
        mean, std = F.avg("v"), F.stddev_samp("v")
        low = F.when(std > 0, mean - threshold * std)
        high = F.when(std > 0, mean + threshold * std)
        return data.agg(F.struct(low.alias("low"), high.alias("high")).alias("b")).scalar()
    raise ValueError("method is 'iqr' or 'zscore'")


def filter_outliers(
    df: DataFrame, columns: Sequence[str], method: str = "iqr", threshold: float = 1.5, action: str = "cap"
) -> Cleaned:
    """Cap, null or drop values outside bounds; every column's bounds come from the unchanged table."""
    new, counts, dropped = {}, [], F.lit(False)
    for c in _known(df, columns):
        value = numbers.to_double(F.col(c)) if is_text(df, c) else F.col(c).cast("double")
        bounds = outlier_bounds(df, c, method, threshold)
        low, high = bounds.getField("low"), bounds.getField("high")
        outside = F.coalesce((value < low) | (value > high), F.lit(False))
        if action == "drop":
            dropped = dropped | outside
            continue
        counts.append(count_if(outside))
        new[c] = numbers.clip(value, low, high) if action == "cap" else F.when(~outside, value)
    counters = {"cells_modified": _total(counts), "rows_removed": count_if(dropped)}
    return measured(df, df.where(~dropped) if action == "drop" else df.withColumns(new), counters)


def replace_sigma_outliers(df: DataFrame, column: str, sigmas: float = 3.0) -> Cleaned:
    """Null values more than `sigmas` deviations from the mean."""
    return filter_outliers(df, [column], "zscore", sigmas, "null")


def replace_negatives(df: DataFrame, column: str) -> Cleaned:
    return validate_ranges(df, [(column, "<", 0, "null")])


# ---------------------------------------------------------------- columns


def clean_name(name: str) -> str:
    """The name's lower-cased words of letters and digits, joined by single underscores.

    Space, hyphen, slash, backslash and underscore part words; every other character is left out.
    """
    kept = "".join(c if c.isalnum() else " " if c.isspace() or c in "-/\\_" else "" for c in name.lower())
    return "_".join(kept.split())


def unique_names(names: Sequence[str]) -> list[str]:
    """Later repeats of a name get `_1`, `_2`, ..."""
    taken: set[str] = set()
    result = []
    for name in names:
        candidate, i = name, 0
        while candidate in taken:
            i += 1
            candidate = f"{name}_{i}"
        taken.add(candidate)
        result.append(candidate)
    return result


def rename_columns(df: DataFrame, rules: dict[str, str] | None = None, auto_clean: bool = False) -> Cleaned:
    rules = rules or {}
    wanted = [rules.get(c, clean_name(c) if auto_clean else c) for c in df.columns]
    names = unique_names(wanted)
    renamed = sum(a != b for a, b in zip(df.columns, names))
    return measured(df, df.toDF(*names), {}, columns_renamed=renamed)


def unnamed_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(("Unnamed", "Column")) or c.strip() == ""]


def name_unnamed(df: DataFrame, dropped: Sequence[str] = ()) -> Cleaned:
    """Unnamed columns become `col_0`, `col_1`, ..."""
    rules = {c: f"col_{i}" for i, c in enumerate(x for x in unnamed_columns(df) if x not in dropped)}
    return rename_columns(df, rules)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*_known(df, columns))


# ---------------------------------------------------------------- table cleaners


def clean_value_series(df: DataFrame, key: str, moment: str, value: str) -> Cleaned:
    """Dated values per key: parse dates, drop copies, carry the last value forward, keep values over zero.

    Within a date the largest value counts as the last. The fill runs on one row per key and date, cut into stretches
    (`ordered.fill`), and comes back by join, so no key is gathered whole. Rows without a date cannot be placed and are
    not filled.
    """
    parsed = df.withColumns(
        {
            moment: parse_mixed(F.col(moment)) if is_text(df, moment) else F.col(moment),
            value: numbers.to_double(F.col(value)) if is_text(df, value) else F.col(value),
        }
    )
    unique = dedup.drop_duplicates(parsed)
    per_date = unique.where(F.col(moment).isNotNull()).groupBy(key, moment).agg(F.max(value).alias("_carried"))
    carried = ordered.fill(per_date, ["_carried"], moment, [key])
    filled = unique.join(carried, [key, moment], "left").withColumn(value, F.coalesce(value, "_carried"))
    filled = filled.select(*df.columns)
    source = df.agg(
        F.struct(F.count(F.lit(1)).alias("n"), count_if(F.col(value).isNull()).alias("missing")).alias("s")
    ).scalar()
    metrics = filled.agg(
        F.first(source.getField("n")).alias("rows_before"),
        count_if(F.col(value) > 0).alias("rows_after"),
        (F.first(source.getField("n")) - F.count(F.lit(1))).alias("duplicates_removed"),
        (F.first(source.getField("missing")) - count_if(F.col(value).isNull())).alias("nulls_handled"),
        count_if(F.col(value).isNull()).alias("missing_after_fill"),
        count_if(F.col(value) <= 0).alias("invalid_values"),
    )
    return Cleaned(filled.where(F.col(value) > 0), metrics)


def standard_kind(c: Column, synonyms: dict[str, str]) -> Column:
    """Known spellings to their standard name, others capitalised."""
    stripped = text.strip(c)
    return map_values(F.lower(stripped), synonyms, text.capitalise(stripped))


def clean_transactions(
    df: DataFrame,
    moment: str,
    kind: str,
    amount: str,
    status: str,
    synonyms: dict[str, str] = TRANSACTION_SYNONYMS,
    kinds: Sequence[str] = TRANSACTION_KINDS,
    statuses: Sequence[str] = KYC_STATUSES,
) -> Cleaned:
    """Standard kinds, valid dates, amounts over zero, known kinds and statuses; all counts in one aggregate."""
    rows = df.withColumns(
        {
            moment: parse_mixed(F.col(moment)) if is_text(df, moment) else F.col(moment),
            kind: standard_kind(F.col(kind), synonyms),
            amount: numbers.to_double(F.col(amount)) if is_text(df, amount) else F.col(amount),
        }
    )
    positive = F.coalesce(F.col(amount) > 0, F.lit(False))
    known = F.coalesce(F.col(status).isin(*statuses), F.lit(False))
    keep = F.col(moment).isNotNull() & positive & known & F.coalesce(F.col(kind).isin(*kinds), F.lit(False))
    metrics = rows.agg(
        F.count(F.lit(1)).alias("rows_before"),
        count_if(keep).alias("rows_after"),
        count_if(F.col(moment).isNull()).alias("invalid_dates"),
        count_if(~positive).alias("invalid_amounts"),
        count_if(~known).alias("invalid_statuses"),
    )
    return Cleaned(rows.where(keep), metrics)


def clean_performance(
    df: DataFrame, percents: Sequence[str], expense: str, low: float = 0.1, high: float = 2.5
) -> Cleaned:
    """Percent texts to numbers, counts of extreme returns, a flag for expense ratios out of range."""
    new = {c: F.replace(F.col(c), F.lit("%")).try_cast("double") if is_text(df, c) else F.col(c) for c in percents}
    new[expense] = numbers.to_double(F.col(expense)) if is_text(df, expense) else F.col(expense)
    rows = df.withColumns(new)
    flag = ~F.coalesce(F.col(expense).between(low, high), F.lit(False))
    rows = rows.withColumn("expense_ratio_anomaly_flag", flag)
    metrics = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        *[count_if((F.col(c) > 1000) | (F.col(c) < -100)).alias(f"{c}_outliers") for c in percents],
        count_if((F.col(expense) < low) | (F.col(expense) > high)).alias("invalid_expense"),
    )
    return Cleaned(rows, metrics)


def clean_baseline(df: DataFrame) -> Cleaned:
    """Parse columns named date or month, then drop copies."""
    moments = [c for c in df.columns if c.lower() in ("date", "month") and is_text(df, c)]
    month_first = {c: F.coalesce(parse_mixed(F.col(c)), parse_mixed(F.concat(F.col(c), F.lit("-01")))) for c in moments}
    return remove_duplicates(df.withColumns(month_first))


def apply_learned_rules(df: DataFrame, rules: Sequence[dict]) -> Cleaned:
    """Rules `{'fix': 'pad' | 'sentinel' | 'date', 'columns': [name parts], ...}` on every column they match.

    `pad` takes `width`, `sentinel` takes `value` (case ignored). Nulls stay null.
    """
    new: dict[str, Column] = {}
    for rule in rules:
        for c in df.columns:
            if not any(part in c.lower() for part in rule["columns"]):
                continue
            current = new.get(c, F.col(c))
            if rule["fix"] == "pad":
                new[c] = text.zero_pad(current.cast("string"), int(rule["width"]))
            elif rule["fix"] == "sentinel" and is_text(df, c):
                new[c] = text.null_if_sentinel(current, [rule["value"]])
            elif rule["fix"] == "date" and is_text(df, c):
                new[c] = parse_mixed(current)
    return _change_cells(df, new)
