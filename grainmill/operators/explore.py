"""Exploratory analysis: column profiles, correlations, redundant columns, pivots, comparisons, what-ifs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from grainmill.functions.stats import correlation, count_if, skew, skew_label, sum_if
from grainmill.functions.text import within_one_edit
from grainmill.operators import moments
from grainmill.operators.quantiles import column_quantiles, quantiles
from grainmill.operators.series import largest_gap
from grainmill.operators.values import distinct_stats, top_values, value_counts


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def moment_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def melt_row(wide: DataFrame, groups: Mapping[str, Mapping[str, str]], label: str = "column") -> DataFrame:
    """Turn the one-row result of a wide aggregate into one row per group: `{group: {output name: source column}}`."""
    cells = [
        F.struct(F.lit(group).alias(label), *[F.col(f"`{source}`").alias(out) for out, source in fields.items()])
        for group, fields in groups.items()
    ]
    return wide.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def overview(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))


def missing_per_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percent per column, one pass."""
    columns = list(columns or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = melt_row(wide, {c: {"missing": c, "rows": "_rows"} for c in columns})
    return rows.withColumn("missing_pct", F.try_divide(F.col("missing") * 100.0, F.col("rows")))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes, quartiles and skew per numeric column, in passes shared by all columns."""
    plain = {
        "count": lambda c: F.count(c),
        "missing": lambda c: count_if(F.col(c).isNull()),
        "mean": lambda c: F.avg(c),
        "std": lambda c: F.stddev_samp(c),
        "min": lambda c: F.min(F.col(c).cast("double")),
        "max": lambda c: F.max(F.col(c).cast("double")),
        "skew": lambda c: skew(F.col(c)),
    }
    wide = df.agg(*[fn(c).alias(f"{c}|{name}") for c in columns for name, fn in plain.items()])
    rows = melt_row(wide, {c: {name: f"{c}|{name}" for name in plain} for c in columns})
    points = column_quantiles(df, columns, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return rows.join(points, "column", "left")


def describe_texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct values, most frequent value and its count per text column, in one shuffle."""
    best = F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value")))
    return (
        value_counts(df, columns)
        .groupBy("column")
        .agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("_b"))
        .select("column", "count", "unique", F.col("_b.value").alias("top"), F.col("_b.n").alias("freq"))
    )


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    rows = describe(df, list(columns or numeric_columns(df)))
    return rows.withColumn("skew_label", skew_label(F.col("skew"))).withColumn(
        "missing_pct", F.try_divide(F.col("missing") * 100.0, F.col("missing") + F.col("count"))
    )


def categorical_profile(df: DataFrame, columns: Sequence[str] | None = None, top: int = 5) -> DataFrame:
    """Per column and place: distinct values and the most frequent values with their share."""
    counts = value_counts(df, list(columns or text_columns(df)))
    stats = distinct_stats(counts).select("column", "present", "distinct_values")
    return top_values(counts, top).join(stats, "column")


def datetime_profile(df: DataFrame, moment: str) -> DataFrame:
    """Range, busiest month, busiest weekday with its share, longest pause. Ties go to the earlier name.

    Everything is derived from per-day counts, so the table itself is aggregated once per measure group.
    """
    days = (
        df.where(F.col(moment).isNotNull())
        .groupBy(F.to_date(moment).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(moment).alias("a"), F.max(moment).alias("b"))
    )

    def busiest(unit: Column) -> DataFrame:
        groups = days.groupBy(unit.alias("u")).agg(F.sum("n").alias("m"))
        return groups.agg(F.min_by(F.struct("u", "m"), F.struct(-F.col("m"), F.col("u"))).alias("s"))

    month = busiest(F.date_format("day", "yyyy-MM")).scalar()
    weekday = busiest(F.date_format("day", "EEEE")).scalar()
    gap = largest_gap(df, moment).select(F.struct("gap_days", "gap_start", "gap_end").alias("g")).scalar()
    return days.agg(
        F.lit(moment).alias("column"),
        F.min("a").alias("earliest"),
        F.max("b").alias("latest"),
        F.sum("n").alias("present"),
    ).select(
        "column",
        "earliest",
        "latest",
        month.getField("u").alias("peak_month"),
        weekday.getField("u").alias("busiest_day"),
        (weekday.getField("m") * 100.0 / F.col("present")).alias("busiest_pct"),
        gap.getField("gap_days").alias("gap_days"),
        gap.getField("gap_start").alias("gap_start"),
        gap.getField("gap_end").alias("gap_end"),
    )


# More pairs of columns than an aggregate of one expression each compiles well for.
WIDE = 12


def correlation_pairs(df: DataFrame, columns: Sequence[str], above: float | None = None) -> DataFrame:
    """Pearson correlation of every pair in one scan; kept where |r| exceeds `above`."""
    pairs = list(combinations(columns, 2))
    if len(columns) > WIDE:
        rows = moments.comoments(df, columns).select("first", "second", "r").where(F.col("r").isNotNull())
    else:
        wide = df.agg(*[correlation(F.col(a), F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
        cells = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(str(i)).alias("r")) for i, (a, b) in enumerate(pairs)]
        rows = wide.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*").where(F.col("r").isNotNull())
    if above is not None:
        rows = rows.where(F.abs("r") > above)
    return rows.withColumn("strength", F.when(F.abs("r") > 0.7, "strong").otherwise("moderate")).withColumn(
        "direction", F.when(F.col("r") > 0, "positive").otherwise("negative")
    )


def proportional_pairs(df: DataFrame, columns: Sequence[str], minimum: int = 10) -> DataFrame:
    """Pairs where the second column is a constant multiple of the first: ratio deviation under 1% of its mean. One scan."""
    close = (F.col("spread") < 0.01 * F.abs("factor")) & (F.col("factor") != 0)
    return moments.ratios(df, columns).where((F.col("n") >= minimum) & close).select("source", "derived", "factor", "n")


def product_triples(df: DataFrame, columns: Sequence[str], minimum: int = 10, batch: int = 200) -> DataFrame:
    """Columns that equal the product of two others: mean absolute error under 1% of the mean size.

    A job runs at once: one scan that gathers the moments of all triples and leaves out those that cannot be such. The
    few left are checked exactly, `batch` of them in a scan.
    """
    found = moments.product_candidates(df, columns, minimum, 0.01).collect()
    triples = sorted((r["derived"], r["left"], r["right"]) for r in found)
    kind = "derived string, left string, right string, n bigint, error double, size double"
    frames = [df.sparkSession.createDataFrame([], kind)]
    for start in range(0, len(triples), batch):
        aggregates = []
        for i, (a, b, c) in enumerate(triples[start : start + batch]):
            x, y, z = (F.col(f"`{n}`").cast("double") for n in (a, b, c))
            whole = x.isNotNull() & y.isNotNull() & z.isNotNull()
            aggregates.append(
                F.struct(
                    F.lit(a).alias("derived"),
                    F.lit(b).alias("left"),
                    F.lit(c).alias("right"),
                    count_if(whole).alias("n"),
                    F.avg(F.abs(x - y * z)).alias("error"),
                    F.avg(F.when(whole, F.abs(x))).alias("size"),
                ).alias(str(i))
            )
        wide = df.agg(*aggregates)
        frames.append(wide.select(F.explode(F.array(*[F.col(str(i)) for i in range(len(aggregates))])).alias("c")).select("c.*"))
    rows = reduce(DataFrame.unionByName, frames)
    return rows.where((F.col("n") >= minimum) & (F.col("error") < 0.01 * F.col("size"))).select(
        "derived", "left", "right", "n"
    )


def key_overlap(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Distinct keys on each side, common keys, and common keys over the larger side."""
    a = left.select(F.col(left_key).cast("string").alias("k")).where(F.col("k").isNotNull()).distinct()
    b = right.select(F.col(right_key).cast("string").alias("k")).where(F.col("k").isNotNull()).distinct()
    sides = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "k", "full")
    counts = sides.agg(
        F.count("l").alias("left_keys"),
        F.count("r").alias("right_keys"),
        F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)).alias("common_keys"),
    )
    share = F.try_divide(F.col("common_keys"), F.greatest("left_keys", "right_keys"))
    return counts.select(
        F.lit(left_key).alias("left_column"), F.lit(right_key).alias("right_column"), "*", share.alias("overlap")
    )


def join_candidates(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], above: float = 0.60):
    """Column pairs whose distinct values overlap by more than `above`."""
    rows = reduce(DataFrame.unionByName, [key_overlap(left, a, right, b) for a, b in pairs])
    return rows.where(F.col("overlap") > above)


def one_left_out(low: Column) -> Column:
    """The text without its first character, without its second, and so on; the empty text for an empty one."""
    positions = F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1)))
    return F.transform(positions, lambda i: F.concat(F.substring(low, F.lit(1), i - 1), F.substr(low, i + 1)))


def similar_pairs(values: DataFrame, keys: Sequence[str], value: str, firsts: DataFrame | None = None) -> DataFrame:
    """Pairs of distinct values one edit apart (case ignored), within the keys; with `firsts`, only pairs that one of
    those values begins.

    Two such texts share either themselves or a form with one character left out, so candidates meet in an equi-join
    on those forms; there is no all-pairs comparison.
    """
    low = F.lower(F.col(value))
    form = F.explode(F.array_distinct(F.concat(F.array(low), one_left_out(low)))).alias("form")
    forms = values.select(*keys, F.col(value).alias("v"), form)
    a = forms if firsts is None else firsts.select(*keys, F.col(value).alias("v"), form)
    a = a.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("v").alias("first"), F.col("form").alias("f1"))
    on = F.col("f1") == F.col("form")
    for k in keys:
        on = on & F.col(f"_{k}").eqNullSafe(F.col(k))
    pairs = a.join(forms, on).where(F.col("first") < F.col("v"))
    return (
        pairs.where(within_one_edit(F.col("first"), F.col("v")))
        .select(*keys, "first", F.col("v").alias("second"))
        .distinct()
    )


PIVOT_FUNCTIONS = {
    "sum": F.sum,
    "mean": F.avg,
    "count": F.count,
    "max": F.max,
    "min": F.min,
    "nunique": F.count_distinct,
    "median": F.median,
}


def pivot_table(
    df: DataFrame, row: str, column: str, value: str, function: str, columns: Sequence, fill: float | None = 0.0
) -> DataFrame:
    """Two-way table with the given column values (naming them saves the extra pass that would look for them)."""
    if function == "median":
        long = quantiles(df.where(F.col(column).isin(*columns)), [row, column], value, [0.5], ["m"])
        wide = long.groupBy(row).pivot(column, list(columns)).agg(F.first("m"))
    else:
        wide = df.groupBy(row).pivot(column, list(columns)).agg(PIVOT_FUNCTIONS[function](value))
    return wide.na.fill(fill, list(map(str, columns))) if fill is not None else wide


# ---------------------------------------------------------------- comparisons


def difference_table(rows: DataFrame) -> DataFrame:
    """Add change and percent change to rows (name, val_a, val_b)."""
    change = F.col("val_b") - F.col("val_a")
    return rows.withColumn("change", change).withColumn("pct_change", F.try_divide(change, F.col("val_a")) * 100)


def _two_sides(df: DataFrame, in_a: Column, in_b: Column, columns: Sequence[str], sums: bool, count_name: str | None):
    """Means (and sums) of two row sets in one pass, as rows (name, val_a, val_b)."""
    names, aggregates = [], []

    def add(name: str, a: Column, b: Column) -> None:
        i = len(names)
        names.append(name)
        aggregates.extend([a.cast("double").alias(f"a{i}"), b.cast("double").alias(f"b{i}")])

    if count_name:
        add(count_name, count_if(in_a), count_if(in_b))
    for c in columns:
        add(f"{c} (mean)", F.avg(F.when(in_a, F.col(c))), F.avg(F.when(in_b, F.col(c))))
        if sums:
            add(f"{c} (sum)", F.coalesce(sum_if(in_a, F.col(c)), F.lit(0)), F.coalesce(sum_if(in_b, F.col(c)), F.lit(0)))
    wide = df.agg(*aggregates)
    return melt_row(wide, {n: {"val_a": f"a{i}", "val_b": f"b{i}"} for i, n in enumerate(names)}, "name")


def compare_halves(df: DataFrame, moment: str, columns: Sequence[str]) -> DataFrame:
    """Rows up to the median moment against rows after it."""
    micros = F.unix_micros(F.col(moment).cast("timestamp"))
    timed = df.withColumn("_t", micros.cast("double")).where(F.col("_t").isNotNull())
    middle = quantiles(timed, [], "_t", [0.5], ["m"]).scalar()
    rows = _two_sides(timed, F.col("_t") <= middle, F.col("_t") > middle, columns, True, "Row count")
    return difference_table(rows)


def compare_segments(df: DataFrame, column: str, a: str, b: str, columns: Sequence[str]) -> DataFrame:
    return difference_table(_two_sides(df, F.col(column) == a, F.col(column) == b, columns, False, "Row count"))


def compare_tables(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row counts and means of the numeric columns two tables share."""

    def side(df: DataFrame, name: str) -> DataFrame:
        wide = df.agg(
            F.count(F.lit(1)).cast("double").alias("Row count"), *[F.avg(c).alias(f"{c} (mean)") for c in columns]
        )
        return melt_row(wide, {c: {name: c} for c in wide.columns}, "name")

    return difference_table(side(a, "val_a").join(side(b, "val_b"), "name"))


def strongest_changes(rows: DataFrame, n: int = 3) -> DataFrame:
    return rows.where(F.col("pct_change").isNotNull()).orderBy(F.abs("pct_change").desc(), "name").limit(n)


# ---------------------------------------------------------------- what-if projections


def scale_column(df: DataFrame, column: str, percent: float) -> DataFrame:
    """Totals and mean before and after changing a column by a percentage, with its variation coefficient."""
    factor = 1 + percent / 100
    rows = df.agg(F.sum(column).alias("total"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    return rows.select(
        F.col("total").alias("total_before"),
        (F.col("total") * factor).alias("total_after"),
        F.col("mean").alias("mean_before"),
        (F.col("mean") * factor).alias("mean_after"),
        F.coalesce(F.try_divide(F.col("std"), F.col("mean")) * 100, F.lit(0.0)).alias("variation_pct"),
    )


def _keep_effect(df: DataFrame, kept: Column, columns: Sequence[str]) -> DataFrame:
    wide = df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        count_if(kept).alias("rows_after"),
        *[F.sum(c).alias(f"{c}|before") for c in columns],
        *[F.coalesce(sum_if(kept, F.col(c)), F.lit(0.0)).alias(f"{c}|after") for c in columns],
    )
    rows = melt_row(
        wide,
        {c: {"rows_before": "rows_before", "rows_after": "rows_after", "total_before": f"{c}|before", "total_after": f"{c}|after"} for c in columns},
    )
    lost = F.col("total_before") - F.col("total_after")
    return rows.withColumn("lost_pct", F.try_divide(lost, F.col("total_before")) * 100)


def remove_segment(df: DataFrame, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Effect of dropping all rows of one segment (case ignored)."""
    kept = ~F.coalesce(F.lower(F.col(column)) == value.lower(), F.lit(False))
    return _keep_effect(df, kept, columns)


def keep_above(df: DataFrame, column: str, threshold: float, columns: Sequence[str]) -> DataFrame:
    """Effect of keeping only rows above a threshold."""
    return _keep_effect(df, F.coalesce(F.col(column) > threshold, F.lit(False)), columns)


# ---------------------------------------------------------------- findings

# Name parts of value-like columns and of customer columns.
VALUE_WORDS = (
    "revenue", "amount", "sales", "price", "total", "value", "salary", "income", "compensation", "pay", "wage",
    "earnings",
)
CUSTOMER_WORDS = ("customer", "user", "client", "buyer")


def seasonality(df: DataFrame, moment: str, above: float = 0.40) -> DataFrame:
    quarters = df.where(F.col(moment).isNotNull()).groupBy(F.quarter(moment).alias("quarter")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = quarters.agg(F.sum("n")).scalar()
    rows = quarters.select("quarter", (F.col("n") / total).alias("share"))
    return rows.where((total >= 10) & (F.col("share") > above))


def premium_segments(df: DataFrame, segment: str, value: str) -> DataFrame:
    """Segments whose share of value is over twice their share of rows and over 15%."""
    groups = df.where(F.col(segment).isNotNull()).groupBy(segment).agg(
        F.sum(value).alias("v"), F.count(F.lit(1)).alias("n")
    )
    totals = groups.agg(
        F.struct(F.sum("v").alias("v"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).alias("t")
    ).scalar()
    rows = groups.select(
        F.col(segment).alias("segment"),
        (F.col("v") / totals.getField("v")).alias("value_share"),
        (F.col("n") / totals.getField("n")).alias("row_share"),
        totals.getField("k").alias("k"),
    )
    wanted = (F.col("value_share") > 2 * F.col("row_share")) & (F.col("value_share") > 0.15) & (F.col("k") >= 2)
    return rows.where(wanted).drop("k")


def single_purchases(df: DataFrame, customer: str, above: float = 0.20) -> DataFrame:
    counts = df.where(F.col(customer).isNotNull()).groupBy(customer).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.agg(F.count(F.lit(1)).alias("customers"), count_if(F.col("n") == 1).alias("single"))
    rows = rows.withColumn("share", F.try_divide(F.col("single"), F.col("customers")))
    return rows.where(F.col("share") > above)


def customer_concentration(df: DataFrame, customer: str, value: str, n: int = 10, above: float = 0.30) -> DataFrame:
    groups = df.where(F.col(customer).isNotNull()).groupBy(customer).agg(F.sum(value).alias("v"))
    totals = groups.agg(F.struct(F.sum("v").alias("v"), F.count(F.lit(1)).alias("k")).alias("t")).scalar()
    top = groups.orderBy(F.col("v").desc()).limit(n).agg(F.sum("v").alias("top_value"))
    rows = top.select((F.col("top_value") / totals.getField("v")).alias("share"), totals.getField("k").alias("customers"))
    return rows.where((F.col("share") > above) & (F.col("customers") >= 10))


def discount_effect(df: DataFrame, discount: str, value: str, below: float = -0.50) -> DataFrame:
    both = F.col(discount).isNotNull() & F.col(value).isNotNull()
    rows = df.agg(correlation(F.col(discount), F.col(value)).alias("r"), count_if(both).alias("n"))
    return rows.where((F.col("n") >= 10) & (F.col("r") < below))


def weekday_skew(df: DataFrame, moment: str, above: float = 70.0) -> DataFrame:
    present = F.col(moment).isNotNull()
    rows = df.agg(
        count_if(present).alias("n"), count_if(present & (F.weekday(moment) < 5)).alias("weekdays")
    ).withColumn("weekday_pct", F.try_divide(F.col("weekdays") * 100.0, F.col("n")))
    pattern = F.when(F.col("weekday_pct") > above, "weekday").when(100 - F.col("weekday_pct") > above, "weekend")
    return rows.where(F.col("n") >= 10).select("weekday_pct", pattern.alias("pattern")).where("pattern IS NOT NULL")


def place_concentration(df: DataFrame, place: str, above: float = 0.50) -> DataFrame:
    top = top_values(value_counts(df, [place]), 2)
    rows = top.agg(
        F.sum("share").alias("share"),
        F.max(F.when(F.col("place") == 1, F.col("value"))).alias("first"),
        F.max(F.when(F.col("place") == 2, F.col("value"))).alias("second"),
    )
    return rows.where(F.col("second").isNotNull() & (F.col("share") > above))


def date_gap(df: DataFrame, moment: str, above: int = 30) -> DataFrame:
    return largest_gap(df, moment).where(F.col("gap_days") > above)


def zero_values(df: DataFrame, columns: Sequence[str], above: float = 2.0) -> DataFrame:
    wide = df.agg(
        F.count(F.lit(1)).alias("_n"), *[count_if(F.col(c) == 0).alias(c) for c in columns]
    )
    rows = melt_row(wide, {c: {"zeros": c, "rows": "_n"} for c in columns})
    rows = rows.withColumn("zero_pct", F.try_divide(F.col("zeros") * 100.0, F.col("rows")))
    return rows.where(F.col("zero_pct") > above)


def rapid_growth(df: DataFrame, moment: str, above: float = 1.5) -> DataFrame:
    """Last month present against the month present before it."""
    months = df.where(F.col(moment).isNotNull()).groupBy(F.date_format(moment, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = months.agg(F.sum("n")).scalar()
    last = months.orderBy(F.col("month").desc()).limit(2)
    both = last.agg(
        F.max_by("n", "month").alias("latest"),
        F.min_by("n", "month").alias("previous"),
        F.max("month").alias("month"),
        F.count(F.lit(1)).alias("k"),
    ).withColumn("ratio", F.col("latest") / F.col("previous"))
    return both.where((total >= 10) & (F.col("k") == 2) & (F.col("ratio") > above)).drop("k")


def dominant_values(df: DataFrame, columns: Sequence[str], above: float = 0.80) -> DataFrame:
    return top_values(value_counts(df, columns), 1).where(F.col("share") > above).drop("place")


def segment_outliers(df: DataFrame, segment: str, value: str, minimum: int = 5) -> DataFrame:
    """Segments with a mean over 1.5 times or under half the overall mean; needs 2 to 15 segments."""
    overall = df.agg(F.avg(value)).scalar()
    groups = df.where(F.col(segment).isNotNull()).groupBy(segment).agg(
        F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")
    )
    kinds = groups.agg(F.count(F.lit(1))).scalar()
    rows = groups.withColumn("ratio", F.try_divide(F.col("mean"), overall))
    kind = F.when(F.col("ratio") > 1.5, "high").when(F.col("ratio") < 0.5, "low")
    wanted = kinds.between(2, 15) & (F.col("n") >= minimum)
    return rows.where(wanted).withColumn("kind", kind).where(F.col("kind").isNotNull())


def first_only(findings: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Keep a rule's first finding only, as the interactive form of the rules does."""
    return findings.orderBy(*order).limit(1)


def column_detail(df: DataFrame, column: str) -> DataFrame:
    """Non-null and distinct counts of one column with its numeric profile or its five most frequent values."""
    if isinstance(df.schema[column].dataType, T.NumericType):
        distinct = df.agg(F.count_distinct(column)).scalar()
        return numeric_profile(df, [column]).withColumn("distinct_values", distinct)
    return categorical_profile(df, [column], 5)


