"""Grouped statistics, feature columns and hypothesis tests for pay tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.functions.distributions import f_upper, t_two_sided
from grainmill.functions.mapping import map_values
from grainmill.functions.numbers import band, ratio
from grainmill.functions.stats import avg_if, share
from grainmill.operators.dedup import drop_duplicates
from grainmill.operators.quantiles import aggregate_with_quantiles
from grainmill.functions.text import strip
from grainmill.operators.values import top_values, value_counts

# Seniority order, size names, pay bands.
EXPERIENCE_ORDER = ("Entry-level", "Mid-level", "Senior", "Executive")
SIZE_NAMES = {"S": "Small", "M": "Medium", "L": "Large"}
BAND_EDGES = (0, 50000, 100000, 150000, 200000, 300000)
BAND_LABELS = ("<50K", "50K-100K", "100K-150K", "150K-200K", "200K-300K", "300K+")


def clean_pay_table(df: DataFrame, whole: Sequence[str], numbers: Sequence[str], required: str) -> DataFrame:
    """Drop copies, cast whole and decimal columns, drop rows without the required number, trim the texts."""
    rows = drop_duplicates(df)
    casts = {c: strip(F.col(c).cast("string")).try_cast("bigint") for c in whole}
    casts |= {c: strip(F.col(c).cast("string")).try_cast("double") for c in numbers}
    texts = {c: strip(F.col(c)) for c, kind in df.dtypes if kind == "string" and c not in casts}
    return rows.withColumns(casts | texts).where(F.col(required).isNotNull())


def group_statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return aggregate_with_quantiles(
        df.select(*keys, value),
        list(keys),
        [
            F.avg(value).alias("mean"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.stddev_samp(value).alias("std"),
            F.count(value).alias("count"),
        ],
        {"median": (value, 0.5)},
    )


def top_groups(
    df: DataFrame, key: str, value: str, n: int, by: str = "median", descending: bool = True, minimum: int = 5
) -> DataFrame:
    """Best or worst `n` groups by a statistic, among groups with enough rows; ties by key."""
    rows = group_statistics(df, [key], value).where(F.col("count") >= minimum)
    return rows.orderBy(F.col(by).desc() if descending else F.col(by).asc(), key).limit(n)


def restrict_to_top(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the `n` most frequent keys."""
    kept = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), key).limit(n)
    return df.join(F.broadcast(kept.select(key)), key, "left_semi")  # at most n rows


def yearly(df: DataFrame, year: str, value: str) -> DataFrame:
    return aggregate_with_quantiles(
        df.select(year, value),
        [year],
        [F.count(value).alias("job_count"), F.avg(value).alias("avg_salary")],
        {"median_salary": (value, 0.5)},
    )


def ladder(df: DataFrame, level: str, value: str, order: Sequence[str] = EXPERIENCE_ORDER) -> DataFrame:
    """Statistics per level in the given order; levels outside it are left out."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(level))
    rows = group_statistics(df.where(F.col(level).isin(*order)), [level], value)
    return rows.withColumn("place", place).orderBy("place")


def features(
    df: DataFrame,
    level: str,
    value: str,
    size: str,
    country: str,
    year: str,
    home: str,
    levels: Sequence[str] = EXPERIENCE_ORDER,
    sizes: Mapping[str, str] | None = None,
    edges: Sequence[float] = BAND_EDGES,
    labels: Sequence[str] = BAND_LABELS,
    top: int = 10,
) -> DataFrame:
    """Rank, pay band, size name, country group (top `top`, rest "Other"), home flag, year as text."""
    frequent = (
        df.groupBy(F.col(country).alias("_c")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), "_c").limit(top)
    )
    joined = df.join(F.broadcast(frequent.select("_c")), F.col(country) == F.col("_c"), "left")  # at most `top` rows
    return joined.select(
        *df.columns,
        map_values(F.col(level), {name: i + 1 for i, name in enumerate(levels)}, 0).alias("experience_rank"),
        band(F.col(value), edges, labels).alias("salary_band"),
        map_values(F.col(size), sizes or SIZE_NAMES, "Unknown").alias("company_size_label"),
        F.coalesce("_c", F.lit("Other")).alias("country_group"),
        F.coalesce((F.col(country) == home).cast("int"), F.lit(0)).alias("is_us"),
        F.col(year).cast("string").alias("work_year_str"),
    )


def summary(
    df: DataFrame, title: str, category: str, country: str, value: str, year: str, remote: Column, senior: Column
) -> DataFrame:
    """The thirteen headline figures in one row."""
    counts = value_counts(df, [title, category, country])
    firsts = top_values(counts, 1).agg(
        F.struct(
            F.max(F.when(F.col("column") == title, F.col("value"))).alias("title"),
            F.max(F.when(F.col("column") == category, F.col("value"))).alias("category"),
        ).alias("s")
    )
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("k"))
    kinds = distinct.agg(
        F.struct(*[F.max(F.when(F.col("column") == c, F.col("k"))).alias(a) for c, a in ((title, "t"), (category, "c"), (country, "o"))]).alias("s")
    ).scalar()
    common = firsts.scalar()
    rows = aggregate_with_quantiles(
        df,
        [],
        [
            F.count(F.lit(1)).alias("total_jobs"),
            F.avg(value).alias("avg_salary"),
            F.min(value).alias("min_salary"),
            F.max(value).alias("max_salary"),
            (share(remote) * 100).alias("pct_remote"),
            (share(senior) * 100).alias("pct_senior"),
            F.concat_ws("-", F.min(year).cast("string"), F.max(year).cast("string")).alias("year_range"),
        ],
        {"median_salary": (value, 0.5)},
    )
    return rows.select(
        "*",
        kinds.getField("t").alias("unique_titles"),
        kinds.getField("c").alias("unique_categories"),
        kinds.getField("o").alias("unique_countries"),
        common.getField("title").alias("most_common_title"),
        common.getField("category").alias("most_common_category"),
    )


def level_growth(df: DataFrame, category: str, level: str, value: str, low: str, high: str) -> DataFrame:
    """Growth in percent from the median of one level to the median of another, per category."""
    marked = df.where(F.col(level).isin(low, high)).withColumns(
        {
            "_low": F.when(F.col(level) == low, F.col(value)),
            "_high": F.when(F.col(level) == high, F.col(value)),
        }
    )
    rows = aggregate_with_quantiles(
        marked.select(category, "_low", "_high"),
        [category],
        [F.count(F.lit(1)).alias("n")],
        {"low_median": ("_low", 0.5), "high_median": ("_high", 0.5)},
    )
    growth = (ratio(F.col("high_median"), F.col("low_median")) - 1) * 100
    return rows.withColumn("growth_pct", growth).where(F.col("growth_pct").isNotNull())


def home_premium(df: DataFrame, at_home: Column, value: str) -> DataFrame:
    """Median at home and abroad, and the premium in percent."""
    marked = df.select(
        F.when(at_home, F.col(value)).alias("_home"), F.when(~F.coalesce(at_home, F.lit(False)), F.col(value)).alias("_away")
    )
    rows = aggregate_with_quantiles(
        marked,
        [],
        [F.count("_home").alias("home_jobs"), F.count("_away").alias("away_jobs")],
        {"home_median": ("_home", 0.5), "away_median": ("_away", 0.5)},
    )
    return rows.withColumn("premium_pct", (ratio(F.col("home_median"), F.col("away_median")) - 1) * 100)


def comparable_range(df: DataFrame, keys: Sequence[str], value: str, minimum: int = 5) -> DataFrame:
    """Quartiles and median per combination of keys with enough rows."""
    rows = aggregate_with_quantiles(
        df.select(*keys, value),
        keys,
        [F.count(value).alias("n")],
        {"q25": (value, 0.25), "median": (value, 0.5), "q75": (value, 0.75)},
    )
    return rows.where(F.col("n") >= minimum)


def welch_test(df: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """Welch's t test from sufficient statistics: one aggregate, then arithmetic on a single row."""
    in_a, in_b = F.col(group) == a, F.col(group) == b
    v = F.col(value)
    rows = df.agg(
        F.count(F.when(in_a, v)).alias("n_a"),
        F.count(F.when(in_b, v)).alias("n_b"),
        avg_if(in_a, v).alias("mean_a"),
        avg_if(in_b, v).alias("mean_b"),
        F.var_samp(F.when(in_a, v)).alias("var_a"),
        F.var_samp(F.when(in_b, v)).alias("var_b"),
    ).where((F.col("n_a") >= 2) & (F.col("n_b") >= 2))
    sa, sb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    return rows.select(
        "mean_a",
        "mean_b",
        (F.col("mean_a") - F.col("mean_b")).alias("difference"),
        ((F.col("mean_a") - F.col("mean_b")) / F.sqrt(sa + sb)).alias("t_statistic"),
        ((sa + sb) * (sa + sb) / (sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1))).alias("df"),
    )


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance from per-group counts, means and squared deviations."""
    groups = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(
        F.count(value).cast("double").alias("n"),
        F.avg(value).alias("m"),
        (F.var_pop(value) * F.count(value)).alias("ss"),
    )
    grand = groups.agg(F.sum(F.col("n") * F.col("m")) / F.sum("n")).scalar()
    rows = groups.agg(
        F.sum(F.col("n") * (F.col("m") - grand) * (F.col("m") - grand)).alias("between"),
        F.sum("ss").alias("within"),
        (F.count(F.lit(1)) - 1).cast("double").alias("df_between"),
        (F.sum("n") - F.count(F.lit(1))).alias("df_within"),
    )
    f = (F.col("between") / F.col("df_between")) / (F.col("within") / F.col("df_within"))
    return rows.withColumn("f_statistic", f)


def with_t_p_value(rows: DataFrame, level: float = 0.05) -> DataFrame:
    tested = rows.withColumn("p_value", t_two_sided(F.col("t_statistic"), F.col("df")))
    return tested.withColumn("significant", F.col("p_value") < level)


def with_f_p_value(rows: DataFrame, level: float = 0.05) -> DataFrame:
    tested = rows.withColumn("p_value", f_upper(F.col("f_statistic"), F.col("df_between"), F.col("df_within")))
    return tested.withColumn("significant", F.col("p_value") < level)


def level_matrix(df: DataFrame, category: str, level: str, value: str, order: Sequence[str]) -> DataFrame:
    """Median per category and level, levels as columns in order."""
    from grainmill.operators.explore import pivot_table

    return pivot_table(df, category, level, value, "median", list(order), fill=None)


def progression(matrix: DataFrame, category: str, order: Sequence[str]) -> DataFrame:
    """The matrix in long form, missing cells left out."""
    return matrix.unpivot([category], list(order), "level", "median").where(F.col("median").isNotNull())

